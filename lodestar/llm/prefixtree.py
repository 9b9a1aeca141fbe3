"""A path-compressed prefix tree of globally ordered sets, and a similarity self-join over it."""

from __future__ import annotations

import numpy as np

#: Two sets link when PER * overlap >= LEAST * union.
LEAST, PER = 75, 100


def least_overlap(a: int, b: int) -> int:
    """The smallest overlap with which sets of these sizes link."""
    return -(-LEAST * (a + b) // (PER + LEAST))


def links(overlap: int, a: int, b: int) -> bool:
    return PER * overlap >= LEAST * (a + b - overlap)


class Components:
    """Union-find; the root of a component is its least member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


class Node:
    """segment: ranks of the edge into the node. low, high: set sizes below. longest: most ranks below the segment.

    member: a set below while all below are in one component, else -1. leaves: sets that end here.
    """

    __slots__ = ("segment", "children", "leaves", "low", "high", "longest", "member")

    def __init__(self, segment: np.ndarray, low: int, high: int, longest: int, member: int):
        self.segment, self.children, self.leaves = segment, {}, []
        self.low, self.high, self.longest, self.member = low, high, longest, member


class PrefixTree:
    """Sets as ascending ranks. `sizes` are of the whole sets, which may have further elements that no other set has."""

    def __init__(self, sizes: list[int]):
        self.root = Node(np.empty(0, np.int64), 1 << 62, 0, 0, -2)
        self.sizes = sizes

    def insert(self, i: int, ranks: np.ndarray, components: Components) -> None:
        n, node, at = self.sizes[i], self.root, 0
        while True:
            node.low, node.high, node.longest = min(node.low, n), max(node.high, n), max(node.longest, len(ranks) - at)
            if node.member == -2:
                node.member = i
            elif node.member >= 0 and components.find(node.member) != components.find(i):
                node.member = -1
            if at == len(ranks):
                node.leaves.append(i)
                return
            child = node.children.get(ranks[at])
            if child is None:
                new = Node(ranks[at:], n, n, 0, i)
                new.leaves.append(i)
                node.children[ranks[at]] = new
                return
            span = min(len(child.segment), len(ranks) - at)
            differ = np.flatnonzero(child.segment[:span] != ranks[at : at + span])
            same = int(differ[0]) if len(differ) else span
            if same < len(child.segment):  # cut the edge in two
                upper = Node(child.segment[:same], child.low, child.high, child.longest + len(child.segment) - same, child.member)
                child.segment = child.segment[same:]
                upper.children[child.segment[0]] = child
                node.children[ranks[at]] = upper
                child = upper
            node, at = child, at + same

    def probe(self, i: int, ranks: np.ndarray, held: np.ndarray, components: Components) -> None:
        """Unites set i with every set of the tree that links with it. held: whether each rank is in set i.

        Sets with a common beginning share the overlap counted along it. A subtree is left out when its set sizes can't
        link, when the overlap so far and all that can follow stay below the least that any of its sets needs, or when
        all its sets are in the component of i already.
        """
        n, stack = self.sizes[i], [(self.root, 0, 0)]
        while stack:
            node, overlap, used = stack.pop()
            if PER * min(n, node.high) < LEAST * max(n, node.low if node.low > n else n) or PER * n < LEAST * node.low:
                continue
            if node.member >= 0 and components.find(node.member) == components.find(i):
                continue
            if len(node.segment):
                overlap += int(np.count_nonzero(held[node.segment]))
                used = int(np.searchsorted(ranks, node.segment[-1], "right"))
            if overlap + min(len(ranks) - used, node.longest) < least_overlap(n, node.low):
                continue
            for leaf in node.leaves:
                if links(overlap, n, self.sizes[leaf]):
                    components.union(i, leaf)
            own = [c for first, c in node.children.items() if held[first]]
            stack += [(c, overlap, used) for first, c in node.children.items() if not held[first]]
            stack += [(c, overlap, used) for c in own]  # last in, first out: those that share the next element


def join(sets: list[np.ndarray], sizes: list[int]) -> list[int]:
    """The component of each set, by its least member: sets (of hashes) link by their overlap and whole sizes.

    All sets are put in one order, elements that more sets have first, so that sets alike share long beginnings.
    """
    every, inverse, counts = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -counts))] = np.arange(len(every))
    ranked, at = rank[inverse], 0
    tree, components, held = PrefixTree(sizes), Components(len(sets)), np.zeros(len(every), bool)
    for i, s in enumerate(sets):
        ranks = np.sort(ranked[at : at + len(s)])
        at += len(s)
        held[ranks] = True
        tree.probe(i, ranks, held, components)
        tree.insert(i, ranks, components)
        held[ranks] = False
    return [components.find(i) for i in range(len(sets))]
