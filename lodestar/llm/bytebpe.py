"""Byte-level BPE encoding and decoding: speculate and verify.

A word's tokens are proposed greedily, the longest match at each place. If every adjacent pair of them is compatible (the
two tokens' text is encoded as these two), the proposal is the word's exact encoding; all distinct pairs are tested as
arrays. Only words with an incompatible pair are merged by rank.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.chunktable import _SHOWN, _path
from lodestar.llm.columns import map_column, quoted

MODEL = "byte_bpe_50k.json"
#: Rounds in which all words take their next token together; what is longer goes on alone.
TOGETHER = 64
#: Words of at most so many bytes whose merges are remembered, and how many of them.
SHORT, REMEMBERED = 64, 1 << 17
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: What may follow an apostrophe at the begin of a word as a word of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_NEVER = np.int64(1 << 40)
_OPENED: dict[str, ByteBpe] = {}


class ByteBpe:
    """A byte-level BPE of a tokenizers file, with its pieces, merges and added tokens."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(_path(name))
        about = json.loads(self.library.to_str())
        model, cut = about["model"], about["pre_tokenizer"] or {}
        added = about["added_tokens"]
        plain_model = model["type"] == "BPE" and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain_cut = cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut["use_regex"]
        if not plain_model or not plain_cut or about["normalizer"] or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("the tokenizer isn't a plain byte-level one")
        byte_of = {ord(c): b for b, c in enumerate(_SHOWN)}
        vocab = model["vocab"]
        self.added = {x["content"]: x["id"] for x in added}
        self.split_added = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for piece, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[ord(c)] for c in piece)
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.flat, self.ends = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(lengths)
        self.single = np.zeros(256, np.int64)
        self.size, self.rank, self.parts = size, np.full(size, -1, np.int64), np.full((size, 2), -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for b, c in enumerate(_SHOWN):
            self.single[b] = vocab[c]
        for r, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[x], vocab[y], vocab[x + y]
            if self.rank[whole] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError("a piece has two merges, or is used before it is made")
            self.merges[a, b] = r, whole
            self.rank[whole], self.parts[whole] = r, (a, b)
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(ranks[order], _NEVER)
        self._merged_short = functools.lru_cache(REMEMBERED)(self._merged)
        self._grow_trie(vocab)
        self.classes = _classes()

    def _grow_trie(self, vocab: dict[str, int]) -> None:
        """Edges (node, byte) -> node as sorted arrays. A piece that its own text isn't encoded as can't be proposed."""
        own = {i: self.bytes_of[i] for i in vocab.values() if i not in self.added.values()}
        made = [i for i in own if self.parts[i, 0] >= 0]
        sound = set(np.array(made)[self.compatible(self.parts[made, 0], self.parts[made, 1], self.rank[made])].tolist()) if made else set()
        edges: dict[tuple[int, int], int] = {}
        token = [-1]
        for i, text in own.items():
            if len(text) > 1 and i not in sound:
                continue
            node = 0
            for b in text:
                node = edges.setdefault((node, b), len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        keys = np.array([node * 256 + b for node, b in edges], np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.fromiter(edges.values(), np.int64)[order], -1)
        self.token_at = np.array(token, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the text of each pair of pieces is encoded as these two, or stays so until the merge of rank `until`.

        Merges are undone at the border, the latest first. Two pieces that meet there at some time would merge if their
        rank came before the merge that took the left one away, or not after the one that took the right one away (of two
        equal merges the left one comes first).
        """
        a, b = a.copy(), b.copy()
        left_until = np.full(len(a), _NEVER) if until is None else until.copy()
        right_until = left_until.copy() if until is None else until - 1
        held, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.searchsorted(self.pair_keys, key)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)
            clash = (rank < left_until[live]) & (rank <= right_until[live]) & (rank < _NEVER)
            held[live[clash]] = False
            live = live[~clash & ((self.rank[x] >= 0) | (self.rank[y] >= 0))]
            x, y = a[live], b[live]
            is_left = self.rank[x] > self.rank[y]
            # Equal pieces: both were made by the same merge, the left one first, so the right one is undone first.
            l, r = live[is_left], live[~is_left]
            left_until[l], a[l] = self.rank[a[l]], self.parts[a[l], 1]
            right_until[r], b[r] = self.rank[b[r]], self.parts[b[r], 0]
        return held

    def propose(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words that end at `ends` of data, by the longest match at each place."""
        starts = np.concatenate([[0], ends[:-1]])
        stop = np.repeat(ends, ends - starts)
        size, token = np.ones(len(data), np.int64), self.single[data]
        live, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(live):  # all places at once, one byte further each time
            key = node * 256 + data[live + depth]
            at = np.searchsorted(self.edge_keys, key)
            node = np.where(self.edge_keys[at] == key, self.edge_to[at], -1)
            on = node >= 0
            live, node = live[on], node[on]
            depth += 1
            whole = self.token_at[node]
            size[live[whole >= 0]], token[live[whole >= 0]] = depth, whole[whole >= 0]
            on = live + depth < stop[live]
            live, node = live[on], node[on]
        begins = np.zeros(len(data), bool)
        place = starts[starts < ends]
        for _ in range(TOGETHER):
            begins[place] = True
            place = place + size[place]
            place = place[place < stop[place - 1]] if len(place) else place
            if not len(place):
                break
        for p in place.tolist():
            end = int(stop[p])
            steps = size[p:end].tolist()
            q = p
            while q < end:
                begins[q] = True
                q += steps[q - p]
        before = np.concatenate([[0], np.cumsum(begins)])
        return token[begins], before[ends] - before[starts]

    def _merged(self, word: bytes) -> list[int]:
        """The exact encoding: the pair of the least rank is merged first, of equal ones the leftmost."""
        ids: list[int] = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = self.merges[x, y][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, number of ids of each word, number of words that were merged)."""
        ids, counts = self.propose(data, ends)
        word = np.repeat(np.arange(len(ends)), counts)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, place = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        failing = np.unique(word[inner[~good[place]]])
        if not len(failing):
            return ids, counts, 0
        raw, starts = data.tobytes(), np.concatenate([[0], ends[:-1]])
        exact = [self._merged_short(w) if len(w) <= SHORT else self._merged(w) for s, e in zip(starts[failing].tolist(), ends[failing].tolist(), strict=True) for w in (raw[s:e],)]
        fails = np.zeros(len(ends), bool)
        fails[failing] = True
        more = np.array([len(x) for x in exact], np.int64)
        total = counts.copy()
        total[failing] = more
        out, own = np.empty(int(total.sum()), np.int64), np.repeat(fails, total)
        out[~own] = ids[~fails[word]]
        out[own] = np.fromiter((i for x in exact for i in x), np.int64, int(more.sum()))
        return out, total, len(failing)

    def cuts(self, text: str, data: np.ndarray, joints: np.ndarray) -> np.ndarray:
        """Where words end, in bytes. text is data decoded; joints: the bytes where a part of it that is cut by itself ends."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
        kind = self.classes[points]
        n = len(points)
        fresh = np.zeros(n + 1, bool)  # characters that begin a part
        fresh[np.searchsorted(at, joints)] = True
        fresh[0] = True
        before = np.where(fresh[:n], -1, np.concatenate([[-1], kind[:-1]]))  # the class of the character before
        starts = before != kind
        white = kind == SPACE
        # The last of several white characters stands apart from those before it if something follows; a space leads it.
        ahead = np.where(fresh[1:], SPACE, np.concatenate([kind[1:], [SPACE]]))
        last = white & (ahead != SPACE)
        starts |= last
        led = np.concatenate([[False], (last & (points == 32))[:-1]]) & ~fresh[:n]
        starts &= ~led
        # An apostrophe that begins a word, and the letters of a contraction after it.
        for i in np.flatnonzero((points == 39) & starts & ~led & (before != OTHER)).tolist():
            for tail in CONTRACTIONS:
                end = i + 1 + len(tail)
                if text.startswith(tail, i + 1) and not fresh[i + 1 : end].any():
                    starts[i + 1 : end] = False
                    if end < n:
                        starts[end] = True if kind[end] != SPACE else starts[end]
                    break
        return np.append(at, len(data))[np.append(np.flatnonzero(starts)[1:], n)] if n else np.empty(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, number of ids of each text); a null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        raw = data.tobytes()
        special = self._specials(raw, bounds)
        joints = np.unique(np.concatenate([bounds, special[:, 0], special[:, 1]]))
        ends = self.cuts(raw.decode(), data, joints)
        if len(special):  # an added token is one word, however it would be cut
            inner = np.searchsorted(special[:, 0], ends, "left") - 1
            ends = ends[(inner < 0) | (ends >= special[inner, 1])]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        distinct, at = coded.dictionary, np.asarray(coded.indices, np.int64)
        own_ends = np.frombuffer(distinct.buffers()[1], np.int64)[1 : len(distinct) + 1]
        ids, counts, _ = self.words(np.frombuffer(distinct.buffers()[2], np.uint8)[: own_ends[-1]], own_ends)
        starts, many = (np.cumsum(counts) - counts)[at], counts[at]
        if len(special):
            added = np.searchsorted(ends, special[:, 1])
            ids, starts[added], many[added] = np.concatenate([ids, special[:, 2]]), len(ids) + np.arange(len(special)), 1
        done = np.cumsum(many)
        flat = ids[np.repeat(starts - (done - many), many) + np.arange(int(done[-1]))]
        before = np.concatenate([[0], done])[np.searchsorted(ends, bounds, "right")]
        return flat, np.diff(before)

    def _specials(self, raw: bytes, bounds: np.ndarray) -> np.ndarray:
        """(start, end, id) in bytes of every added token's string within a text, the leftmost first."""
        none = np.empty((0, 3), np.int64)
        if self.split_added is None or not any(x.encode() in raw for x in self.added):
            return none
        found = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            text = raw[s:e]
            if any(x.encode() in text for x in self.added):
                found += [(s + m.start(), s + m.end(), self.added[m[0].decode()]) for m in re.finditer(self.split_added.pattern.encode(), text)]
        return np.array(found, np.int64) if found else none

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of ids; bytes that aren't UTF-8 become U+FFFD."""
        sizes = self.ends[ids] - np.concatenate([[0], self.ends])[ids]
        done = np.cumsum(sizes)
        data = self.flat[np.repeat(self.ends[ids] - done, sizes) + np.arange(int(done[-1]) if len(done) else 0)]
        offsets = np.concatenate([[0], done])[np.concatenate([[0], np.cumsum(counts)])]
        texts = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            texts.validate(full=True)
            return texts
        except pa.ArrowInvalid:
            raw = data.tobytes()
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.large_string())


def _classes() -> np.ndarray:
    """The class of each code point, as the library's own patterns have it; planes from 4 on have no letters, numbers or spaces."""
    from tokenizers import Regex, pre_tokenizers

    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))
    out = np.full(0x110000, OTHER, np.int8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(whole):
            for x, y in ((min(a, 0xD800), min(b, 0xD800)), (max(a, 0xD800) + 0x800, max(b, 0xD800) + 0x800)):
                if y > x:
                    out[x:y] = kind
    return out


def open_bpe(name: str) -> ByteBpe:
    """A file's encoder, one a worker."""
    if name not in _OPENED:
        _OPENED[name] = ByteBpe(name)
    return _OPENED[name]


def encode_bytes(docs: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids", decoded: str = "decoded", count: str = "n_tokens") -> DataFrame:
    """docs with the ids of every whole text as little-endian unsigned 32-bit integers (binary), their number, and the text decoded from these ids.

    The ids are those of the tokenizers library without special tokens of its own; an added token's string in a text
    becomes that token. A null or empty text has no ids and decodes to an empty text; equal texts have equal ids. All
    other columns stay; one named as an output is replaced. No rows give none. Texts are taken in slices of some megabytes,
    a longer one alone; a text must fit a task's memory as arrays of its characters, some fifty times over.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        bpe = open_bpe(model)
        flat, counts = bpe.encode(texts)
        ends = np.concatenate([[0], 4 * np.cumsum(counts)])
        packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat.astype("<u4"))])
        return [packed.cast(pa.binary()), bpe.decode(flat, counts).cast(pa.string()), pa.array(counts)]

    added = [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType()), T.StructField(count, T.LongType())]
    return map_column(docs, quoted(text), added, run)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: number of ids, ids and decoded text as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_bytes(docs).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
