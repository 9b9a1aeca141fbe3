"""Mentions, typed relations, walks and lineage against plain versions, with masks, ties, hubs, cycles and empty tables."""

import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestar.operators import lineage, mentions, relations, traversal


def plain_mentions(sources, targets):
    """By the rules: lines, masks of one length, occurrences from the left, word edges."""
    out = []
    for target, title, aliases in targets:
        names, seen = [], set()
        for n in [title, *(aliases or [])]:
            n = (n or "").strip(" ")
            if len(n) >= 2 and n.lower() not in seen:
                seen.add(n.lower())
                names.append(n)
        for source, text in sources:
            if source == target:
                continue
            body = text or ""
            for region in (r"\[\[[^\]\n]+\]\]", r"```[\s\S]*?```|`[^`]+`"):
                body = re.sub(region, lambda m: re.sub(r"[^\n]", " ", m[0]), body)
            for i, line in enumerate(body.split("\n")):
                for name in names or [str(target)]:
                    low, n, at, count = line.lower(), name.lower(), 0, 0
                    while (k := low.find(n, at)) >= 0:
                        edge = lambda c: not re.match(r"[^\W_]", c)
                        count += (k == 0 or edge(low[k - 1])) and (k + len(n) == len(low) or edge(low[k + len(n)]))
                        at = k + len(n)
                    if count:
                        out.append((source, target, i + 1, name, count))
    return sorted(out)


def test_mentions(spark):
    sources = [
        (1, "Red Fox and red fox, redfox; RED FOX!\nline two [[Red Fox]] `red fox` end\n```\nred fox\n\n```\nthen red fox"),
        (2, "a-a-a ba-a-a a-a\nC++ and c++; $5.0 (x) x(x)"), (3, None), (4, ""), (5, "foxes fox's été ÉTÉ x"), (6, "5 and 55 5"),
    ]
    targets = [(1, "Red Fox", ["fox", "FOX", "x"]), (9, " red fox ", None), (10, "a-a", ["C++", "$5.0 (x)"]), (5, None, None), (11, "été", [""]), (12, "++", [None])]
    s = spark.createDataFrame(sources, "source long, text string")
    t = spark.createDataFrame(targets, "target long, title string, aliases array<string>")
    got = sorted(tuple(r) for r in mentions.unlinked_mentions(s, t).collect())
    assert got == plain_mentions(sources, targets[:-1])  # a name without letter or digit isn't looked for
    assert len(got) == 9 and mentions.unlinked_mentions(s.limit(0), t).count() == 0 and mentions.unlinked_mentions(s, t.limit(0)).count() == 0


def test_mentions_of_random_words(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["ab", "abc", "b", "ab-c", "AB", "c"])
    sources = [(i, "".join(word() + rng.choice([" ", "\n", "-", ", ", "  "]) for _ in range(40))) for i in range(20)]
    targets = [(i, f"{word()} {word()}" if i % 2 else word(), [word(), word() + "-" + word()]) for i in range(15, 30)]
    got = mentions.unlinked_mentions(spark.createDataFrame(sources, "source long, text string"), spark.createDataFrame(targets, "target long, title string, aliases array<string>"))
    assert sorted(tuple(r) for r in got.collect()) == plain_mentions(sources, targets)


def test_mentions_shuffle_no_texts(spark, monkeypatch):
    rng = random.Random(3)
    sources = [(i, "".join(rng.choice(["ab", "the", "é", "ab-c", "İ"]) + rng.choice([" ", "\n", "-", ". "]) for _ in range(30))) for i in range(12)]
    targets = [(i, "the ab" if i % 3 else "ab", ["The", "é"]) for i in range(4, 20)]
    s, t = spark.createDataFrame(sources, "source long, text string"), spark.createDataFrame(targets, "target long, title string, aliases array<string>")
    for names, rows in ((50_000, 100_000), (5, 3)):
        monkeypatch.setattr(mentions, "NAMES", names)
        monkeypatch.setattr(mentions, "ROWS", rows)
        found = mentions.unlinked_mentions(s, t)
        assert sorted(tuple(r) for r in found.collect()) == plain_mentions(sources, targets)
        assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("Join", "Exchange"))


def test_relation_targets(spark):
    cases = {"[[b]]": "b", "[b]": "b", '"[[c]]"': "c", " d ": "d", "'[x|y]'": "x", "[[a/b#h|t]]": "a/b", '[["q"]]': "q", "": None, "[[]]": None, "#top": None, "[": "[", '"': '"', "[[a]": "[a", None: None}
    frame = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", relations.relation_target(F.col("raw")).alias("t"))
    assert {r.raw: r.t for r in frame.collect()} == cases


def test_relation_rungs(spark):
    notes = [(1, "a.md"), (2, "x/b.md"), (3, "y/b.md"), (4, "x/c.md"), (5, "deep/x/d.md"), (6, "a"), (7, "a.md"), (8, "x/e.txt"), (9, None), (10, "c.md")]
    fields = [(100, {"Related": ["a", "b", "x/b"], "superseded by": ["[[c]]", "x/d", "d"], "tags": ["a"], "extends": [None, "", "deep/x/d.md", "e", "nowhere"]}), (101, None), (102, {"related": None})]
    n = spark.createDataFrame(notes, "doc long, path string")
    edges = relations.relation_edges(spark.createDataFrame(fields, "source long, fields map<string, array<string>>"))
    got = {(r.relation, r.target): (r.doc, r.state) for r in relations.resolve_edges(edges, n).collect()}
    assert got == {
        ("related", "a"): (6, "path"), ("related", "b"): (None, "ambiguous"), ("related", "x/b"): (2, "file"), ("superseded_by", "c"): (10, "file"), ("superseded_by", "x/d"): (5, "suffix"),
        ("superseded_by", "d"): (5, "suffix"), ("extends", "deep/x/d.md"): (5, "path"), ("extends", "e"): (None, "dangling"), ("extends", "nowhere"): (None, "dangling"),
    }
    leaf = {r.target: r.state for r in relations.resolve_edges(edges, n, leaf_only=True).collect()}
    assert leaf["x/d"] == "dangling" and leaf["d"] == "suffix"
    assert relations.resolve_edges(edges, n.limit(0)).where("state <> 'dangling'").count() == 0


def plain_walk(hits, links, hops, decay, per_hit, seeds):
    out = {}
    for q in {h[0] for h in hits}:
        page = sorted((h for h in hits if h[0] == q), key=lambda h: h[3])
        present, added = {h[1] for h in page}, {}
        queue = deque((h[1], 0, h[2]) for h in page[:seeds])
        while queue:
            doc, hop, score = queue.popleft()
            taken = 0
            for t in sorted({b for a, b in links if a == doc and b != doc}) if hop < hops else ():
                if taken >= per_hit:
                    break
                if t in present or (t in added and added[t][0] >= score * decay):
                    continue
                taken += 1
                added[t] = (score * decay, hop + 1, doc)
                queue.append((t, hop + 1, score * decay))
        out |= {(q, h[1]): (round(h[2], 6), 0, None) for h in page} | {(q, d): (round(s, 6), h, o) for d, (s, h, o) in added.items()}
    return out


@pytest.mark.parametrize(("hops", "decay", "per_hit", "seeds"), [(0, 0.5, 3, 10), (1, 0.5, 2, 3), (2, 0.5, 2, 10), (3, 0.9, 3, 2), (2, 1.0, 1, 10), (1, 0.5, 0, 10)])
def test_walks(spark, hops, decay, per_hit, seeds):
    rng = random.Random(hops * 7 + per_hit)
    hits = [(q, d, round(1 / (r + 1) * rng.choice([1.0, 0.9]), 3), r + 1) for q in range(4) for r, d in enumerate(rng.sample(range(40), rng.randint(1, 6)))]
    hits = [(q, d, s, r) for q in range(4) for r, (_, d, s, _) in enumerate(sorted((h for h in hits if h[0] == q), key=lambda h: -h[2]), 1)]
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)] + [(3, d) for d in range(200)]
    frame = traversal.expand(spark.createDataFrame(hits, "query long, doc long, score double, rank long"), spark.createDataFrame(links, "source long, target long"), hops, decay, per_hit, seeds)
    assert {(r.query, r.doc): (r.score, r.hop, r.origin) for r in frame.collect()} == plain_walk(hits, links, hops, decay, per_hit, seeds)


def test_walks_of_nothing(spark):
    hits = spark.createDataFrame([], "query long, doc long, score double, rank long")
    assert traversal.expand(hits, spark.createDataFrame([(1, 2)], "source long, target long")).count() == 0
    with pytest.raises(ValueError):
        traversal.expand(hits, hits, decay=0.0)


def test_bridge(spark):
    day = 86400.0
    rows = [(1, 0, 0.5, None, 10 * day, 20 * day), (2, 1, 0.5, 15 * day, 10 * day, 20 * day), (3, 1, 0.8, 6 * day, 10 * day, 20 * day), (4, 1, 0.5, 2 * day, 10 * day, None), (5, 2, 0.5, None, 10 * day, None), (6, 1, 0.5, day, None, None)]
    got = traversal.bridge(spark.createDataFrame(rows, "doc long, hop long, score double, event double, since double, until double"))
    assert {r.doc: r.score for r in got.collect()} == {1: 0.5, 2: 0.5, 3: 0.4, 6: 0.5}


def test_typed_fanout(spark):
    edges = [(1, "a", 2), (1, "b", 2), (2, "a", 3), (2, "a", 1), (3, "a", 2), (1, "c", None), (3, "a", 4), (5, "a", 6), (6, "b", 5)]
    e = spark.createDataFrame(edges, "source long, relation string, doc long")
    s = spark.createDataFrame([(7, 1), (7, 1), (8, 5), (9, 99)], "query long, doc long")
    got = {(r.query, r.doc): (r.hops, r.edges, r.via, r.score) for r in traversal.typed_fanout(s, e).collect()}
    assert got == {(7, 2): (1, 2, ["a", "b"], 1.1), (7, 3): (2, 1, ["a"], 0.55), (8, 6): (1, 1, ["a"], 1.05)}
    assert set((r.query, r.doc) for r in traversal.typed_fanout(s, e, relations=["b"]).collect()) == {(7, 2)}
    deep = {(r.query, r.doc): r.edges for r in traversal.typed_fanout(s, e, depth=3).collect()}
    assert deep == {(7, 2): 3, (7, 3): 1, (7, 4): 1, (8, 6): 1}


def test_typed_fanout_deals_out_once(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.choice("abc"), rng.choice([*range(30), None])) for _ in range(120)]
    seeds = [(q, rng.randrange(30)) for q in range(6) for _ in range(2)]
    for depth in (1, 2, 3):
        want = {}
        for q in {q for q, _ in seeds}:
            start = {d for x, d in seeds if x == q}
            reached, front, out = set(start), start, {}
            for hop in range(1, depth + 1):
                steps = [(r, d) for f in front for s, r, d in edges if s == f and d is not None and d not in start]
                for r, d in steps:
                    h, n, via = out.get(d, (hop, 0, set()))
                    out[d] = (h, n + 1, via | {r})
                front = {d for _, d in steps} - reached
                reached |= front
            want |= {(q, d): (h, n, sorted(via)) for d, (h, n, via) in out.items()}
        found = traversal.typed_fanout(spark.createDataFrame(seeds, "query long, doc long"), spark.createDataFrame(edges, "source long, relation string, doc long"), depth)
        assert {(r.query, r.doc): (r.hops, r.edges, r.via) for r in found.collect()} == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1  # the last step meets the edges; what it finds is joined with nothing


def test_lineage(spark):
    rows = [("a", "b", "reply", 0), ("a", "b", "copy", 1), ("a", "c", "copy", 2), ("b", "d", "reply", 0), ("c", "d", "reply", 0), ("d", "e", "reply", 0), ("e", "f", "reply", 0), ("a", "a", "self", 3), ("x", "y", "r", 0), ("y", "x", "r", 0), ("z", "x", "r", 0), ("w", None, "r", 0)]
    parents = spark.createDataFrame(rows, "child string, parent string, relation string, pos int")
    starts = spark.createDataFrame([("a",), ("z",), ("alone",), ("a",)], "start string")
    nodes, edges, summary = lineage.trace(parents, starts, 3)
    assert {(r.start, r.node): r.depth for r in nodes.collect()} == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("a", "e"): 3, ("z", "z"): 0, ("z", "x"): 1, ("z", "y"): 2, ("alone", "alone"): 0}
    assert sorted(tuple(r) for r in edges.where("start = 'a'").collect()) == [("a", "a", "b", "reply"), ("a", "a", "c", "copy"), ("a", "b", "d", "reply"), ("a", "c", "d", "reply"), ("a", "d", "e", "reply")]
    assert {r.start: (r.nodes, r.edges, r.depth, r.truncated) for r in summary.collect()} == {"a": (5, 5, 3, True), "z": (3, 3, 2, False), "alone": (1, 0, 0, False)}
    assert {r.node for r in lineage.origins(lineage.trace(parents, starts, 8)[0], parents).collect()} == {"f", "alone"}
    assert {r.node for r in lineage.cyclic_core(parents).collect()} == {"a", "x", "y"}
    assert lineage.cyclic_core(parents.where("child IN ('b', 'd')")).count() == 0
    assert lineage.trace(parents.limit(0), starts.limit(0))[2].count() == 0
