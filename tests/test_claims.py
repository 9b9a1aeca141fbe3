"""Claims: keys, chains with cycles and links to nothing, contests, validity, against a plain walk."""

import random

from pyspark.sql import functions as F

from lodestar.operators import claims


def plain(nexts):
    out = {}
    for start in nexts:
        seen, at = [start], start
        while True:
            if at not in nexts:
                out[start] = (at, len(seen) - 1, False, False)
            elif nexts[at] is None:
                out[start] = (at, len(seen) - 1, False, True)
            elif nexts[at] in seen:
                out[start] = (at, len(seen) - 1, True, True)
            else:
                at = nexts[at]
                seen.append(at)
                continue
            break
    return out


def test_successors(spark):
    rng = random.Random(11)
    cases = [{"a": "b", "b": "c", "c": None, "d": "x", "e": "e", "f": "g", "g": "h", "h": "g", "i": "f", "j": "i"}, {"a": None}, {"a": "b", "b": "a"}]
    cases += [{f"n{i}": rng.choice([None, *(f"n{rng.randrange(44)}" for _ in range(9))]) for i in range(40)} for _ in range(3)]
    for nexts in cases:
        frame = spark.createDataFrame(list(nexts.items()) + [(None, "a")], "id string, superseded_by string")
        got = {r.id: (r.tip, r.steps, r.cycle, r.resolved) for r in claims.replaced_by(frame).collect()}
        assert got == plain(nexts)
    assert claims.replaced_by(frame.limit(0)).count() == 0


def test_keys_contests_and_truth(spark):
    links = {"[[a/b/C.md|shown]]": "C", " x.MD ": "x", "[[d]]": "d", "e\\f": "f", "": None, "[[|]]": None, None: None, "g|h/i": "g"}
    got = spark.createDataFrame([(k,) for k in links], "t string").select("t", claims.claim_key(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == links
    rows = [("a", ["b", "a", "zz", None, "b"]), ("b", None), ("c", ["a"]), (None, ["a"]), ("d", [])]
    pairs = {tuple(r) for r in claims.contested_by(spark.createDataFrame(rows, "id string, contradicts array<string>")).collect()}
    assert pairs == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}
    dated = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', false), ('b', NULL, TIMESTAMP '2024-01-15', NULL), ('c', TIMESTAMP '2024-01-15', NULL, false), ('d', NULL, NULL, true) AS t(id, valid_from, valid_until, tombstoned)")
    assert {r.id for r in claims.true_at(dated, "2024-01-15").collect()} == {"a", "c"}
