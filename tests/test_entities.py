"""Entity keys, alias candidates and guarded merges: quotes, ties, chains between identities, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import entities


def test_keys_and_chains(spark):
    rows = [(["  Ada\t Lovelace ", "ADA LOVELACE", "O’Neil", "O'Neil", "", None, "ʼX"],), (None,), ([],)]
    got = [r.c for r in spark.createDataFrame(rows, "n array<string>").select(entities.evolution_chain(F.col("n")).alias("c")).collect()]
    assert got == [["  Ada\t Lovelace ", "O’Neil", "ʼX"], None, []]
    assert spark.range(1).select(entities.entity_key(F.lit(" «A  B» ‘c’"))).first()[0] == "'a b' 'c'"


def test_alias_candidates(spark):
    rows = [
        (1, "people", "Ada King Lovelace", None, "active"), (2, "people", "King Ada Lovelace jr", ["x"], "active"), (3, "people", "ada  king lovelace", [], "active"), (4, "org", "Ada King Lovelace", None, "active"),
        (5, "people", "Ada King Lovelace", None, "archived"), (6, "people", "Lovelace King Ada", ["King Ada  Lovelace JR"], "active"), (7, None, "Ada King Lovelace Co", None, "active"), (8, None, "Ada King Lovelace", None, "active"), (9, "people", None, None, "active"),
    ]
    frame = spark.createDataFrame(rows, "id long, category string, name string, aliases array<string>, status string")
    got = sorted((r.category, r.a, r.b, r.similarity) for r in entities.alias_candidates(frame, 0.7).collect())
    assert got == [("", 7, 8, 0.75), ("people", 1, 2, 0.75), ("people", 1, 6, 1.0), ("people", 2, 3, 0.75), ("people", 3, 6, 1.0)]
    assert entities.alias_candidates(frame.limit(0)).count() == 0


def plain_merge(links, identities):
    near = {}
    for a, b, s in links:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})[y] = max(s, near.get(x, {}).get(y, 0))
    root, held, divided = {}, {}, {}
    for start in sorted(near):
        if start not in root:
            todo, part = [start], {start}
            while todo:
                for y in near[todo.pop()]:
                    if y not in part:
                        part.add(y)
                        todo.append(y)
            kinds = {identities[x] for x in part if identities.get(x) is not None}
            for x in part:
                root[x], divided[x] = start, len(kinds) > 1
                held[x] = next(iter(kinds)) if len(kinds) == 1 else identities.get(x)
    while True:
        new = {x: held[max(ys, key=lambda y: (near[x][y], -y))] for x in near if held[x] is None and divided[x] and (ys := [y for y in near[x] if held[y] is not None])}
        if not new:
            break
        held |= new
    group = {}
    for x in sorted(near):
        group.setdefault((root[x], held[x]), x)
    cut = {(min(a, b), max(a, b)) for a in near for b in near[a] if held[a] is not None and held[b] is not None and held[a] != held[b]}
    return {x: (group[root[x], held[x]], held[x], divided[x]) for x in near}, cut


def test_merges(spark):
    rng = random.Random(4)
    for links, identities in [
        ([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.9), (5, 6, 1.0), (7, 8, 0.5), (8, 8, 1.0), (2, 1, 0.95)], {1: "A", 4: "B", 5: "C", 9: "D"}),
        ([(rng.randrange(60), rng.randrange(60), rng.choice([0.6, 0.7, 0.8])) for _ in range(70)], {i: rng.choice("AB") for i in range(0, 60, 7)}),
    ]:
        frame = spark.createDataFrame(links, "a long, b long, similarity double")
        groups, conflicts = entities.merge_groups(frame, spark.createDataFrame(list(identities.items()) + [(2, None)], "id long, identity string"))
        want, cut = plain_merge(links, identities)
        assert {r.id: (r.group, r.identity, r.divided) for r in groups.collect()} == want
        assert {(r.a, r.b) for r in conflicts.collect()} == cut
    assert entities.merge_groups(frame.limit(0), spark.createDataFrame([], "id long, identity string"))[0].count() == 0
    with pytest.raises(ValueError):
        entities.merge_groups(frame, spark.createDataFrame([(1, "A"), (1, "B")], "id long, identity string"))


def test_merges_of_aliases(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, rng.choice(["p", "q"]), f"{rng.choice(['red', 'hot'])} {rng.choice(['ring', 'bolt', 'nut'])} {rng.choice(['big', 'wee'])} size {rng.randint(10, 14)}", None, "active", rng.choice(["A", "B"]) if i % 5 == 0 else None) for i in range(90)]
    rows += [(100 + i, "chain", " ".join(f"w{k}" for k in range(3 * i, 3 * i + 12)), None, "active", {0: "A", 7: "B"}.get(i)) for i in range(8)]  # identities take several rounds here
    frame = spark.createDataFrame(rows, "id long, category string, name string, aliases array<string>, status string, identity string")
    links = [(r.a, r.b, r.similarity) for r in entities.alias_candidates(frame, 0.6).collect()]
    want, cut = plain_merge(links, {r[0]: r[5] for r in rows})
    for few in (100_000, 0):
        monkeypatch.setattr(entities, "FEW", few)
        groups = entities.merged_entities(frame, 0.6)
        assert {r.id: (r.group, r.identity, r.divided) for r in groups.collect()} == want
        refused = entities.refused_aliases(frame, groups, 0.6)
        assert {(r.a, r.b) for r in refused.collect()} == cut and len(cut) > 5
    assert refused._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0].count("Join") == 0  # no link is joined again
