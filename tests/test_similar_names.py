"""Similar short sets against all pairs: sets of one word, ties, hot pairs of words; no pair is gathered."""

import itertools
import random

import pytest

from lodestar.operators import similarity
from lodestar.operators.similarity import similar_names
from lodestar.session import materialize


@pytest.mark.parametrize("least", [0.5, 0.6, 0.75, 0.8, 1.0])
def test_similar_names(spark, least):
    rng = random.Random(int(least * 100))
    sets = [(i, rng.choice("uv"), sorted(set(rng.choices([f"w{k}" for k in range(9)], k=rng.randint(0, 7))))) for i in range(80)]
    sets += [(100 + i, "u", ["hot", "word", f"n{i % 5}"]) for i in range(12)] + [(200, "u", None)]
    alike = lambda x, y: round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)
    want = sorted((p[1], p[0], q[0], alike(p[2], q[2])) for p, q in itertools.combinations([s for s in sets if s[2]], 2) if p[1] == q[1] and alike(p[2], q[2]) >= least)
    found = similar_names(spark.createDataFrame([(*s, -s[0]) for s in sets], "id long, bucket string, words array<string>, mark long"), least, ["mark"])
    got = found.collect()
    assert sorted((r.bucket, r.a, r.b, r.similarity) for r in got) == want
    assert all((r.x_mark, r.y_mark) == (-r.a, -r.b) for r in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan.split("Join")[0]  # a pair is neither gathered nor joined again


@pytest.mark.parametrize(("least", "across", "few"), [(0.5, None, 100), (0.6, "no", 0), (0.8, None, 0), (0.8, "no", 100), (1.0, None, 100)])
def test_similar_pairs_of_texts(spark, monkeypatch, least, across, few):
    written = {}
    monkeypatch.setattr(similarity, "materialize", lambda df, label: written.setdefault(label, materialize(df, label)))
    monkeypatch.setattr(similarity, "FEW", few)
    rng = random.Random(int(least * 100) + few)
    base = [rng.sample(range(400), rng.randint(1, 40)) for _ in range(12)]
    sets = []
    for i in range(150):
        own = set(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            own ^= {rng.randrange(400)}
        sets.append((i, rng.choice("uv"), [f"w{k}" for k in own] + ["common"], i % 3 == 0))
    sets += [(500, "u", [], True), (501, "u", None, False)]
    alike = lambda x, y: round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)
    want = sorted((p[0], q[0], alike(p[2], q[2])) for p, q in itertools.combinations([s for s in sets if s[2]], 2) if p[1] == q[1] and alike(p[2], q[2]) >= least and (not across or p[3] != q[3]))
    found = similarity.similar_pairs(spark.createDataFrame(sets, "id long, bucket string, words array<string>, no boolean"), least, across)
    assert sorted(tuple(r) for r in found.collect()) == want and want
    assert written["similar-maybe"].count() <= 1.2 * len(want) + 5  # all words are common, and yet little but true pairs is written
