"""Operators on small tables."""

import json
import math

import pandas as pd
import parity
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import components, graph
from lodestar.operators.chunking import chunks
from lodestar.operators.ranking import mmr
from lodestar.plans.evidence import trigram_term_candidates
from lodestar.plans.graph import supersede_tips
from lodestar.plans.health import duplicate_documents, near_dup_turns, note_contradictions, similar_pairs, turn_classes, turn_contradictions
from lodestar.plans.retrieval import near_vector_groups
from lodestar.registry import ORACLES
from lodestar.session import materialize
from lodestar.sources import sinks, vault
from lodestar.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scalars(spark):
    assert one(spark, S.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, S.wilson_lower(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, S.weibull_recency(F.lit(100000.0))) == 0.0
    assert one(spark, S.token_count(F.lit(" a\tb \n c"))) == 3
    assert one(spark, S.token_estimate(F.lit("é" * 3))) == 2
    assert one(spark, S.basename(F.lit("a/b/Note.md"))) == "Note"
    assert one(spark, S.half_life(F.lit(1.0), F.lit(60.0), 60)) == pytest.approx(0.5)
    assert one(spark, S.significant_terms(F.lit("The the cat is on a Mat."))) == ["the", "cat", "mat"]


def test_chunks():
    text = "# A\n\n" + "\n\n".join(f"para {i} " + "w " * 60 for i in range(5)) + "\n\n## B\n\nlast\n\n```\ncode\n"
    found = chunks(text, most=150, least=50, overlap=10)
    assert found[0][2] == "A" and found[-1][2] == "A > B"
    assert "code" in found[-1][3]
    assert all(b[0] <= a[1] + 3 for a, b in zip(found, found[1:], strict=False))
    assert chunks("") == []


def test_mmr_prefers_diverse_rows():
    pool = pd.DataFrame({"doc": [1, 2, 3], "score": [1.0, 0.99, 0.7], "words": [["a", "b"], ["a", "b"], ["c"]]})
    assert mmr(pool, 2)["doc"].tolist() == [1, 3]


def test_similar_pairs_are_exact(spark):
    sets = [["a", "b", "c", "d", "e"], ["a", "b", "c", "d"], ["a", "b", "x"], ["a", "b", "c", "d", "e"], []]
    rows = spark.createDataFrame([(i, "k", s) for i, s in enumerate(sets)], "id long, bucket string, words array<string>")
    assert sorted((r.a, r.b) for r in similar_pairs(rows, 0.8).collect()) == [(0, 1), (0, 3), (1, 3)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")], "u string, v string")
    reach = {(r.node, r.hop) for r in graph.fan_out(graph.undirected(edges), spark.createDataFrame([("a",)], "seed string"), 2).collect()}
    assert reach == {("a", 0), ("b", 1), ("c", 2)}
    tips = {r.node: (r.tip, r.hops) for r in graph.chain_tips(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "node long, next long"), 3).collect()}
    assert tips == {1: (4, 3), 2: (4, 2), 3: (4, 1), 4: (4, 0)}


def test_chains_are_followed_to_their_ends(spark, tmp_path):
    n = 5000  # longer than 2^12 links
    spark.range(n).selectExpr("id AS doc_id", "'same' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.node: (r.tip, r.hops) for r in supersede_tips(spark, str(tmp_path)).collect()}
    assert found == {i: (n - 1, n - 1 - i) for i in range(n)}
    with pytest.raises(ValueError):
        graph.chain_tips(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, next long"))


def test_near_vectors_of_any_ids_are_grouped(spark):
    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    rows = [(1, at(0)), (2, at(10)), (3, at(20)), (7, at(60)), (8, at(60)), (51, at(120)), (99, at(200))]  # cos 10 degrees is .985, cos 20 is .94
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 51: 51, 99: 99}
    for block in (2000, 2):
        assert {r.vec_id: r.group for r in near_vector_groups(table, block).collect()} == want


def test_duplicates_and_trigrams_use_whole_texts(spark, tmp_path):
    head = "one opening that is longer than forty characters, "
    docs = [(1, None, head + "a"), (2, None, head + "b"), (3, None, head + " A"), (4, "en", head + "a")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in duplicate_documents(spark, str(tmp_path)).collect()] == [(1, 2)]
    spark.createDataFrame([(1, "the beginning and then zebra"), (2, "zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(1, 150, "a zebra"), (2, 50, "zebr")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = sorted((r["query"], r.conv_id, r.turn, r.shared, r["rank"]) for r in trigram_term_candidates(spark, str(tmp_path)).collect())
    assert found == [(1, 1, 150, 3, 1), (1, 2, 50, 2, 2), (2, 1, 150, 3, 1), (2, 2, 50, 2, 2)]


def test_turns_of_long_conversations_stay_apart(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(20))
    turns = [(1, 150, "user", words), (2, 50, "user", "other text"), (3, 1, "user", words), (4, 1, "user", words + " not"), (4, 2, "user", words + " more")]  # 1 * 100 + 150 is 2 * 100 + 50
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    near = {tuple(r)[:4] for r in near_dup_turns(spark, str(tmp_path)).collect()}
    assert near == {(1, 150, 4, 1), (1, 150, 4, 2), (4, 1, 4, 2)}
    against = {tuple(r)[:4] for r in turn_contradictions(spark, str(tmp_path)).collect()}
    assert against == {(1, 150, 4, 1), (4, 1, 4, 2)}
    members = {(r.conv_id, r.turn): (r.rep_conv, r.rep_turn, r.members) for r in turn_classes(spark, str(tmp_path)).collect()}
    assert members == {(1, 150): (1, 150, 2), (3, 1): (1, 150, 2), (2, 50): (2, 50, 1), (4, 1): (4, 1, 1), (4, 2): (4, 2, 1)}


def test_contradictions_keep_their_pairs_and_copies(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(20))
    turns = [(1, 150, "user", words), (2, 1, "user", words), (2, 50, None, words), (3, 1, "user", words + " not"), (3, 2, "user", words + " not"), (3, 3, "user", words + " extra"), (4, None, None, words + " no")]
    turns += [(5, 1, "both", words), (5, 1, "both", words + " pas"), (6, 1, "user", "alone not"), (7, 1, "user", None), (2, 1, "user", words)]  # two texts at one place; a row twice
    pq.write_table(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").toArrow(), f"{tmp_path}/conversations.parquet")
    found = [tuple(r) for r in note_contradictions(spark, str(tmp_path)).collect()]
    pairs = sorted((r[:5] for r in found if r[0] == "pair"), key=str)
    assert pairs == [("pair", 1, 150, 3, 1), ("pair", 2, 50, 4, None), ("pair", 3, 1, 3, 3), ("pair", 5, 1, 5, 1)]
    members = sorted((r[1:5] for r in found if r[0] == "member"), key=str)
    assert members == sorted([(1, 150, 1, 150), (1, 150, 2, 1), (1, 150, 2, 1), (2, 50, 2, 50), (3, 1, 3, 1), (3, 1, 3, 2), (3, 3, 3, 3), (4, None, 4, None), (5, 1, 5, 1), (5, 1, 5, 1)], key=str)
    assert parity.compare(spark, parity.duck(str(tmp_path)), "", note_contradictions, ORACLES["note_contradictions"], str(tmp_path)) == ""


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_by_tasks_and_by_rounds(spark, monkeypatch, kind):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    path = [(i, i + 1) for i in range(0, 60)]
    edges = [(b, a) if a % 3 else (a, b) for a, b in path] + [(100, 101), (103, 101), (103, 103), (102, 103), (200, 200), (None, 5), (300, 1000), (1000, 300)]
    of = (lambda x: x) if kind == "long" else (lambda x: None if x is None else f"é{x}")
    want = {of(i): min(of(j) for j in range(61)) for i in range(61)} | {of(i): of(100) for i in range(100, 104)} | {of(i): min(of(300), of(1000)) for i in (300, 1000)}
    table = spark.createDataFrame([(of(u), of(v)) for u, v in edges], f"u {kind}, v {kind}")
    got = [tuple(r) for r in components.connect(table).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert len(written) == 2  # few edges: written once, united once
    got = [tuple(r) for r in components.connect(table.repartition(5), at_once=3).collect()]
    assert dict(got) == want and len(got) == len(want) and len(written) > 5
    assert components.connect(table.limit(0)).count() == 0


def test_pages_and_logs(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text('---\ntitle: "A b"\ntags: [x, y]\n---\n# Body\n')
    (tmp_path / "n/b.md").write_text("no header")
    rows = {r.path.rsplit("/", 1)[1]: r for r in vault.pages(spark, str(tmp_path / "n")).collect()}
    assert rows["a.md"].frontmatter == {"title": ["A b"], "tags": ["x", "y"]} and rows["a.md"].body == "# Body\n"
    assert rows["b.md"].frontmatter == {} and rows["b.md"].body == "no header"
    (tmp_path / "log.jsonl").write_text('{"ts":"2024-01-02T00:00:00Z","kind":"k","payload":{"a":1}}\nnot json\n{"kind":"x"}\n')
    good, bad = vault.log_entries(spark, str(tmp_path / "log.jsonl"))
    assert [(r.kind, json.loads(r.payload)) for r in good.collect()] == [("k", {"a": 1})] and bad.count() == 2


def test_turns_of_several_dialects(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "hi"}]}, "uuid": "1", "timestamp": "2024-01-02T00:00:00Z", "sessionId": "s"},
        {"timestamp": 1704153600, "params": {"sessionId": "s", "update": {"sessionUpdate": "agent_message_chunk", "content": {"text": "yo"}}}},
        {"role": "session_meta", "content": "x"},
        {"type": "turn", "turnId": "t", "timestamp": "2024-01-02T00:00:00Z", "role": "assistant", "text": "ok"},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = [(r.role, r.text) for r in vault.turns(spark, str(tmp_path / "t.jsonl")).orderBy("text").collect()]
    assert got == [("user", "hi"), ("assistant", "ok"), ("assistant", "yo")]


def test_upsert(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long")
    changes = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2)], "k long, v string, t long")
    assert sorted((r.k, r.v) for r in sinks.upsert(now, changes, "k", "t").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_index_stream_adds_once(spark, tmp_path):
    src, target = tmp_path / "in", f"{tmp_path}/index"
    src.mkdir()
    (src / "a.md").write_text("one two")
    (src / "b.md").write_text("one two")

    def run(checkpoint):
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(src))
        ingest.index_stream(stream, target, f"{tmp_path}/{checkpoint}")

    run("c1")
    assert spark.read.parquet(target).count() == 1
    (src / "c.md").write_text("three")
    run("c1")
    run("c2")  # a lost checkpoint adds nothing
    assert sorted(r.words for r in spark.read.parquet(target).collect()) == [1, 2]
