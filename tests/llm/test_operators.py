"""The operators on small tables with nulls, empty and odd texts, ties and repeats, against plain versions."""

import hashlib
import pickle
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import anyflac, chat, flac, idfiles, imatch, langid, media, ngram_join, packing, pieces, prefixtree, shingles, token_output, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[(i * 7 + i // 3) % 20] + str(i % 50) for i in range(900))
TEXTS = [None, "", " ", "a", "One two three four five six.", "One two three four five six.", LONG, LONG + " tail", "  spaces  inside\n\nand é ▁ ␞ <|endoftext|>", "x" * 5000, "日本語 🙂"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en" if i % 2 else None, f"s{i}", "clash") for i, t in enumerate(TEXTS)] + [(None, "no key here", "de", None, "clash"), (12, "One two three four five six.", "en", "again", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_packing_covers_every_id_once(docs, empty):
    tok = library("byte_bpe_50k.json")
    want = sorted((np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in plain(docs)), key=len)
    rows = packing.pack_documents(docs, length=64).collect()
    spans = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == spans.get(r.sequence_id, 0) and r.length > 0 and len(r.ids) == 4 * r.length
        spans[r.sequence_id] = r.offset + r.length
    assert max(spans.values()) <= 64 and sum(v < 64 for v in spans.values()) <= 1
    whole, part = [], b""
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):  # a document's pieces follow each other
        part += r.ids
        if r.start + r.length == r.doc_tokens:
            whole.append(part)
            part = b""
    assert sorted(whole) == sorted(want)
    assert packing.pack_documents(empty).count() == 0


def test_packing_follows_the_curve(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH_TOKENS", 500)
    words = [WORDS[:10], WORDS[10:]]
    rows = [(i, " ".join(words[i % 2][(i + j * 3) % 10] for j in range(40)), "clash", 1) for i in range(60)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "`doc.id` long, `the.text` string, ids string, n int"), "doc.id", "the.text", length=64).collect()
    pieces.sort(key=lambda r: (r.sequence_id, r.offset))
    assert len({r.sequence_id >> 32 for r in pieces}) > 3 and all(r.sequence_id >= 0 for r in pieces)
    assert [r.hilbert for r in pieces] == sorted(r.hilbert for r in pieces)
    kinds = [r.doc_id % 2 for r in pieces]  # documents of one vocabulary lie together: few changes along the curve
    assert sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) < len(kinds) / 4


def test_hilbert_neighbours_touch():
    cells = np.array([(x, y) for x in range(16) for y in range(16)])
    key = packing.hilbert_key(cells, 4)
    assert sorted(key) == list(range(256))
    assert set(np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1)) == {1}


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>x<|end|>", "<\\|a <\\\\|b", "", None, "[/INST]\n<<SYS>> <s>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 1, None, "a"), (2, 1, "user", "b"), (2, None, "<|user|>", "first")]
    part = "array(struct('text' AS type, text AS text, null AS uri, null AS width, null AS height, null AS seconds, null AS pages))"
    done = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", f"{part} AS parts"))
    got = {r.conv_id: r for r in done.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert [(t.role, t.text) for t in got[2].turns] == [("<|user|>", "first"), ("", "a"), ("user", "b")]
    spoken = [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss_spans]
    assert len(spoken) == 3 and spoken[0].replace("\\", "") == "<|turn|>x<|end|>"
    assert done.limit(0).count() == 0


def test_chat_attachments(spark):
    part = "named_struct('type', {0}, 'text', {1}, 'uri', {2}, 'width', {3}, 'height', {3}, 'seconds', {4}, 'pages', null)"
    parts = ", ".join([part.format("'text'", "'see '", "null", "null", "null"), part.format("'image'", "null", "'u'", "57", "null"), part.format("'audio'", "null", "'v'", "null", "2.0D"), part.format("'odd'", "null", "null", "null", "null")])
    row = chat.format_chat(spark.range(1).selectExpr("id AS conv_id", "0 AS turn", "'user' AS role", f"array({parts}) AS parts")).first()
    assert row.formatted == "<|turn|>user<|body|>see <|image|><|audio|><|unknown|><|end|>"
    assert [(a.part, a.type, a.uri, a.tokens) for a in row.attachments] == [(1, "image", "u", 9), (2, "audio", "v", 50), (3, "odd", None, 1)]


def test_imatch(docs, empty):
    done = imatch.fingerprints(docs, terms=["one", "two", "alpha0", "beta7"]).collect()
    by_text = {}
    for r in done:
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) > 3
    assert imatch.fingerprints(empty).count() == 0


def test_imatch_uses_the_whole_band(spark):
    texts = [" ".join(f"w{(i * 50 + j) // 2}x" for j in range(100)) for i in range(100)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(f"a{i}" for i in range(50)), "w7x\u2014w9x", "w7x w9x"])], "doc_id long, text string")
    words = sorted({w for t in texts for w in t.split()})
    assert len(words) > 2048
    small = {r.doc_id: r.fingerprint for r in imatch.fingerprints(rows.where("doc_id < 100")).collect()}
    listed = {r.doc_id: r.fingerprint for r in imatch.fingerprints(rows.where("doc_id < 100"), terms=words).collect()}
    assert all(small[i] == listed[i] for i in range(1, 99))  # each of their words is in four texts, so within the band
    both = [r.fingerprint for r in imatch.fingerprints(rows.where("doc_id >= 150"), terms=["w7x", "w9x"]).collect()]
    assert both[0] == both[1]  # a dash that isn't ASCII separates words


def test_next_document(spark):
    rows = [(i * i, f"text {i}") for i in range(40)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    old, imatch.RUN = imatch.RUN, 5
    try:
        got = {r.doc_id: r.next_text for r in imatch.with_next(many, "doc_id", ["text"], {}).collect()}
    finally:
        imatch.RUN = old
    down = sorted(rows, reverse=True)
    assert got == {k: down[(i + 1) % len(down)][1] for i, (k, _) in enumerate(down)}


def test_token_files(spark, docs, empty, tmp_path):
    tok = library("word_bpe_49k.json")
    coded = lambda t: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
    hot = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(12, f"word{i} of many") for i in range(300)], "doc_id long, text string"))
    manifest = token_output.write_token_files(hot, f"file://{tmp_path}/a", shard_chars=800)
    assert manifest.count() > 8 and manifest.where("low <= 12 AND high >= 12").count() > 1  # one key's rows lie in several shards
    got = sorted(((r.start, r.key, r.n_ids, bytes(r.ids)) for r in token_output.read_token_files(manifest, f"file://{tmp_path}/a").collect()), key=lambda r: r[0])
    assert sorted(((k, ids) for _, k, _, ids in got), key=str) == sorted(((k, coded(t)) for k, t in plain(hot)), key=str)
    assert [k for _, k, _, _ in got] == sorted((k for k, _ in plain(hot)), key=lambda k: (k is not None, k or 0))
    assert [s for s, *_ in got] == np.cumsum([0, *(len(ids) // 4 for *_, ids in got)])[:-1].tolist()

    asked = spark.createDataFrame([(k,) for k in (None, 12, 12, 0, 1, 15, -4, 10**15)], "doc_id long")
    found = sorted(((r.start, r.key, r.n_ids, bytes(r.ids)) for r in token_output.lookup(manifest, f"file://{tmp_path}/a", asked).collect()), key=lambda r: r[0])
    assert found == [r for r in got if r[1] in (None, 12, 0, 15)]  # absent keys give nothing

    none = token_output.write_token_files(empty, f"file://{tmp_path}/b")
    assert token_output.read_token_files(none, f"file://{tmp_path}/b").count() == 0
    assert token_output.lookup(none, f"file://{tmp_path}/b", asked).count() == 0


def test_perfect_hash():
    keys = idfiles.mix(np.arange(5000, dtype=np.uint64))
    h = idfiles.PerfectHash.build(keys)
    assert sorted(h.slot(keys)) == list(range(5000))
    ids, null = np.arange(0, 3000, 3), np.zeros(1000, bool)
    data, reads = idfiles.index_bytes(ids, null, ids * 10, ids + 1), []
    index = idfiles.ShardIndex(lambda at, n: reads.append(n) or data[at : at + n])
    index.verify()
    starts, counts = index.lookup(idfiles.key_of(ids, np.zeros(1000), null))
    assert (starts == ids * 10).all() and (counts == ids + 1).all()
    starts, _ = index.lookup(idfiles.key_of(ids + 1, np.zeros(1000), null))
    assert (starts == -1).all()
    reads.clear()
    assert index.lookup(idfiles.key_of(ids[7:8], np.zeros(1), null[:1]))[0].tolist() == [210] and reads == [idfiles.SLOT.itemsize]  # one slot
    bad = data[:-40] + bytes([data[-40] ^ 1]) + data[-39:]
    with pytest.raises(ValueError):
        idfiles.ShardIndex(lambda at, n: bad[at : at + n]).verify()


def test_language(spark, docs, empty):
    rng = np.random.default_rng(0)
    word = {"xx": "lorem ipsum dolor sit amet consectetur".split(), "yy": "вода огонь земля воздух небо".split()}
    rows = [(i, " ".join(rng.choice(word[x], 12)), x) for i in range(400) for x in [("xx", "yy")[i % 2]]] + [(1000, None, "xx"), (1001, "12 34", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    done = langid.predict(table, langid.fit(table)).collect()
    assert np.mean([r.lang == r.lang_pred for r in done[:400]]) > 0.98
    assert [(r.lang_pred, r.score) for r in done if r.doc_id >= 1000] == [("und", 0.0)] * 2
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0


def test_windows_cover_texts():
    windows, owner, filled = langid.windows_of([b"", b"a" * 256, b"b" * 600])
    assert owner.tolist() == [0, 1, 2, 2, 2] and filled.tolist() == [0, 256, 256, 256, 88]
    assert windows[2:].tobytes().rstrip(b"\0") == b"b" * 600


def test_toxicity(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS, 30)) + (" you b1ockhead!" if i % 7 == 0 else " blockheading is fine" if i % 5 == 0 else "")) for i in range(700)]
    table = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i, _ in rows], "doc_id long, toxic int")
    done = {r.doc_id: r for r in toxicity.score(table, toxicity.fit(table, labels)).collect()}
    assert all(done[i].predicted == int(i % 7 == 0) for i, _ in rows)
    assert done[9000].score == done[9001].score < 0.7
    assert toxicity.fit(table, labels.limit(0)).weights == {}
    assert {r.predicted for r in toxicity.score(docs, toxicity.ToxicLexicon({})).collect()} == {0}
    odd = table.select(F.col("text").alias("the.text"), F.lit("x").alias("SCORE"), F.lit(1).alias("source"), "doc_id")
    again = toxicity.score(odd.unionByName(odd.where("doc_id = 7")), toxicity.fit(table, labels), "the.text")
    assert again.columns == ["the.text", "source", "doc_id", "score", "predicted"]
    assert [r.score for r in again.where("doc_id = 7").collect()] == [done[7].score] * 2
    none = odd.limit(0)
    assert toxicity.fit(none, labels, text="the.text").weights == {} and toxicity.score(none, toxicity.ToxicLexicon({" a ": 1.0}), "the.text").count() == 0


def test_toxic_entries_that_count_from_the_second_match():
    lexicon = toxicity.ToxicLexicon({" vequ": 2.0, " scum ": 3.0}, {" scum bag "}, twice=frozenset([" vequ"]))
    assert lexicon.masses(["vequa", "vequa vequo", "Scum! scum bag", ""])[:, 0].tolist() == [0.0, 4.0, 3.0, 0.0]


def test_folding():
    assert toxicity.fold("Іd10t, 1984 ѕtup1d!").split() == ["idiot", "stupid"]


def plain_components(rows):
    def shingle_set(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and prefixtree.links(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return sorted(((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_ngram_join_of_repeated_and_null_keys(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    bridge = " ".join(f"c{i}" for i in range(5, 65))
    # two texts under the key 1, each with a near copy; a text without a key between two that don't link themselves
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (7, c), (None, bridge), (9, " ".join(f"c{i}" for i in range(10, 70)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(table).collect()), key=str)
    assert got == plain_components(rows)
    assert [c for k, _, c in got if k in (2, 3, 9, None)].count(1) == 2 and (9, 56, 7) in got and (None, 56, 7) in got


@pytest.mark.parametrize("block", [1500, 3])
def test_ngram_join(spark, docs, empty, block):
    rng = np.random.default_rng(2)
    base = [rng.choice(WORDS, 60).tolist() for _ in range(6)]
    rows = []
    for i in range(120):
        w = list(base[i % 6])
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(0, 60)] = f"w{rng.integers(0, 1000)}"
        rows.append((i + 1000, " ".join(w[: rng.integers(50, 61)])))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(table, block_classes=block).collect()), key=str)
    assert got == plain_components(plain(table))
    assert ngram_join.similar_documents(empty).count() == 0


def test_ngram_join_of_a_large_block_without_a_main_component(spark):
    """Texts of two halves from a pool: chains of shared halves tie them all into one block, few of them link."""
    rng = np.random.default_rng(6)
    halves = [[f"h{h}w{i}" for i in range(30)] for h in range(25)]
    rows = []
    for k in range(400):
        w = halves[rng.integers(25)] + halves[rng.integers(25)] + ([f"own{rng.integers(60)}"] if k % 2 else [])
        for _ in range(rng.integers(0, 2)):
            w[rng.integers(0, 60)] = "changed"
        rows.append((k, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(table, block_classes=20).collect()), key=str)
    assert got == plain_components(rows)
    sizes = Counter(c for *_, c in got)
    assert len(sizes) > 60 and max(sizes.values()) < 100


def test_more_places_than_an_entry_can_tell(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_REF", np.uint64(5))
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 1)))
    table = spark.createDataFrame([(i, " ".join(f"w{(i // 2 + j) % 50}" for j in range(12))) for i in range(40)], "doc_id long, text string").coalesce(1)
    batches = [b for b in table.toArrow().to_batches()]
    dealt = list(ngram_join._deal(64, 5)(iter(batches)))
    held = [pickle.loads(a) for b in dealt for kind, a in zip(b.column("kind").to_pylist(), b.column("a").to_pylist(), strict=True) if kind == ngram_join._DOCS]
    assert sorted(i for h in held for i in h["ids"]) == list(range(40)) and len(held) > 2


def test_shingles_tell_short_texts_apart():
    a, b, c, d = shingles.shingle_sets([b"a b c", b"a b c d", b"A\tb  C", b"c b a"])
    assert a[0] == c[0] and len({int(a[0]), int(b[0]), int(d[0])}) == 3


def test_pieces(docs, empty):
    sp, _ = pieces.open_model(pieces.MODEL)
    for r in pieces.encode_pieces(docs).collect():
        ids = sp.encode(r.text or "")
        assert r.ids == ids and r.decoded == sp.decode(ids)
    assert pieces.encode_pieces(empty).count() == 0


def test_media(docs, empty):
    payload = F.coalesce("text", F.lit("")).cast("binary")
    for r in media.read_flac(media.store_flac(docs.withColumn("payload", payload), "payload")).collect():
        n = max(192, -(-len(r.payload) // 192) * 192)
        assert bytes(r.pcm) == bytes(r.payload).ljust(n) and r.reject is None
        assert [b.sample for b in r.blocks] == list(range(0, n, 192))
        assert all(bytes(r.media)[b.byte : b.byte + 2] == b"\xff\xf8" for b in r.blocks)
    assert media.store_flac(empty.withColumn("payload", payload), "payload").count() == 0
    assert media.read_flac(media.store_flac(empty.withColumn("payload", payload), "payload")).count() == 0


def test_media_rejects(spark):
    good, other = flac.encode([b"abc" * 64])[0], written(np.arange(400).reshape(-1, 2) * 37 % 2001 - 1000, 16, "mid")
    rows = [(1, good), (2, None), (3, b""), (4, b"fLaC"), (5, good[:-5]), (6, good[:-1] + bytes([good[-1] ^ 1])), (7, other), (8, good), (9, good[:50])]
    table = spark.createDataFrame(rows, "id int, `me.dia` binary").coalesce(1)
    got = {r.id: r for r in media.read_flac(table.withColumn("PCM", F.lit("clash")), "me.dia").collect()}
    assert bytes(got[1].pcm) == bytes(got[8].pcm) == b"abc" * 64 and got[1].reject is got[8].reject is got[7].reject is None
    assert np.frombuffer(got[7].pcm, "<i2").tolist() == (np.arange(400) * 37 % 2001 - 1000).tolist() and got[7].feature.startswith("rms=")
    assert (got[2].pcm, got[2].blocks, got[2].feature, got[2].reject) == (None,) * 4
    assert all(got[i].pcm is None and got[i].reject for i in (3, 4, 5, 6, 9))


def written(samples, depth, kind, block=96):
    """A FLAC stream of (n, channels) samples by a plain bit writer: kind names the subframes or the stereo layout."""

    def frame(x, number):
        out = ["11111111111110", "0", "0", "0111", "0000"]
        layout = {"mid": 10, "left": 8, "right": 9}.get(kind, x.shape[1] - 1)
        out += [f"{layout:04b}", "000", "0", f"{number:08b}", f"{len(x) - 1:016b}"]
        head = int("".join(out), 2).to_bytes(len("".join(out)) // 8, "big")
        bits = "".join(f"{b:08b}" for b in head + bytes([crc(head, 0x07, 8)]))
        channels = list(x.T)
        if kind in ("mid", "left", "right"):
            a, b = channels
            channels = {"mid": [(a + b) >> 1, a - b], "left": [a, a - b], "right": [a - b, b]}[kind]
        for c, values in enumerate(channels):
            deep = depth + (kind in ("mid", "left") and c == 1 or kind == "right" and c == 0)
            raw = lambda v, n: f"{int(v) & ((1 << n) - 1):0{n}b}"
            if kind == "wasted":
                bits += "0" + "000001" + "1" + "01" + "".join(raw(v >> 2, deep - 2) for v in values)
            elif kind == "linear":  # x[i] is guessed as x[i - 1] * 3 >> 1
                bits += "0" + "100000" + "0" + raw(values[0], deep) + raw(3 - 1, 4) + raw(1, 5) + raw(3, 3)
                bits += rice(values[1:] - (values[:-1] * 3 >> 1), 6, len(values))
            elif kind == "escape":
                bits += "0" + "001000" + "0" + "00" + "0000" + "1111" + raw(deep, 5) + "".join(raw(v, deep) for v in values)
            else:
                bits += "0" + "001010" + "0" + raw(values[0], deep) + raw(values[1], deep) + rice(np.diff(values, 2), 4, len(values), parts=1)
        bits += "0" * (-len(bits) % 8)
        body = int(bits, 2).to_bytes(len(bits) // 8, "big")
        return body + crc(body, 0x8005, 16).to_bytes(2, "big")

    def rice(residuals, k, size, parts=0):
        codes, out, at = [int(e) * 2 if e >= 0 else -int(e) * 2 - 1 for e in residuals], f"00{parts:04b}", 0
        for p in range(1 << parts):
            n = (size >> parts) - (size - len(codes) if p == 0 else 0)
            out += f"{k:04b}" + "".join("0" * (c >> k) + "1" + f"{c & ((1 << k) - 1):0{k}b}" for c in codes[at : at + n])
            at += n
        return out

    def crc(data, poly, width):
        value = 0
        for byte in data:
            value ^= byte << (width - 8)
            for _ in range(8):
                value = (value << 1 ^ poly if value >> (width - 1) else value << 1) & ((1 << width) - 1)
        return value

    n, channels = samples.shape
    md5 = hashlib.md5(samples.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : (depth + 7) // 8].tobytes()).digest()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (depth - 1) << 36 | n).to_bytes(8, "big") + md5
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frame(samples[a : a + block], a // block) for a in range(0, n, block))


@pytest.mark.parametrize("kind", ["fixed", "linear", "escape", "wasted", "mid", "left", "right"])
@pytest.mark.parametrize("depth", [8, 16, 24])
def test_flac_of_other_writers(kind, depth):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.integers(-5, 6, (500, 2 if kind in ("mid", "left", "right") else 3)), 0).clip(-100, 99) * (1 if depth == 8 else 50)
    if kind == "wasted":
        x = x // 4 * 4
    x = x[:480] if kind == "fixed" else x
    stream = written(x, depth, kind)
    pcm, blocks, bits = anyflac.decode(stream)
    found = np.frombuffer(pcm, {8: np.uint8, 16: "<i2", 24: "<i4"}[depth]).astype(np.int64) - (128 if depth == 8 else 0)
    assert bits == depth and found.reshape(x.shape).tolist() == x.tolist()
    assert [s for s, _ in blocks] == list(range(0, len(x), 96)) and all(stream[b] == 0xFF for _, b in blocks)


def test_both_readers_agree():
    rng = np.random.default_rng(5)
    smooth = (128 + np.cumsum(np.cumsum(np.cumsum(rng.integers(-1, 2, 192 * 5))) / 40) / 90).clip(0, 255).astype(np.uint8).tobytes()
    payloads = [smooth, rng.integers(0, 256, 576, np.uint8).tobytes(), bytes(range(192)), b"ab" * 96]
    streams = flac.encode(payloads)
    for stream, payload, blocks in zip(streams, *flac.decode(streams), strict=True):
        assert anyflac.decode(stream) == (payload, blocks, 8)
    kinds = {anyflac.Bits(stream, b + 6).take(7) for stream in streams for _, b in anyflac.decode(stream)[1]}
    assert flac.decode(streams)[0] == payloads and len(kinds) >= 3


def test_flac_round_trip_and_damage():
    rng = np.random.default_rng(3)
    wave = (128 + 90 * np.sin(np.arange(192 * 40) / 9)).astype(np.uint8).tobytes()
    payloads = [rng.integers(0, 256, 384, np.uint8).tobytes(), b"\0" * 192, bytes(range(192)), wave, b"\0\xff" * 96]
    streams = flac.encode(payloads)
    assert flac.decode(streams)[0] == payloads and len(streams[3]) < len(wave) / 2
    for at in (30, -50, -1):
        bad = bytearray(streams[3])
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    assert hashlib.sha256(streams[1]).digest() == hashlib.sha256(flac.encode([b"\0" * 192])[0]).digest()
