"""Conversation repair, byte-level BPE and runs of words against plain versions, with nulls, ties, repeats and clashing names."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import parity
import pyarrow as pa
import pytest

from lodestar.llm import bytebpe, repair, runs

SF = "/root/testdata/sf0.001"
WHITE = "[^\\x20\\x09-\\x0D]+"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


# --- repair ---


def cheapest(rows):
    """Least (cost, audit) by trying all edits in order of rows, any number of insertions up to three at a place."""

    def insertions(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                to, way = (3 if state == "u" else "u"), (cost + 2, audit + "I")
                best[to] = min(best.get(to, way), way)
        return best

    best = insertions({0: (0, "")})
    legal = {(0, "s"): "s", (0, "u"): "u", ("s", "u"): "u", (3, "u"): "u", ("u", "a"): 3}
    for initial, fault in rows:
        new = {}
        for state, (cost, audit) in best.items():
            ways = [(state, 3, "D")]
            if fault not in ("blank", "duplicate"):
                charge = int(fault == "truncated")
                ways.append((3 if state == "u" else "u", 2 + charge, "R"))
                if (state, initial) in legal:
                    ways.append((legal[state, initial], charge, "K"))
            for to, price, letter in ways:
                way = (cost + price, audit + letter)
                new[to] = min(new.get(to, way), way)
        best = insertions(new)
    return min(best[e] for e in (0, 3) if e in best)


NAMES = ["", "blank", "duplicate", "truncated"]


def test_search_finds_the_cheapest_and_least_audit(monkeypatch):
    rng = random.Random(5)
    for _ in range(800):
        rows = [(rng.choice("suaxu a"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 30))]
        want = cheapest([(i, NAMES[f]) for i, f in rows])
        monkeypatch.setattr(repair, "BLOCK", 256)
        assert repair.solve(rows) == want
        monkeypatch.setattr(repair, "BLOCK", rng.choice([1, 2, 5]))
        assert repair.solve(rows) == want


def test_search_against_all_audits():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 1, 3])) for _ in range(rng.randint(0, 3))]
        found = []
        for n in range(len(rows), len(rows) + 4):
            for audit in itertools.product("DIKR", repeat=n):
                if n - audit.count("I") != len(rows):
                    continue
                cost, at, options = 0, iter(rows), []
                for e in audit:
                    initial, fault = ("", 0) if e == "I" else next(at)
                    if e == "D":
                        cost += 3
                        continue
                    cost += 99 * (fault in (1, 2)) + (fault == 3) + 2 * (e in "IR")
                    options.append(initial if e == "K" else "ua")
                if any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*options)):
                    found.append((cost, "".join(audit)))
        assert repair.solve(rows) == min(found)


def plain_repair(rows):
    """{key: report} of (key, turn, role, text) rows."""
    groups = {}
    for k, turn, role, text in rows:
        groups.setdefault(k, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text, turn))
    out = {}
    for k, found in groups.items():
        found.sort(key=lambda r: r[:4])
        seen, faults, legal = set(), [], {"su", "ua", "au"}
        for *_, role, text, _turn in found:
            last = re.findall("[^\\x20\\x09-\\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[2][:1] for r in found]
        turns = {r[4] for r in found if r[4] is not None}
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        out[k] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in NAMES[1:]),
            sum(a + b not in legal for a, b in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
        )
    return out


def check_repair(spark, rows, **names):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "`conv.id` long, turn long, role string, text string, part string")
    done = repair.repair(frame, "conv.id").collect()
    assert len({r["conv.id"] for r in done}) == len(done)
    assert {r["conv.id"]: tuple(r)[1:8] for r in done} == plain_repair(rows)
    for r in done:
        roles = "".join(x.role[:1] for x in r.repaired)
        assert re.fullmatch("(s?(ua)+)?", roles) and len(roles) == len(r.audit) - r.audit.count("D")
        texts = [t for k, _, _, t in rows if k == r["conv.id"]]
        assert all(x.text == "" or x.text in texts for x in r.repaired)


def test_repair_of_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "Yes."),
        (2, None, None, None), (2, None, "user", ""), (2, 5, "tool", "x\v"), (2, 5, "", "y."),
        (None, 1, "assistant", "No key!"), (None, 1, "assistant", "No key!"), (None, None, "user", "first?"),
        (3, 2**62, "user", "a."), (3, -(2**62), "assistant", "b."),
        (4, 1, "user", "long " * 50_000 + "end."), (4, 2, "assistant", " "),
    ]
    check_repair(spark, rows)
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repair(empty).count() == 0


def test_long_conversations_are_repaired_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 16)
    rng = random.Random(7)
    text = lambda: rng.choice(["", " ", "same.", "Go on", "cut", f"all {rng.random()}."])
    role = lambda: rng.choice(["user", "assistant", "assistant", "user", "system", None])
    rows = [(5, i // 2 if i % 7 else None, role(), text()) for i in range(1500)]
    rows += [(None, i, role(), text()) for i in range(600)]
    rows += [(k, i, role(), text()) for k in range(10, 60) for i in range(rng.randint(1, 9))]
    rows += [(7, 1, "user", "repeated.")] * 700
    monkeypatch.setitem(globals(), "cheapest", lambda read: repair.solve([(i, NAMES.index(f)) for i, f in read]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_repair(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@has_tables
def test_repair_query_equals_sql(spark):
    assert parity.compare(spark, parity.duck(SF), "op11_repair", repair.op11_repair, repair.OP11_SQL, SF) == ""


# --- byte-level BPE ---

PIECES = [" ", "  ", "\n", " \n", "'s", "'t", "'re", "'", "''", "don't", "I'll", "'S", "a", "bc", "é", "日本", "🙂", "12", "½", "٣", "!", "...", "<|endoftext|>", "<|endof", "\u0085", "\x1c", "\x0b", "\t", "_", " the", "ing", "‍", "́", "ab" * 40, "====----", "x" * 300, " '", "'ve ", "'m1", " ", "　"]


@pytest.fixture(scope="module")
def bpe():
    return bytebpe.open_bpe(bytebpe.MODEL)


def agree(bpe, texts):
    flat, counts = bpe.encode(pa.array(texts, pa.string()))
    ends, back = np.cumsum(counts), bpe.decode(flat, counts).to_pylist()
    for i, text in enumerate(texts):
        want = bpe.library.encode(text or "", add_special_tokens=False).ids
        assert flat[ends[i] - counts[i] : ends[i]].tolist() == want, text
        assert back[i] == bpe.library.decode(want, skip_special_tokens=False)


def test_bpe_equals_the_library(bpe):
    rng = random.Random(3)
    agree(bpe, [None, "", *PIECES])
    agree(bpe, ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12))) for _ in range(4000)])
    agree(bpe, ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x3000, 0xA000)])) for _ in range(rng.randint(1, 60))) for _ in range(1500)])
    agree(bpe, ["".join(rng.choice("abcdefghij etaoinshr'  \n.,") for _ in range(rng.randint(1, 80))) for _ in range(3000)])


def test_bpe_pairs_and_exact_merges(bpe):
    rng = random.Random(4)
    a, b = np.array([rng.randrange(50256) for _ in range(4000)]), np.array([rng.randrange(50256) for _ in range(4000)])
    exact = [bpe._merged(bpe.bytes_of[x] + bpe.bytes_of[y]) == [x, y] for x, y in zip(a, b, strict=True)]
    assert bpe.compatible(a, b).tolist() == exact and 0 < sum(exact) < 4000
    words = list({w.encode() for w in ("antidisestablishmentarianism Überraschung hhhhhh hello " + "lorem ipsum dolor " * 3).split()})
    ends = np.cumsum([len(w) for w in words])
    ids, counts, merged = bpe.words(np.frombuffer(b"".join(words), np.uint8), ends)
    assert np.split(ids, np.cumsum(counts)[:-1]) and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [bpe._merged(w) for w in words]
    assert merged < len(words)


def test_bpe_decodes_any_ids(bpe):
    rng = random.Random(8)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 6))] for _ in range(400)]
    got = bpe.decode(np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists])).to_pylist()
    assert got == [bpe.library.decode(x, skip_special_tokens=False) for x in lists]


def test_bpe_of_a_table(spark, bpe):
    texts = [None, "", "Two words", "Two words", "x y " * 20_000, "<|endoftext|>a<|endoftext|>"]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, `the.text` string, ids string")
    got = {r.id: r for r in bytebpe.encode_bytes(frame, "the.text").collect()}
    for i, t in enumerate(texts):
        want = bpe.library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want) and got[i].decoded == (t or "")
    assert bytebpe.encode_bytes(frame.limit(0), "the.text").count() == 0


@has_tables
def test_bpe_query(spark, bpe):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bytebpe.op12_byte_bpe(spark, SF).collect():
        ids = bpe.library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = bpe.library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


# --- runs ---


def all_runs(w):
    """Every maximal stretch by trying each period."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_against_every_period(monkeypatch):
    rng = random.Random(1)
    for trial in range(60):
        monkeypatch.setattr(runs, "ROUNDS", trial % 3)
        monkeypatch.setattr(runs, "_STEPS", 1 + trial % 8)
        texts = []
        for _ in range(20):
            w = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 150]))]
            if w and rng.random() < 0.5:
                p, a = rng.randint(1, max(1, len(w) // 5)), rng.randrange(len(w))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w)
        words = runs.Words(pa.array([rng.choice([" ", "\n", " \t "]).join(w) if w else rng.choice([None, "", " "]) for w in texts]))
        rows = runs.find_runs(words.ids, words.bounds)
        joined = words.joined(runs._kept(len(words.ids), rows)).to_pylist()
        for k, w in enumerate(texts):
            want = all_runs(w)
            assert [(s - words.bounds[k], n, q) for t, s, n, q in rows.tolist() if t == k] == want
            assert joined[k] == collapse(w, want)


def test_runs_of_a_table(spark):
    texts = [None, "", " \v ", "a a a a a", "a a a a a a", "é b é b é b é b é", "x y " * 9, "one " * 30_000, "a a a a a a"]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, `the.text` string, runs string")
    got = {r.id: r for r in runs.periodic_runs(frame, "the.text").collect()}
    for i, t in enumerate(texts):
        w = re.findall(WHITE, t or "")
        want = all_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        assert [tuple(x) for x in got[i].runs] == want and got[i].collapsed == collapse(w, want) and got[i].n_words == len(w)
    assert runs.periodic_runs(frame.limit(0), "the.text").count() == 0


@has_tables
def test_runs_query(spark):
    done = {r.doc_id: r for r in runs.op13_runs(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w, h = re.findall(WHITE, r.text or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        elif n > 3000:
            continue  # the plain version is quadratic
        got = done[r.doc_id]
        found = all_runs(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        assert (got.n_runs, got.start, got.length, got.period) == (len(found), *(best or (None,) * 3))
        assert got.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert got.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(collapse(w, found).encode()).hexdigest()
