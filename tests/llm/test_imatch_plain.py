"""I-Match against a plain version over a whole table; neighbours by key with odd names, ties and nulls."""

import hashlib
import math
import os
import struct
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import imatch

SF = "/root/testdata/sf0.001"


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def terms_of(text):
    return sorted({w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}, key=lambda w: w.encode())


def plain_fingerprints(texts, corpus):
    df = Counter(w for t in corpus for w in terms_of(t))
    idf = {w: math.log(len(corpus) / n) for w, n in df.items() if n >= 2}
    lexicon = {w: h64(w.encode()) for w, x in idf.items() if imatch.IDF_LOW <= x <= imatch.IDF_HIGH}
    size = imatch.SUBSETS // 4
    draw = lambda h, g: signed(h64(struct.pack("<i", g), h64(struct.pack("<Q", h)))) % imatch.RATES[g]
    member = {w: [g * size + draw(h, g) for g in range(4) if draw(h, g) < size] for w, h in lexicon.items()}
    out = []
    for text in texts:
        subsets = [[] for _ in range(imatch.SUBSETS)]
        for w in terms_of(text):
            for k in member.get(w, ()):
                subsets[k].append(lexicon[w])
        shown = []
        for found in subsets:
            seed = 42
            for h in found:
                seed = h64(struct.pack("<Q", h), seed)
            shown.append(f"{seed:x}" if found else "-")
        out.append(".".join(shown) if any(subsets) else "text." + hashlib.md5(text.encode()).hexdigest())
    return out


def alike(a, b):
    if a == b:
        return 1.0
    if a.startswith("text.") or b.startswith("text."):
        return 0.0
    both = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=True) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in both) / len(both)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_equals_the_plain_version(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    corpus = [t for _, t in rows]
    following = corpus[1:] + corpus[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(corpus, following, strict=True)]
    plain, changed, after = (plain_fingerprints(x, corpus) for x in (corpus, edited, following))
    got = {r.doc_id: r for r in imatch.op3_imatch(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, (key, text) in enumerate(rows):
        want = (len(text), hashlib.sha256(edited[i].encode()).hexdigest(), plain[i], changed[i])
        assert tuple(got[key])[1:5] == want
        assert got[key].near_edited == pytest.approx(alike(plain[i], changed[i])) and got[key].near_next == pytest.approx(alike(plain[i], after[i]))
    seen = [r.near_edited > 0 for r in got.values()]
    assert sum(seen) >= 0.9 * len(seen) and sum(r.near_next for r in got.values()) < 0.01 * len(got) + sum(a == b for a, b in zip(corpus, following, strict=True))


@pytest.mark.parametrize(("run", "cuts"), [(500, 4096), (7, 4096), (7, 5), (3, 1)])
def test_neighbours(spark, monkeypatch, run, cuts):
    monkeypatch.setattr(imatch, "RUN", run)
    monkeypatch.setattr(imatch, "CUTS", cuts)
    rows = [(i * 7 % 5000 - 100 if i else None, f"t{i % 300}") for i in range(1500)] + [(5, "t1"), (5, "t1"), (2**62, "far"), (-(2**62), None)]
    frame = spark.createDataFrame(rows, "`doc.id` long, `run` string")
    done = imatch.with_next(frame, "doc.id", ["run"], {"k": F.length("run")})
    order = lambda key, text: (key is None, -(key or 0), text is not None, text or "")
    want = sorted(rows, key=lambda r: order(*r))
    got = sorted(((r["doc.id"], r["run"], r.k, r.next_run) for r in done.collect()), key=lambda r: order(*r[:2]))
    assert got == [(*a, None if a[1] is None else len(a[1]), b[1]) for a, b in zip(want, want[1:] + want[:1], strict=True)]


def test_neighbours_of_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "a")], "id int, t string")
    assert [tuple(r) for r in imatch.with_next(one, "id", ["t"], {}).collect()] == [(1, "a", "a")]
    assert imatch.with_next(one.limit(0), "id", ["t"], {}).count() == 0


def test_fingerprint_names(spark):
    frame = spark.createDataFrame([(1, "one two", "x"), (2, None, "y")], "`k` int, `the.text` string, fingerprint string")
    got = [r.fingerprint for r in imatch.fingerprints(frame, "the.text", terms=["one", "two"]).collect()]
    assert len(got) == 2 and got[1] == "text." + hashlib.md5(b"").hexdigest()
