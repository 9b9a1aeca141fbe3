"""I-Match fingerprints of documents, with DataFrame functions only.

Terms within a band of inverse document frequency form the lexicon; a text's distinct lexicon terms are sorted and, for
each of several randomised subsets of the lexicon, hashed. Two texts are alike as far as their subset hashes agree.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.columns import quoted

#: All terms with low <= idf = ln(N / df) <= high and df >= 2 form the lexicon. As df >= N / e^high, it has at most e^high
#: (about 2000) times as many terms as a document has distinct ones on average, however many documents there are.
IDF_LOW, IDF_HIGH = 3.0, 7.6
#: Buckets of the lexicon's lookup table.
BUCKETS = 1 << 16
#: Subsets of the lexicon: equal groups of disjoint ones, each of which draws one term in each of RATES, so that short and
#: long texts have subsets that fit them. As many as the first rate are in a group, so that every term is in some subset.
SUBSETS, RATES = 64, (16, 96, 384, 1536)
_SEPARATORS = r"[^\p{L}\p{N}]+"
#: Documents in a run of neighbours; quantiles of the keys, and the step of the coarse ones.
RUN, CUTS, FAN = 500, 4096, 64
#: Heads of runs (24 bytes each) that are broadcast to the rows at most; beyond, both are shuffled by key.
HEADS = 100_000


def words(text: Column) -> Column:
    return F.split(F.lower(text), _SEPARATORS)


def _in_subset(h: Column, k: Column, subsets: int, rates: Sequence[int]) -> Column:
    size = subsets // len(rates)
    group = F.floor(k / size).cast("int")
    return F.pmod(F.xxhash64(h, group), F.get(F.array(*[F.lit(r) for r in rates]), group)) == k % size


def lexicon(docs: DataFrame, text: str = "text", low: float = IDF_LOW, high: float = IDF_HIGH, subsets: int = SUBSETS, rates: Sequence[int] = RATES) -> Column:
    """The lexicon of all documents: its terms' 64-bit hashes h, each with every subset k that has it, dealt to buckets by h.

    Terms of no subset are of no use and left out. The table is one constant of the plan, which the optimizer folds.
    """
    total = docs.count()
    terms = docs.select(F.explode(F.array_distinct(words(F.coalesce(quoted(text), F.lit(""))))).alias("term"))
    counted = terms.where("term != ''").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    band = counted.where((F.col("df") >= 2) & (idf >= low) & (idf <= high)).select(F.xxhash64("term").alias("h"))
    within = F.filter(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda k: _in_subset(F.col("h"), k, subsets, rates))
    buckets = [[] for _ in range(BUCKETS)]
    for h, ks in band.select("h", within).collect():
        buckets[h % BUCKETS].extend({"h": h, "k": k} for k in ks)
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<struct<h:bigint,k:int>>>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hits(text: Column, terms: list[str] | Column, subsets: int, rates: Sequence[int]) -> Column:
    """(h, k) for each subset k of each distinct lexicon term of the text, in the order of the terms."""
    found = F.sort_array(F.array_distinct(words(text)))
    if isinstance(terms, Column):
        place = lambda h: (F.pmod(h, F.lit(BUCKETS)) + 1).cast("int")
        of = lambda t, h: F.filter(F.element_at(t, place(h)), lambda e: e["h"] == h)
        return _let(terms, lambda t: F.flatten(F.transform(found, lambda w: _let(F.xxhash64(w), lambda h: of(t, h)))))
    known = F.filter(found, lambda w: w.isin(terms)) if terms else F.array().cast("array<string>")
    each = F.sequence(F.lit(0), F.lit(subsets - 1))
    of = lambda h: F.transform(F.filter(each, lambda k: _in_subset(h, k, subsets, rates)), lambda k: F.struct(h.alias("h"), k.alias("k")))
    return F.flatten(F.transform(known, lambda w: _let(F.xxhash64(w), of)))


def fingerprint(text: Column, terms: list[str] | Column, subsets: int = SUBSETS, rates: Sequence[int] = RATES) -> Column:
    """For each subset of the lexicon the hash of the text's sorted distinct terms in it, "-" where it has none, as one string.

    terms is a short list or a lexicon() of the same subsets. A text without any lexicon term in a subset gets its own hash.
    """
    subset = lambda hits, k: F.transform(F.filter(hits, lambda e: e["k"] == k), lambda e: e["h"])
    shown = lambda hits, k: _let(subset(hits, k), lambda found: F.when(F.size(found) > 0, F.lower(F.hex(F.xxhash64(found)))).otherwise("-"))

    def group(hits: Column, begin: int, end: int) -> Column:  # subsets begin to end - 1, each from its group's hits only
        each = F.sequence(F.lit(begin), F.lit(end - 1))
        return _let(F.filter(hits, lambda e: (e["k"] >= begin) & (e["k"] < end)), lambda own: F.transform(each, lambda k: shown(own, k)))

    edges = [subsets // len(rates) * i for i in range(len(rates) + 1)]
    joined = lambda hits: F.array_join(F.concat(*[group(hits, a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]), ".")
    alone = F.concat(F.lit("text."), F.md5(text.cast("binary")))
    return _let(_hits(text, terms, subsets, rates), lambda hits: _let(joined(hits), lambda f: F.when(f.rlike("[0-9a-f]"), f).otherwise(alone)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes among the subsets that either fingerprint has; 1 for equal fingerprints."""
    both = F.arrays_zip(F.split(a, r"\.").alias("a"), F.split(b, r"\.").alias("b"))
    used = F.filter(both, lambda x: (x["a"] != "-") | (x["b"] != "-"))
    same = F.size(F.filter(used, lambda x: x["a"] == x["b"]))
    return F.when(a == b, F.lit(1.0)).when(a.startswith("text.") | b.startswith("text."), F.lit(0.0)).otherwise(same / F.size(used))


def fingerprints(docs: DataFrame, text: str = "text", terms: list[str] | Column | None = None) -> DataFrame:
    """docs with a column fingerprint of every whole text, one of that name replaced; all other columns stay.

    A null text is empty. Equal texts have equal fingerprints; a text without any lexicon term has one of its own bytes.
    No rows give no rows: their lexicon is empty.
    """
    whole = F.coalesce(quoted(text), F.lit(""))
    chosen = lexicon(docs, text) if terms is None else terms
    return docs.withColumn("fingerprint", fingerprint(whole, chosen))


def _place(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key: first among every FANth cut, then within one block of them."""
    if not cuts:
        return F.lit(0)
    flat, tops = F.array(*[F.lit(c) for c in cuts]), F.array(*[F.lit(c) for c in cuts[::FAN]])
    block = F.size(F.filter(tops, lambda c: c <= key))
    fine = F.slice(flat, F.greatest(block - 1, F.lit(0)) * FAN + 1, F.lit(FAN))
    return F.greatest(block - 1, F.lit(0)) * FAN + F.size(F.filter(fine, lambda c: c <= key))


def with_next(docs: DataFrame, key: str, payload: list[str], derived: dict[str, Column]) -> DataFrame:
    """docs (key, payload...) with derived columns, and next_<column> of the next row by descending key, after the last the first.

    Rows are cut into runs of neighbouring keys: CUTS quantiles of the keys, and between two of them equal widths, as many
    as the number of rows asks for. Each run also gets, as its last row, a copy of the first row of the run that follows.
    So no run waits for another or grows with the table, and a payload is shuffled once. A null key sorts last; rows of one
    key are ordered by payload, and are of one run. One row follows itself; no rows give no rows. Names may be of any kind;
    derived columns speak of the payload's by their names.
    """
    lowest = -(2**63)
    kept = docs.select(quoted(key).alias(key), *[quoted(c).alias(c) for c in payload])
    keys = kept.select(F.coalesce(quoted(key).cast("long"), F.lit(lowest)).alias("_key"))
    total = docs.count()
    quantiles = min(CUTS, -(-total // RUN))
    shares = [i / quantiles for i in range(1, quantiles)]
    cuts = sorted(set(keys.agg(F.percentile_approx("_key", shares, 20 * quantiles)).first()[0] or [])) if shares else []
    parts = max(1, -(-total // (RUN * (len(cuts) + 1))))  # of equal width between two cuts
    bounds = F.array(*[F.lit(c) for c in [lowest, *cuts, 2**63 - 1]])
    k, at = F.col("_key").cast("double"), _place(F.col("_key"), cuts)
    low, high = F.get(bounds, F.col("_cut")).cast("double"), F.get(bounds, F.col("_cut") + 1).cast("double")
    part = F.least(F.lit(parts - 1), F.floor((k - low) / F.greatest(high - low, F.lit(1.0)) * parts)).cast("int") if parts > 1 else F.lit(0)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_cut", at).withColumn("_part", part)

    heads = dealt(keys).groupBy("_cut", "_part").agg(F.max("_key").alias("head"))  # a row a run
    within = Window.partitionBy("_cut").orderBy(F.desc("_part"))
    led = heads.select("_cut", "_part", "head", F.lag("_part").over(within).alias("to_part"))  # a run's first row goes to the run before it
    ends = heads.groupBy("_cut").agg(F.min("_part").alias("end_part"))  # CUTS rows at most
    line = Window.orderBy(F.desc("_cut"))
    before = ends.select(F.col("_cut").alias("c"), F.coalesce(F.lag(F.struct("_cut", "end_part")).over(line), F.last(F.struct("_cut", "end_part")).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    follows = led.join(before, F.col("_cut") == F.col("c")).select(
        "head", F.when(F.col("to_part").isNull(), F.col("to._cut")).otherwise(F.col("_cut")).alias("to_cut"), F.coalesce("to_part", F.col("to.end_part")).alias("to_part")
    )
    placed = dealt(kept.withColumn("_key", F.coalesce(quoted(key).cast("long"), F.lit(lowest)))).withColumn("_ghost", F.lit(0))
    values = F.struct(*[quoted(c).alias(f"p{i}") for i, c in enumerate(payload)])
    few = (len(cuts) + 1) * parts <= HEADS
    best = placed.join(F.broadcast(follows) if few else follows, F.col("_key") == F.col("head")).groupBy("to_cut", "to_part").agg(F.min(values).alias("_p"))
    ghosts = best.select(
        F.lit(None).cast(docs.select(quoted(key)).schema[0].dataType).alias(key), *[F.col(f"_p.p{i}").alias(c) for i, c in enumerate(payload)],
        F.lit(lowest).alias("_key"), F.col("to_cut").alias("_cut"), F.col("to_part").alias("_part"), F.lit(1).alias("_ghost"),
    )
    order = Window.partitionBy("_cut", "_part").orderBy("_ghost", F.desc("_key"), *[quoted(c) for c in payload])
    carried = [*payload, *derived]
    told = placed.unionByName(ghosts).withColumns(derived).withColumn("_next", F.lead(F.struct(*[quoted(c).alias(f"p{i}") for i, c in enumerate(carried)])).over(order))
    return told.where("_ghost = 0").select(quoted(key), *[quoted(c) for c in carried], *[F.col(f"_next.p{i}").alias(f"next_{c}") for i, c in enumerate(carried)])


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: fingerprints of each text, of its edited text, and their likeness."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = lexicon(docs)
    paired = with_next(docs, "doc_id", ["text"], {"fingerprint": fingerprint(F.col("text"), terms)})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = paired.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited"), terms))
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
