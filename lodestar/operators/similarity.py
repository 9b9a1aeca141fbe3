"""Similarity joins of word sets by a prefix filter."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scalars import jaccard
from lodestar.session import materialize

#: Taken from the least similarity, so that what rounds to it and what floats make of it is looked for.
SLACK = 1e-6
#: Places of the table of counts; sets that are sent to all tasks at most.
SLOTS, FEW = 1 << 17, 100_000


def _first_words(least: float, counts: np.ndarray):
    """From (row, side, n, hashes) a row for each of the first words of a set: (row, side, n, word, at, index, s0 to s3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                lists = batch.column(3)
                h, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, counts[h & (SLOTS - 1)], owner))
                h, at = h[order], np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                bit, u = (h >> 17) & 255, np.uint64
                sketch = np.zeros((len(n), 4), u)
                np.bitwise_xor.at(sketch, (owner, bit >> 6), u(1) << (bit & 63).astype(u))
                first = lambda share: (n - np.ceil(n * share - 1e-9) + 1)[owner]
                kept = np.flatnonzero(at < first(least))
                index = (at < first(2 * least / (1 + least)))[kept]
                rows = owner[kept]
                took = [pc.take(batch.column(k), pa.array(rows)) for k in range(3)]
                columns = [*took, pa.array(h[kept]), pa.array(at[kept].astype(np.int32)), pa.array(index), *[pa.array(sketch[rows, k].view(np.int64)) for k in range(4)]]
                yield pa.RecordBatch.from_arrays(columns, ["row", "side", "n", "word", "at", "index", "s0", "s1", "s2", "s3"])

    return run


def similar_pairs(rows: DataFrame, least: float, across: str | None = None) -> DataFrame:
    """(a, b, similarity) of rows (id, bucket, words) in one bucket whose word sets have at least this Jaccard similarity.

    Exact prefix filter: with words in a global order, rarest first, two sets can only be as alike if they share one of
    the first n - ceil(least * n) + 1 words of the larger and n - ceil(2 * least / (1 + least) * n) + 1 of the smaller one.
    So a rare word pairs few rows; all pairs of a bucket are never made. The order goes by counts of hashes in a table of
    fixed size and by the hash, so words are counted but neither shuffled nor joined. Where two sets meet, their sizes, the
    words left to them and sketches (the parities of 256 classes of words, which can't differ in more places than the sets
    do) leave little but true pairs; only these are written, and only their sets are compared word by word. Of the order and
    of sketches nothing depends but which words meet: what is found is exact.

    across: a boolean column; only pairs of a row where it holds and one where it doesn't are looked for.
    """
    low = least - SLACK
    side = F.col(across) if across else F.lit(True)
    sets = materialize(rows.where("id IS NOT NULL").select("id", "bucket", side.alias("side"), "words", F.monotonically_increasing_id().alias("row")).where("size(words) > 0"), "sets")
    hashes = sets.select("row", "side", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64("bucket", w)).alias("h"))
    counts = np.zeros(SLOTS, np.int64)
    for slot, count in hashes.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).count().collect():  # at most SLOTS rows
        counts[slot] = count
    words = hashes.mapInArrow(_first_words(low, counts), "row long, side boolean, n int, word long, at int, index boolean, s0 long, s1 long, s2 long, s3 long")
    words = materialize(words, "first-words")
    end = lambda s, only: words.where(only).select("word", *[F.col(c).alias(f"{s}_{c}") for c in ("row", "side", "n", "at", "s0", "s1", "s2", "s3")])
    met = end("x", "true").join(end("y", "index"), "word").where("x_n > y_n OR (x_n = y_n AND x_row > y_row)").where(F.col("y_n") >= F.col("x_n") * low)
    if across:
        met = met.where("x_side <> y_side")
    both = F.col("x_n") + F.col("y_n")
    met = met.where(F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= both * (low / (1 + low)))
    met = met.where(F.expr(" + ".join(f"bit_count(x_s{k} ^ y_s{k})" for k in range(4))) <= both * ((1 - low) / (1 + low)))
    maybe = materialize(met.select("x_row", "y_row").distinct(), "similar-maybe")
    held = maybe.select(F.col("x_row").alias("row")).unionByName(maybe.select(F.col("y_row").alias("row"))).distinct()
    few = held.limit(FEW + 1).count() <= FEW
    asked = materialize(sets.join(F.broadcast(held) if few else held, "row", "left_semi").select("row", "id", "bucket", "words"), "similar-sets")
    end = lambda s: asked.select(F.col("row").alias(f"{s}_row"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "bucket", "words")])
    told = maybe.join(end("x"), "x_row").join(end("y"), "y_row").where("x_bucket = y_bucket")
    found = told.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), F.round(jaccard(F.col("x_words"), F.col("y_words")), 6).alias("similarity"))
    return found.where(F.col("similarity") >= least)


def similar_names(rows: DataFrame, least: float, kept: Sequence[str] = ()) -> DataFrame:
    """(bucket, a, b, similarity, x_..., y_...) of rows (id, bucket, words, ...) alike as in similar_pairs, for short sets.

    x_... and y_... are the columns `kept` of a and of b. With words in a global order, rarest first, two sets that must
    share two words or more share two of the first n - ceil(least * n) + 2, and the smaller one has them among the first
    n - ceil(2 * least / (1 + least) * n) + 2; so sets meet by pairs of words. Sets that one word may be enough for meet by
    one as well. A pair counts where the first words that it shares say so, with its exact similarity: no pair is
    gathered, sorted out or joined again. A word is a number, its place in the order.
    """
    low = least - SLACK
    words = rows.where("id IS NOT NULL").select("id", "bucket", F.explode("words").alias("w"))
    known = words.groupBy("bucket", "w").agg(F.count("*").alias("df")).orderBy("df", "bucket", "w")
    order = materialize(known.select("bucket", "w", F.monotonically_increasing_id().alias("token")), "names-order")
    sets = words.join(order, ["bucket", "w"]).groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("o"))
    sets = materialize(sets.join(rows.select("id", "bucket", *kept), "id").withColumn("n", F.size("o")), "names")
    sketch = F.expr("aggregate(o, 0L, (s, t) -> s ^ shiftleft(1L, CAST(pmod(xxhash64(t), 64L) AS INT)))")
    sets = sets.withColumn("sketch", sketch)
    none = F.lit(-1).cast("long")

    def keyed(share: float, s: str) -> DataFrame:
        """Sets with (t1, t2), every two of their first words, or (t1, -1), when one may be enough."""
        some = lambda more: F.slice("o", F.lit(1), F.least(F.col("n"), (F.col("n") - F.ceil(F.col("n") * share) + more).cast("int")))
        two = F.flatten(F.transform(some(2), lambda t, i: F.transform(F.slice(some(2), i + 2, F.size(some(2))), lambda u: F.struct(t.alias("t1"), u.alias("t2")))))
        one = F.when(F.col("n") * low <= 1, F.transform(some(1), lambda t: F.struct(t.alias("t1"), none.alias("t2")))).otherwise(F.array().cast("array<struct<t1:bigint,t2:bigint>>"))
        return sets.select(F.explode(F.concat(two, one)).alias("t"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "o", "sketch", *(["bucket"] if s == "x" else []), *kept)]).select("t.*", "*").drop("t")

    met = keyed(low, "x").join(keyed(2 * low / (1 + low), "y"), ["t1", "t2"])
    met = met.where("x_n > y_n OR (x_n = y_n AND x_id > y_id)").where(F.col("y_n") >= F.col("x_n") * low)
    met = met.where(F.expr("bit_count(x_sketch ^ y_sketch)") <= (F.col("x_n") + F.col("y_n")) * ((1 - low) / (1 + low)))
    met = met.select("*", F.explode(F.array(F.array_intersect("x_o", "y_o"))).alias("both"))  # the generator keeps it from being worked out once for each use
    met = met.where((F.get("both", F.lit(0)) == F.col("t1")) & (F.coalesce(F.get("both", F.lit(1)), none) == F.col("t2")))
    union = F.col("x_n") + F.col("y_n") - F.size("both")
    met = met.where(F.size("both") >= union * low).withColumn("similarity", F.round(F.size("both") / union, 6)).where(F.when(F.size("both") < union * (least + SLACK), F.col("similarity") >= least).otherwise(True))
    side = lambda s, o, c: F.when(F.col("x_id") < F.col("y_id"), F.col(f"{s}_{c}")).otherwise(F.col(f"{o}_{c}"))
    return met.select(F.col("x_bucket").alias("bucket"), F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), "similarity", *[side("x", "y", c).alias(f"x_{c}") for c in kept], *[side("y", "x", c).alias(f"y_{c}") for c in kept])
