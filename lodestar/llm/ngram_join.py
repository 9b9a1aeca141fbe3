"""N-gram Jaccard join: exact links between documents whose word shingles agree, by prefix trees over ordered sets.

1. Texts become sets of hashed shingles. Shingles go to buckets by hash; a bucket tells for each shingle in how many
   documents it is. Only shingles that are in several can be shared; the others only count towards a set's size.
2. A set's shared shingles are ordered by rarity. Two sets link only if they share one of the first n - ceil(.75 n) + 1
   elements, where the elements of one document alone come first. So most documents drop out, and the rest have short
   prefixes of their rarest shared shingles. Documents with equal sets form a class and go on as one.
3. Classes that share a prefix shingle are tied to the least of them; the components of these ties are blocks. Every link
   lies within a block, and no pairs are made: a shingle with k classes gives k - 1 ties.
4. In each block a prefix tree of its sets is probed set by set, and sets that link are united. A block too large for a
   task is dealt out in parts, see _large_blocks.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import prefixtree
from lodestar.llm.chunktable import slices
from lodestar.llm.columns import quoted
from lodestar.llm.components import connect
from lodestar.llm.shingles import WORDS, shingle_sets
from lodestar.session import materialize

#: Characters of text whose shingles meet in one bucket; classes that one task joins; pivots of a large block.
BUCKET_CHARS, BLOCK_CLASSES, PIVOTS = 4_000_000, 1500, 32
#: Bits of an entry that tell its place, and those that tell its shingle (within a bucket); buckets at least.
_REF, _LOW, BUCKETS = np.uint64(20), np.uint64((1 << 44) - 1), 64
_DEALT = "bucket int, batch long, kind int, a binary, b binary"
_SINGLE, _SEVERAL, _DOCS, _SHARED = range(4)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], ["bucket", "batch", "kind", "a", "b"])


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if lo < hi]


def _least_share(n: int) -> int:
    return -(-prefixtree.LEAST * n // prefixtree.PER)


def _deal(buckets: int, words: int):
    """Shingles of a batch of documents, dealt to buckets.

    An entry is the lower 44 bits of a hash and a place of 20 bits: of the document, or, for a shingle that several
    documents of the batch have, of a list that stays with the batch. So a shingle gives one entry a batch, however
    common it is. A slice of rows with more places than that is halved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            left = list(slices(batch.column(1)))[::-1]
            while left:
                x, y = left.pop()
                ids = batch.column(0).slice(x, y - x)
                sets = shingle_sets([t.encode() for t in batch.column(1).slice(x, y - x).to_pylist()], words)
                sizes = np.array([len(s) for s in sets], np.int64)
                every = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
                order = np.argsort(every, kind="stable")
                every, doc = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
                begin = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
                count = np.diff(np.append(begin, len(every)))
                several = count > 1
                if y - x > 1 and len(sets) + int(several.sum()) >= 1 << int(_REF):
                    left += [((x + y) // 2, y), (x, (x + y) // 2)]
                    continue
                place = doc[begin]
                place[several] = len(sets) + np.arange(several.sum())
                member = np.repeat(several, count)
                home = ((every[begin] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                entry = (every[begin] & _LOW) << _REF | place.astype(np.uint64)
                held = {
                    "ids": ids.to_pylist(),
                    "n": sizes,
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "lists": np.cumsum(np.concatenate([[0], count[several]])),
                    "docs": doc[member].astype(np.int32),
                }
                rows = [(number % buckets, number, _DOCS, pickle.dumps(held), None)]
                for kind, chosen in ((_SINGLE, ~several), (_SEVERAL, several)):
                    at, e, c = home[chosen], entry[chosen], count[chosen]
                    for lo, hi in _stretches(at):
                        rows.append((int(at[lo]), number, kind, e[lo:hi].tobytes(), c[lo:hi].astype("<u4").tobytes() if kind == _SEVERAL else None))
                yield _rows(rows)
                number += 1

    return run


def _count(table: pa.Table) -> pa.Table:
    """For one bucket: tells every batch which of its entries are of a shingle that is in several documents, and how many."""
    rows = table.to_pylist()
    out = [(r["bucket"], r["batch"], _DOCS, r["a"], None) for r in rows if r["kind"] == _DOCS]
    rows = [r for r in rows if r["kind"] != _DOCS]
    if rows:
        entries = [np.frombuffer(r["a"], "<u8") for r in rows]
        weight = np.concatenate([np.frombuffer(r["b"], "<u4").astype(np.int64) if r["kind"] == _SEVERAL else np.ones(len(e), np.int64) for r, e in zip(rows, entries, strict=True)])
        owner = np.repeat(np.arange(len(rows)), [len(e) for e in entries])
        entry = np.concatenate(entries)
        order = np.argsort(entry >> _REF, kind="stable")
        key = (entry >> _REF)[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        df = np.add.reduceat(weight[order], begin)
        each = np.empty(len(entry), np.int64)
        each[order] = np.repeat(df, np.diff(np.append(begin, len(key))))
        shared = np.flatnonzero(each > 1)
        batches = np.array([r["batch"] for r in rows], np.int64)[owner[shared]]
        by = np.argsort(batches, kind="stable")
        shared, batches = shared[by], batches[by]
        for lo, hi in _stretches(batches):
            some = shared[lo:hi]
            out.append((rows[0]["bucket"], int(batches[lo]), _SHARED, entry[some].tobytes(), np.minimum(each[some], 255).astype(np.uint8).tobytes()))
    return pa.Table.from_batches([_rows(out)])


_SETS = "doc_id long, n long, digest binary, probe int, shared binary"


def _gather(table: pa.Table) -> pa.Table:
    """For one batch: its documents, and for those that may link their shared shingles, the rarest first."""
    rows = table.to_pylist()
    held = pickle.loads(next(r["a"] for r in rows if r["kind"] == _DOCS))
    n, docs = held["n"], len(held["n"])
    back = [r for r in rows if r["kind"] == _SHARED]
    entry = np.concatenate([np.frombuffer(r["a"], "<u8") for r in back]) if back else np.empty(0, np.uint64)
    bucket = np.repeat(np.array([r["bucket"] for r in back], np.uint64), [len(r["b"]) for r in back])
    df = np.concatenate([np.frombuffer(r["b"], np.uint8) for r in back]) if back else np.empty(0, np.uint8)
    token, place = bucket << np.uint64(44) ^ entry >> _REF, (entry & np.uint64((1 << int(_REF)) - 1)).astype(np.int64)
    alone, lists = place < docs, np.diff(held["lists"])
    which = place[~alone] - docs
    size = lists[which]
    ends = np.cumsum(size)
    members = held["docs"][np.repeat(held["lists"][which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    doc = np.concatenate([place[alone], members])
    token = np.concatenate([token[alone], np.repeat(token[~alone], size)])
    df = np.concatenate([df[alone], np.repeat(df[~alone], size)])
    order = np.lexsort((token, df, doc))
    token, found = token[order], np.bincount(doc, minlength=docs)
    ends = np.cumsum(found)
    probe, shared = [], []
    for i in range(docs):
        least = _least_share(int(n[i]))
        may = n[i] > 0 and found[i] >= least
        probe.append(int(found[i] - least + 1) if may and n[i] > 2 else 0)  # one or two shingles link with equal sets only
        shared.append(token[ends[i] - found[i] : ends[i]].tobytes() if may else None)
    return pa.table([pa.array(held["ids"], pa.int64()), pa.array(n), pa.array(held["digest"], pa.binary()), pa.array(probe, pa.int32()), pa.array(shared, pa.binary())], ["doc_id", "n", "digest", "probe", "shared"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class) for the first `probe` shared shingles of each class."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            rows = batch.slice(a, 500).to_pylist()
            tokens = [np.frombuffer(r["shared"], "<u8")[: r["probe"]] for r in rows]
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat([r["class"] for r in rows], [len(t) for t in tokens]))], ["token", "class"])


def _join_block(table: pa.Table) -> pa.Table:
    """(class, root) of the classes of one block or part; rows that come twice count once."""
    rows = {r["class"]: r for r in table.select(["class", "n", "shared"]).to_pylist()}
    classes = sorted(rows)
    found = prefixtree.join([np.frombuffer(rows[c]["shared"], "<u8") for c in classes], [rows[c]["n"] for c in classes])
    return pa.table([pa.array(classes, pa.int64()), pa.array([classes[i] for i in found], pa.int64())], ["class", "root"])


_ROOTS = "class long, root long"


def _large_blocks(members: DataFrame, block_classes: int) -> DataFrame:
    """(class, root) for blocks that are too large for a task; exact, whatever their size.

    First a block is cut into parts, by each class's rarest shared shingle, and each part is joined with the block's
    pivots, a few classes chosen at random; so a mass of classes alike becomes one component. Then every class outside its
    block's largest component is compared with those parts that have a class with one of its prefix shingles: no other
    part can hold a set that links with it. Classes of the largest component need no comparison with each other.
    """
    hot = members.groupBy("block", "first").agg(F.ceil(F.count("*") / block_classes).alias("shares"))
    salted = members.join(hot, ["block", "first"])
    parts = F.ceil(F.col("size") / block_classes).cast("int")
    cut = salted.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("first", F.pmod(F.xxhash64("class"), F.col("shares"))), F.col("parts")).cast("int"))
    cut = materialize(cut.select("block", "part", "parts", "size", "class", "n", "probe", "shared"), "join-cut")
    pivot = F.pmod(F.xxhash64(F.lit("pivot"), "class"), F.col("size")) < PIVOTS
    everywhere = cut.where(pivot).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = cut.where(~pivot).unionByName(everywhere).groupBy("block", "part").applyInArrow(_join_block, _ROOTS)
    first = materialize(first, "join-parts")
    roots = connect(first.select(F.col("class").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "class")
    placed = cut.select("block", "part", "class").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    placed = materialize(placed, "join-roots")
    sizes = placed.groupBy("block", "root").count()
    main = sizes.groupBy("block").agg(F.max_by("root", F.struct("count", "root")).alias("root"))
    rest = placed.join(main, ["block", "root"], "left_anti").select("class", F.col("part").alias("own"))
    prefixes = materialize(cut.select("class", "probe", "shared").mapInArrow(_prefixes, "token long, class long"), "join-prefixes")
    held = prefixes.join(placed.select("class", "block", "part"), "class").select("token", "block", "part").distinct()
    asked = materialize(prefixes.join(rest, "class").join(held, "token").where("part <> own").select("block", "part", "class").distinct(), "join-asked")
    slots = asked.groupBy("block", "part").agg(F.ceil(F.count("*") / block_classes).cast("int").alias("slots"))
    sets = cut.select("class", "n", "shared")
    asking = asked.join(slots, ["block", "part"]).withColumn("slot", F.pmod(F.xxhash64(F.lit("slot"), "class"), F.col("slots")).cast("int")).join(sets, "class")
    against = cut.join(slots, ["block", "part"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    columns = ["block", "part", "slot", "class", "n", "shared"]
    second = asking.select(*columns).unionByName(against.select(*columns)).groupBy("block", "part", "slot").applyInArrow(_join_block, _ROOTS)
    links = first.unionByName(second)
    return connect(links.select(F.col("class").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "class")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, bucket_chars: int = BUCKET_CHARS, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the size of its shingle set and the least key of its component.

    Two rows link when their sets of `words`-word shingles have a Jaccard similarity of at least 0.75, exactly. A null or
    empty text, or one without words, has an empty set and links with nothing; a text of fewer words is one shingle.
    Rows with equal sets share a class, which is named by 64 bits of the set's digest: keys may repeat or be null. A null
    key joins its component, but is never its least key unless it has no other. Repeated rows stay; other columns aren't
    read; a table without rows gives none. Shingles are compared by hashes: sets that are equal by 64 bits of each shingle,
    others by those 44 bits of each that don't choose its bucket (some 4 million characters have one bucket), so that a
    pair of shingles in about 2^44 is taken for one; that alone links no two sets, as those of one or two shingles link
    with equal ones only.
    """
    rows = docs.select(quoted(key).cast("long").alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = max(BUCKETS, math.ceil(chars / bucket_chars))
    dealt = rows.mapInArrow(_deal(buckets, words), _DEALT)
    counted = dealt.groupBy("bucket").applyInArrow(_count, _DEALT)
    sets = materialize(counted.groupBy("batch").applyInArrow(_gather, _SETS), "join-sets")

    alike = sets.where("shared IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first(F.struct("n", "probe", "shared")).alias("s"))
    classes = materialize(alike.select("digest", F.xxhash64("digest").alias("class"), "least", "s.n", "s.probe", "s.shared"), "join-classes")
    prefixes = classes.select("class", "probe", "shared").mapInArrow(_prefixes, "token long, class long")
    hubs = prefixes.groupBy("token").agg(F.min("class").alias("hub"), F.max("class").alias("last")).where("hub <> last").select("token", "hub")
    ties = prefixes.join(hubs, "token").where("class <> hub").select(F.col("class").alias("u"), F.col("hub").alias("v")).distinct()
    blocks = connect(ties).select(F.col("u").alias("class"), F.col("root").alias("block"))
    sized = blocks.join(blocks.groupBy("block").agg(F.count("*").alias("size")), "block")
    rarest = F.substring("shared", 1, 8).alias("first")
    members = materialize(classes.select("class", "n", "probe", rarest, "shared").join(sized, "class"), "join-members")
    roots = members.where(F.col("size") <= block_classes).groupBy("block").applyInArrow(_join_block, _ROOTS)
    large = members.where(F.col("size") > block_classes)
    if large.select("block").limit(1).count():
        roots = roots.unionByName(_large_blocks(large, block_classes))
    rooted = materialize(classes.select("digest", "class", "least").join(roots, "class", "left").select("digest", "least", F.coalesce("root", "class").alias("root")), "join-roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("digest", "component")
    told = sets.select("doc_id", "n", "digest").join(named, "digest", "left")
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the component of each by shingle similarity."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
