"""Token-id files: tokenised documents in ascending key order, with a minimal perfect hash index per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import idfiles
from lodestar.llm.chunktable import slices, word_table
from lodestar.llm.columns import quoted
from lodestar.session import scratch

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Characters of a shard, about; documents that a reader holds at once.
SHARD_CHARS, AT_ONCE = 32_000_000, 1000
MANIFEST = "shard int, name string, n_docs long, n_ids long, low long, high long, nulls boolean"
_MANIFEST = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("nulls", pa.bool_())])
_FOUND = "key long, start long, n_ids long, ids binary"


def open_fs(uri: str):
    """(file system, path) of a URI; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _reader(fs, path: str):
    """read(offset, bytes) of a file."""
    file = fs.open_input_file(path)
    return lambda at, n: file.read_at(n, at)


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = VOCABULARY, end_id: int | None = END_ID, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Tokenise every whole text of docs and write shards into `folder`, in ascending order of `key`; returns the manifest.

    Range partitioning by the key makes a shard per partition, so shard order is key order; rows of one key are ordered by
    a hash of their text, so that a key with very many rows spreads over shards. A task writes files under a name of its
    own attempt and reports it; only reported files count, so a task that is lost or run twice does no harm. A null text
    is empty (its only id is end_id). A null key sorts first and is kept; rows of one key stay next to each other, and the
    index tells them apart by their number in the shard. Other columns aren't read. An empty table gives an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, path = open_fs(folder)
        table, out, ids, null, counts = word_table(tokenizer), None, [], [], []
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                values, lengths = table.encode(part.column(1))
                if end_id is not None:
                    values = np.insert(values, np.cumsum(lengths), end_id)
                    lengths = lengths + 1
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}.ids")
                    out.write(idfiles.header(2))
                out.write(values.astype("<u2").tobytes())
                counts.append(lengths)
                null.append(np.asarray(part.column(0).is_null()))
                ids.append(np.asarray(part.column(0).fill_null(0), np.int64))
        if out is None:
            return
        out.close()
        n, keys, missing = np.concatenate(counts), np.concatenate(ids), np.concatenate(null)
        with fs.open_output_stream(f"{path}/{name}.mph") as index:
            index.write(idfiles.index_bytes(keys, missing, np.cumsum(n) - n, n))
        known = keys[~missing]
        low, high = (int(known[0]), int(known[-1])) if len(known) else (None, None)
        yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "name": name, "n_docs": len(n), "n_ids": int(n.sum()), "low": low, "high": high, "nulls": bool(missing.any())}], _MANIFEST)

    fs, path = open_fs(folder)
    fs.create_dir(path)
    spark = docs.sparkSession
    rows = docs.select(quoted(key).cast("long").alias("k"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    placed = rows.repartitionByRange(max(8, -(-chars // shard_chars)), *order).sortWithinPartitions(*order)
    placed.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _shards(manifest: DataFrame) -> list[dict]:
    """Rows of the manifest in key order, each with `base`, the number of ids before it: a hundred bytes a shard."""
    found, base = [r.asDict() for r in manifest.orderBy("shard").collect()], 0
    for r in found:
        r["base"] = base
        base += r["n_ids"]
    return found


def _found(keys: np.ndarray, null: np.ndarray, starts: np.ndarray, ids: list[np.ndarray]) -> pa.RecordBatch:
    lengths = np.array([len(x) for x in ids], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null), pa.array(starts, pa.int64()), pa.array(lengths), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["key", "start", "n_ids", "ids"])


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: key, start (ids of all documents before it), n_ids, ids (little-endian 32 bits).

    A task lists the keys of its shard, looks each up by hash and fingerprint, and reads the payload by ranges of some
    documents. An index that is damaged or disagrees with its payload is an error.
    """
    shards = _shards(manifest)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                index = idfiles.ShardIndex(_reader(fs, f"{path}/{row['name']}.mph"))
                index.verify()
                payload, at = _reader(fs, f"{path}/{row['name']}.ids"), 0
                listed, null = index.listing(0, index.n)
                starts, counts = index.lookup(idfiles.key_of(listed, idfiles.occurrences(listed, null), null))
                if (starts != np.cumsum(counts) - counts).any() or counts.sum() != row["n_ids"]:
                    raise ValueError(f"shard {row['name']} and its index disagree")
                for a in range(0, index.n, AT_ONCE):
                    part = slice(a, a + AT_ONCE)
                    values = idfiles.read_ids(payload, at, int(counts[part].sum()))
                    yield _found(listed[part], null[part], starts[part] + row["base"], np.split(values, np.cumsum(counts[part])[:-1]))
                    at += len(values)

    if not shards:
        return manifest.sparkSession.createDataFrame([], _FOUND)
    rows = manifest.sparkSession.createDataFrame([(r["name"], r["n_ids"], r["base"]) for r in shards], "name string, n_ids long, base long")
    return rows.repartition(len(shards)).mapInArrow(read, _FOUND)


def lookup(manifest: DataFrame, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of these keys: key, start, n_ids, ids as read_token_files gives them.

    A key's shards follow from their ranges of keys, its slot in each from the index's hash; only that slot and the range
    of ids that it names are read. A key that the files don't hold gives no row, one with several documents all of them;
    keys may repeat (they count once) and be null.
    """
    shards = _shards(manifest)
    known = [i for i, r in enumerate(shards) if r["low"] is not None]
    low, high = (np.array([shards[i][c] for i in known], np.int64) for c in ("low", "high"))
    with_nulls = [i for i, r in enumerate(shards) if r["nulls"]]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                if k is None:
                    rows += [(None, i) for i in with_nulls]
                else:
                    rows += [(k, known[j]) for j in range(int(np.searchsorted(high, k, "left")), int(np.searchsorted(low, k, "right")))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([i for _, i in rows], pa.int32())], ["key", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        opened = None
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = shards[i]
                if opened != i:
                    index, payload, opened = idfiles.ShardIndex(_reader(fs, f"{path}/{row['name']}.mph")), _reader(fs, f"{path}/{row['name']}.ids"), i
                number = 0
                while True:
                    start, count = (int(x[0]) for x in index.lookup(idfiles.key_of(np.array([k or 0]), np.array([number]), np.array([k is None]))))
                    if start < 0:
                        break
                    yield _found(np.array([k or 0]), np.array([k is None]), np.array([start + row["base"]]), [idfiles.read_ids(payload, start, count)])
                    number += 1

    asked = keys.select(quoted(key).cast("long").alias("key")).distinct().mapInArrow(route, "key long, shard int")
    return asked.repartition("shard", "key").sortWithinPartitions("shard", "key").mapInArrow(read, _FOUND)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: written as id files, and read back."""
    folder = scratch(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = read_token_files(write_token_files(docs, folder), folder)
    return back.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
