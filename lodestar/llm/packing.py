"""Packing along a space-filling curve: neighbours on a Hilbert curve over projected document vectors share sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.chunktable import byte_table, slices
from lodestar.llm.columns import quoted
from lodestar.session import materialize

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE, END_ID = 2048, 1
#: Buckets of a hashed document vector, axes that it is projected to, bits of an axis on the curve.
BUCKETS, AXES, BITS = 256, 3, 10
#: Tokens of one stretch of the curve, which one task packs. Each stretch ends with one padded sequence.
STRETCH_TOKENS = 3_000_000
SEED = 20


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of cells (rows) on a grid of 2^bits a side, in any number of axes.

    Cells go through the Gray-code form of the curve: from the highest bit down, an axis whose bit is set inverts the
    lower bits of the first axis, else it exchanges them with the first axis; the transposed bits are then interleaved.
    """
    x = np.asarray(cells, np.int64).T.copy()
    axes = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(axes):
            inside = (x[i] & bit) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[-1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(vocabulary: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of an id, sign of an id, axes x buckets random directions); the same everywhere."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, BUCKETS, vocabulary), rng.choice([-1.0, 1.0], vocabulary), rng.standard_normal((AXES, BUCKETS))


def coordinates(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of AXES numbers: each document's hashed vector (signed counts, damped, unit length), projected."""
    bucket, sign, directions = _projection()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(doc * BUCKETS + bucket[ids], weights=sign[ids], minlength=len(lengths) * BUCKETS).reshape(-1, BUCKETS)
    damped = np.sign(counts) * np.sqrt(np.abs(counts))
    norm = np.linalg.norm(damped, axis=1, keepdims=True)
    return (damped / np.where(norm == 0, 1, norm)) @ directions.T


def tokenize(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids as little-endian 16 bits, x array<double>) of every whole text, with end_id after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                values, lengths = byte_table(tokenizer).encode(part.column(1))
                at = coordinates(values, lengths)
                values, lengths = np.insert(values, np.cumsum(lengths), end_id), lengths + 1
                ends = np.cumsum(lengths)
                raw = values.astype("<u2").tobytes()
                ids = pa.array([raw[2 * (e - n) : 2 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths), ids, pa.array(list(at), pa.list_(pa.float64()))], ["doc_id", "n", "ids", "x"])

    rows = docs.select(quoted(key).cast("long").alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, ids binary, x array<double>")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = VOCABULARY, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents packed into sequences of at most `length` tokens.

    A document's tokens are its text's ids and end_id. Its hashed vector is projected to three axes, each axis cut by the
    normal distribution with the mean and deviation of all documents, and the cell's Hilbert key orders documents; equal
    keys are ordered by a hash of the key column, so that a mass of copies spreads over stretches. Range partitions are
    stretches of the curve; a task lays its stretch end to end and cuts it every `length` tokens. Only the last sequence
    of a stretch is short, and a stretch has millions of tokens.

    Returns doc_id, start (ids of the document before the piece), length, ids (little-endian 32 bits), doc_tokens,
    sequence_id (2^32 times the stretch, and the number in it: in order along the curve, unique, not gapless), offset
    (place in the sequence), hilbert. A null text is empty and gives a piece of end_id alone; null and repeated keys are
    kept as rows of their own; other columns, whatever their names, aren't read; no rows give no pieces.
    """
    from statistics import NormalDist

    tokens = materialize(tokenize(docs, key, text, tokenizer, end_id), "packed-tokens")
    figures = tokens.agg(F.sum("n").alias("n"), *[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(AXES) for name, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    mean = np.array([figures[f"mean{i}"] or 0.0 for i in range(AXES)])
    std = np.array([figures[f"std{i}"] or 1.0 for i in range(AXES)])
    cuts = np.array([NormalDist().inv_cdf(k / (1 << BITS)) for k in range(1, 1 << BITS)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(3).flatten()).reshape(-1, AXES)
            key = hilbert_key(np.searchsorted(cuts, (x - mean) / std, "right"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(key)], ["doc_id", "n", "ids", "hilbert"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, at = TaskContext.get().partitionId() << 32, 0  # the stretch's first sequence, and tokens of it so far
        for batch in batches:
            n = np.asarray(batch.column(1), np.int64)
            begin = at + np.cumsum(n) - n
            at += int(n.sum())
            pieces = (begin + n - 1) // length - begin // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            order = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[doc] // length + order
            lo = np.maximum(begin[doc], sequence * length)
            hi = np.minimum(begin[doc] + n[doc], (sequence + 1) * length)
            raw = batch.column(2)
            for a in range(0, len(doc), 4000):
                cut = slice(a, a + 4000)
                ids = [np.frombuffer(raw[int(d)].as_buffer(), "<u2")[s:e].astype("<u4").tobytes() for d, s, e in zip(doc[cut], (lo - begin[doc])[cut], (hi - begin[doc])[cut], strict=True)]
                some = pa.array(doc[cut])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(some), pa.array((lo - begin[doc])[cut]), pa.array((hi - lo)[cut]), pa.array(ids, pa.binary()), pa.array(n[doc][cut]), pa.array(base + sequence[cut]), pa.array((lo - sequence * length)[cut]), batch.column(3).take(some)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "hilbert"],
                )

    curve = tokens.mapInArrow(place, "doc_id long, n long, ids binary, hilbert long")
    stretches = max(1, round((figures["n"] or 0) / STRETCH_TOKENS))
    order = ["hilbert", F.xxhash64("doc_id"), "doc_id"]
    laid = curve.repartitionByRange(stretches, *order).sortWithinPartitions(*order)
    return laid.mapInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, hilbert long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed; the ids of a piece as a checksum."""
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
