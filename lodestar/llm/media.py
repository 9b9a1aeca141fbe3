"""Media columns: payloads stored as FLAC streams, read back, and described."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import anyflac, flac
from lodestar.llm.columns import map_column, quoted

SLICE_BYTES = 3 << 19
BLOCKS = T.ArrayType(T.StructType([T.StructField("sample", T.LongType()), T.StructField("byte", T.LongType())]))


def store_flac(docs: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """docs with the payload column (binary) as a FLAC stream of 8-bit samples, padded with spaces to whole blocks.

    Null and empty payloads give a stream of one block of spaces; equal payloads give equal streams; a table without rows
    gives none. All other columns stay; one named as the output is replaced.
    """

    def run(payloads: pa.Array) -> list[pa.Array]:
        padded = [p + b" " * (-len(p) % flac.BLOCK or (0 if p else flac.BLOCK)) for p in payloads.to_pylist()]
        return [pa.array(flac.encode(padded), pa.binary())]

    return map_column(docs, F.coalesce(quoted(payload), F.lit(b"")), [T.StructField(media, T.BinaryType())], run, SLICE_BYTES)


@dataclass
class Sound:
    """What a stream holds, or why it can't be told."""

    pcm: bytes = b""
    blocks: list[tuple[int, int]] = field(default_factory=list)
    bits: int = 8
    error: str | None = None


def _describe(sounds: list[Sound]) -> list[str]:
    """Loudness, share of sign changes, peak and mean of each payload's samples; "empty" without any."""
    parts = [np.frombuffer(s.pcm, np.uint8).astype(np.int64) - 128 if s.bits <= 8 else np.frombuffer(s.pcm, "<i2" if s.bits <= 16 else "<i4").astype(np.int64) for s in sounds]
    some = [p for p in parts if len(p)]
    if not some:
        return ["empty"] * len(parts)
    sizes = np.array([len(p) for p in some], np.int64)
    x, first = np.concatenate(some), np.cumsum(sizes) - sizes
    change = np.concatenate([[0], (x[1:] < 0) != (x[:-1] < 0)]).astype(np.int64)
    change[first] = 0
    power, turns, peak, total = np.add.reduceat(x * x, first), np.add.reduceat(change, first), np.maximum.reduceat(np.abs(x), first), np.add.reduceat(x, first)
    told = (f"rms={(p / n) ** 0.5:.4f};turns={t / n:.4f};peak={k};mean={m / n:.4f}" for p, t, k, m, n in zip(power.tolist(), turns.tolist(), peak.tolist(), total.tolist(), sizes.tolist(), strict=True))
    return [next(told) if len(p) else "empty" for p in parts]


def read_flac(docs: DataFrame, media: str = "media", pcm: str = "pcm", blocks: str = "blocks", feature: str = "feature", reject: str = "reject") -> DataFrame:
    """docs with the samples of the FLAC column as bytes, where each block of samples starts, and features of the samples.

    Every frame's and every stream's checksum is verified. blocks: (first sample, byte of the frame in the stream), so that
    a reader can start at any block. Samples of up to 8 bits are unsigned bytes, others signed little-endian ones, channels
    one after another. A damaged stream, and one of a kind that isn't read, has null values and says why in reject; a null
    stream has null values and no reject. All other columns stay; those named as outputs are replaced.
    """

    def run(column: pa.Array) -> list[pa.Array]:
        streams = column.to_pylist()
        found = decoded(streams)
        here = [i for i, f in enumerate(found) if f is not None and f.error is None]
        told = dict(zip(here, _describe([found[i] for i in here]), strict=True))
        good = lambda i: i in told
        rows = [[{"sample": s, "byte": b} for s, b in found[i].blocks] if good(i) else None for i in range(len(streams))]
        return [
            pa.array([found[i].pcm if good(i) else None for i in range(len(streams))], pa.binary()),
            pa.array(rows, pa.list_(pa.struct([("sample", pa.int64()), ("byte", pa.int64())]))),
            pa.array([told.get(i) for i in range(len(streams))], pa.string()),
            pa.array([f.error if f else None for f in found], pa.string()),
        ]

    added = [T.StructField(pcm, T.BinaryType()), T.StructField(blocks, BLOCKS), T.StructField(feature, T.StringType()), T.StructField(reject, T.StringType())]
    return map_column(docs, quoted(media), added, run, SLICE_BYTES)


_DAMAGE = (ValueError, IndexError, struct.error)


def decoded(streams: list[bytes | None]) -> list[Sound | None]:
    """Each stream's sound. Streams of this package's kind are read side by side; if one fails, and for others, one by one."""
    out: list[Sound | None] = [None] * len(streams)
    own = [i for i, s in enumerate(streams) if s is not None and flac.is_own(s)]
    for some in [own, *[[i] for i in own]]:  # all at once, then those that are left
        if any(out[i] is None for i in some):
            try:
                for i, pcm, blocks in zip(some, *flac.decode([streams[i] for i in some]), strict=True):
                    out[i] = Sound(pcm, blocks)
            except _DAMAGE as e:
                if len(some) == 1:
                    out[some[0]] = Sound(error=str(e) or "the stream ends early")
    for i, s in enumerate(streams):
        if s is not None and out[i] is None:
            try:
                out[i] = Sound(*anyflac.decode(s))
            except _DAMAGE as e:
                out[i] = Sound(error=str(e) or "the stream ends early")
    return out


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: stored as FLAC and read back; the bytes as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    stored = store_flac(docs.withColumn("n_bytes", F.octet_length("payload").cast("long")), "payload").drop("payload")
    return read_flac(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("blocks").cast("long").alias("n_blocks"),
    )
