"""Language identification with a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.columns import map_column, quoted
from lodestar.llm.sampling import held_out, stratified

#: Bytes of a window, filter widths, filters of a width, size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 5), 12, 6
#: Training rows of a language (the bound of the sample), passes over them, rows of a step, step size.
TRAIN_ROWS, PASSES, STEP_ROWS, STEP = 1500, 5, 64, 0.01
#: Languages that are learned at most, the most frequent first.
LANGUAGES = 200
UNKNOWN = "und"
_WIDE = max(WIDTHS)


@dataclass
class ByteNetwork:
    """Parameters: byte embedding, filters (_WIDE * EMBEDDING x all filters, zero beyond a filter's width), biases, softmax."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pooled activations before the rectifier, the place of each maximum, embedded patches) of rows of bytes."""
        padded = np.zeros((len(windows), WINDOW + _WIDE - 1), np.uint8)
        padded[:, :WINDOW] = windows
        embedded = self.embed[padded].reshape(len(windows), -1)
        patches = np.lib.stride_tricks.as_strided(embedded, (len(windows), WINDOW, _WIDE * EMBEDDING), (embedded.strides[0], EMBEDDING * embedded.itemsize, embedded.itemsize))
        found = np.ascontiguousarray(patches).reshape(-1, _WIDE * EMBEDDING) @ self.filters
        found = found.reshape(len(windows), WINDOW, -1)
        return found, patches, padded

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for a in range(0, len(windows), 256):
            found, _, _ = self.features(windows[a : a + 256])
            hidden = np.maximum(found.max(1) + self.bias, 0)
            parts.append(_softmax(hidden @ self.out + self.out_bias))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of WINDOW bytes that cover every text, the text of each row, bytes in each row)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = np.maximum(1, -(-sizes // WINDOW))
    first = np.cumsum(rows) - rows
    out = np.zeros(int(rows.sum()) * WINDOW, np.uint8)
    begin = np.cumsum(sizes) - sizes
    out[np.repeat(first * WINDOW - begin, sizes) + np.arange(int(sizes.sum()))] = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), rows)
    filled = np.minimum(WINDOW, sizes[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)
    return out.reshape(-1, WINDOW), owner, filled


def train(texts: list[bytes], langs: list[str], seed: int = 0) -> ByteNetwork:
    """Fits the network to labelled texts; each pass sees a window of a random place and length of each text."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    weight = len(y) / (len(names) * np.bincount(y, minlength=len(names)))
    n = FILTERS * len(WIDTHS)
    mask = np.zeros((_WIDE * EMBEDDING, n), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        "filters": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(n, np.float32),
        "out": rng.normal(0, 0.2, (n, len(names))).astype(np.float32),
        "out_bias": np.zeros(len(names), np.float32),
    }
    p["embed"][0] = 0
    first, second, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(PASSES):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // STEP_ROWS)):
            x = np.zeros((len(rows), WINDOW), np.uint8)
            for i, r in enumerate(rows):
                size = min(len(texts[r]), int(WINDOW * rng.uniform(0.05, 1) ** 0.7) + 4, WINDOW)
                at = rng.integers(0, len(texts[r]) - size + 1)
                x[i, :size] = np.frombuffer(texts[r][at : at + size], np.uint8)
            net = ByteNetwork(names, **p)
            found, patches, padded = net.features(x)
            at = found.argmax(1)  # rows x filters
            pooled = np.take_along_axis(found, at[:, None, :], 1)[:, 0] + p["bias"]
            hidden = np.maximum(pooled, 0)
            error = _softmax(hidden @ p["out"] + p["out_bias"])
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= (weight[y[rows]] / len(rows))[:, None]
            back = (error @ p["out"].T) * (pooled > 0)
            best = patches[np.arange(len(rows))[:, None], at]  # rows x filters x patch
            grad = {"out": hidden.T @ error, "out_bias": error.sum(0), "bias": back.sum(0), "filters": np.einsum("rfp,rf->pf", best, back) * mask, "embed": np.zeros_like(p["embed"])}
            to_patch = (back[:, :, None] * p["filters"].T[None]).reshape(len(rows), n, _WIDE, EMBEDDING)
            places = padded[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(_WIDE)]
            np.add.at(grad["embed"], places.ravel(), to_patch.reshape(-1, EMBEDDING))
            grad["embed"][0] = 0
            t += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = (p[k] - STEP * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return ByteNetwork(names, **p)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> ByteNetwork | None:
    """A network from rows that are not held out: about `rows` of each language, a stretch of each text; None without any.

    It learns the LANGUAGES most frequent languages. Rows without a key, a language or a letter don't count.
    """
    slim = docs.select(quoted(key).alias("key"), quoted(text).alias("text"), quoted(lang).alias("lang"))
    labelled = slim.where(~held_out(F.col("key")) & F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    part = stratified(labelled, "lang", "key", rows, LANGUAGES)
    start = F.pmod(F.xxhash64(F.lit("stretch"), F.col("key")), F.greatest(F.lit(1), F.length("text") - 2 * WINDOW)) + 1
    sample = sorted((r[0], r[1], r[2]) for r in part.select("key", F.substring(F.col("text"), start.cast("int"), F.lit(2 * WINDOW)), "lang").collect())
    texts = [(t.encode(), x) for _, t, x in sample if t]
    return train([t for t, _ in texts], [x for _, x in texts]) if texts else None


def predict(docs: DataFrame, network: ByteNetwork | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score: the language of every whole text, from all of its windows, and its probability.

    A text's probabilities are the mean over its windows, weighted by their bytes. A text that is null or has no letter,
    or any text where no network could be fitted, gets "und" and 0. Repeated rows get equal values, of equal probabilities
    the language that sorts first wins, and a table without rows gives none. All other columns stay; existing ones of
    these names are replaced.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        has_letter = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if network is not None and has_letter.any():
            windows, owner, filled = windows_of([t.encode() for t in texts.filter(pa.array(has_letter)).to_pylist()])
            mass = network.probabilities(windows).astype(np.float64) * np.maximum(filled, 1)[:, None]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            mean = np.add.reduceat(mass, first) / np.add.reduceat(np.maximum(filled, 1), first)[:, None]
            lang[has_letter] = np.array(network.langs, object)[mean.argmax(1)]
            score[has_letter] = np.minimum(mean.max(1), 1.0)
        return [pa.array(lang.tolist(), pa.string()), pa.array(score)]

    return map_column(docs, F.coalesce(quoted(text), F.lit("")), [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], run, 2 << 20)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their language by a network that learns from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    done = predict(docs.select("doc_id", "text"), fit(docs))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
