"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded texts."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.columns import map_column, quoted
from lodestar.llm.sampling import held_out, stratified
from lodestar.session import materialize

#: Training rows of either label (the bound of the sample), entries of the lexicon and of its exceptions at most.
TRAIN_ROWS, ENTRIES, EXCEPTIONS = 4000, 3000, 1000
#: A feature enters with a likelihood-ratio statistic, a weight, and a share of the toxic documents of at least these.
LEAST_G2, LEAST_WEIGHT, LEAST_SHARE = 15.0, 1.0, 0.005
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7
#: How many times a clean document taken for toxic weighs against a toxic one that is missed, in shares of either label.
CAUTION = 3.0

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKE_FROM = "аеорсухіјѕԁһԛԝкмтвнαβεικνορτυχγο"
LOOKALIKE_TO = "aeopcyxijsdhqwkmtbhabeiknoptuxyo"
DIGIT_FROM, DIGIT_TO = "013457@$", "oieastas"

_FOLD = {ord(a): b for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True)} | {ord(a): b for a, b in zip(DIGIT_FROM, DIGIT_TO, strict=True)} | {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in "@$"} | dict.fromkeys([0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF])
_NUMBER = re.compile(r"(?<![^\W\d_])[\d@$]+(?![^\W\d_])")


def fold(text: str) -> str:
    """Lower case; lookalikes, and digits that touch letters, as Latin letters; other signs as spaces; a space around all."""
    return f" {_NUMBER.sub(' ', text.lower()).translate(_FOLD)} "


def features_of(folded: str) -> Counter:
    """Whole words, with a space on both sides, and beginnings of words, with a space before, each with how often it is there.

    A beginning counts once for each distinct word.
    """
    found: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        found[f" {w} "] += n
        for k in PREFIXES:
            if len(w) > k:
                found[f" {w[:k]}"] += 1
    return found


@dataclass
class ToxicLexicon:
    """Entries with weights, clean phrases that contain one, and the logistic scale of (mass, mass per word).

    twice: entries that count only in texts with two matches of them or more.
    """

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    scale: tuple[float, float, float] = (-2.0, 1.0, 0.0)
    twice: frozenset[str] = frozenset()

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        for phrase in self.weights:
            a.add_word(phrase, (len(phrase), phrase))
        if len(a):
            a.make_automaton()
        return a

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def masses(self, texts: list[str]) -> np.ndarray:
        """(sum of weights, words) of texts; a match inside an exception phrase doesn't count, and of overlapping ones the longest does."""
        a, out = self.automaton, np.zeros((len(texts), 2))
        for row, text in enumerate(texts):
            folded = fold(text)
            out[row, 1] = folded.count(" ")
            if not len(a):
                continue
            hits = [(end - size + 1, end, phrase) for end, (size, phrase) in a.iter(folded)]
            spared = sorted((s, -e) for s, e, phrase in hits if phrase is None)
            counted, until, at, safe = Counter(), -1, 0, -1
            for s, e, phrase in sorted((h for h in hits if h[2] is not None), key=lambda h: (h[0], -h[1])):
                while at < len(spared) and spared[at][0] <= s:  # the furthest end of an exception that begins no later
                    safe, at = max(safe, -spared[at][1]), at + 1
                if s > until and e > safe:
                    counted[phrase] += 1
                    until = e - 1  # words share the space between them
            out[row, 0] = sum(n * self.weights[p] for p, n in counted.items() if n > 1 or p not in self.twice)
        return out

    def scores(self, masses: np.ndarray) -> np.ndarray:
        x = _inputs(masses)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.scale), -30, 30)))


def _inputs(masses: np.ndarray) -> np.ndarray:
    """1, damped mass, damped mass per hundred words."""
    return np.stack([np.ones(len(masses)), np.log1p(masses[:, 0]), np.log1p(100 * masses[:, 0] / (masses[:, 1] + 20))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method; both labels weigh the same."""
    b = np.zeros(x.shape[1])
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    penalty = ridge * np.diag([0.01] + [1.0] * (x.shape[1] - 1)) * len(y) / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (each * (y - p)) - penalty @ b)
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _weight_and_g2(t: Column, c: Column, toxic: int, clean: int) -> tuple[Column, Column]:
    """Log-odds of a feature of t toxic and c clean documents less two standard errors, and its likelihood-ratio statistic."""
    share = (t + c) / F.lit(float(max(1, toxic + clean)))
    part = lambda seen, meant: F.when(seen > 0, seen * F.log(seen / F.greatest(meant, F.lit(1e-12)))).otherwise(0.0)
    g2 = 2 * (part(t, toxic * share) + part(c, clean * share) + part(toxic - t, toxic * (1 - share)) + part(clean - c, clean * (1 - share)))
    odds = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
    return odds - 2 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)), g2


def _choose(found: pd.DataFrame) -> dict[str, float]:
    """Entries from the strongest on; a feature goes if a chosen one begins it, or begins with it."""
    chosen: dict[str, float] = {}
    begins: set[str] = set()
    for f, w in found.sort_values(["g2", "feature"], ascending=[False, True])[["feature", "weight"]].itertuples(index=False):
        if f in begins or any(f[:i] in chosen for i in range(1, len(f))):
            continue
        chosen[f] = float(w)
        begins.update(f[:i] for i in range(1, len(f)))
    return chosen


def _cut(x: np.ndarray, y: np.ndarray) -> float:
    """Where to cut x: the share of toxic rows above less CAUTION times that of clean ones is greatest; in the middle of the gap."""
    order = np.argsort(-x, kind="stable")
    x, y = x[order], y[order]
    gain = np.cumsum(y == 1) / max(1, (y == 1).sum()) - CAUTION * np.cumsum(y == 0) / max(1, (y == 0).sum())
    gain[:-1][x[:-1] == x[1:]] = -np.inf  # equal rows stay together
    i = int(np.argmax(gain))
    return float((x[i] + x[i + 1]) / 2) if i + 1 < len(x) else float(x[i] - 1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicLexicon:
    """A lexicon from labelled rows that are not held out: about `rows` of each label. Without labels it is empty.

    Spark counts, over the sample, the documents of each label that have each word and each beginning of a word, and those
    that have it twice; those that speak for the toxic label become entries. Words and pairs of words around an entry that
    occur in clean documents and not in toxic ones become exceptions. A logistic curve over the mass of matched weights and
    the mass by length turns both into a score, and is moved so that THRESHOLD parts the sample's labels best. A key that
    repeats counts once, with its least text; equal texts count once, as toxic if one is; a null key or label, and a label
    without a document, doesn't count.
    """
    key_of, label_of = quoted(key), quoted(label).cast("int")
    known = labels.select(key_of.alias("k"), label_of.alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    sample = stratified(known, "y", "k", rows)  # bounded, so it may be broadcast
    joined = docs.select(key_of.alias("k"), F.coalesce(quoted(text), F.lit("")).alias("t")).join(F.broadcast(sample), "k")
    once_a_key = joined.groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y"))
    texts = materialize(once_a_key.groupBy("t").agg(F.max("y").alias("y")), "toxicity-sample")

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 200):
                part = frame.iloc[a : a + 200]
                once, twice = Counter(), Counter()
                for t, y in zip(part["t"], part["y"], strict=True):
                    for f, n in features_of(fold(t)).items():
                        once[f, y] += 1
                        if n > 1:
                            twice[f, y] += 1
                yield pd.DataFrame([(f, y, n, twice[f, y]) for (f, y), n in once.items()], columns=["feature", "y", "once", "twice"])

    size = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    of = lambda n, y: F.sum(F.when(F.col("y") == y, F.col(n)).otherwise(0)).cast("double")
    counts = texts.mapInPandas(explode, "feature string, y int, once long, twice long").groupBy("feature").agg(*[of(n, y).alias(f"{n}{y}") for n in ("once", "twice") for y in (0, 1)])
    ways = []
    for name in ("once", "twice"):
        t, c = F.col(f"{name}1"), F.col(f"{name}0")
        weight, g2 = _weight_and_g2(t, c, toxic, clean)
        ways.append(F.struct(F.when((t >= max(2.0, LEAST_SHARE * toxic)) & (weight >= LEAST_WEIGHT), g2).otherwise(0.0).alias("g2"), weight.alias("weight"), F.lit(name == "twice").alias("twice")))
    best = counts.withColumn("w", F.when(ways[1]["g2"] > ways[0]["g2"], ways[1]).otherwise(ways[0])).where(F.col("w.g2") >= LEAST_G2)
    found = best.select("feature", "w.*").orderBy(F.desc("g2"), "feature").limit(4 * ENTRIES).toPandas()
    chosen = dict(list(_choose(found).items())[:ENTRIES])
    lexicon = ToxicLexicon(chosen, twice=frozenset(found["feature"][found["twice"]]) & frozenset(chosen))
    if not lexicon.weights:
        return lexicon

    def around(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(phrase, label, documents) of words and pairs of words that hold an entry."""
        a = lexicon.automaton
        for frame in frames:
            rows = []
            for t, y in zip(frame["t"], frame["y"], strict=True):
                folded, phrases = fold(t), set()
                for end, (n, _) in a.iter(folded):
                    s = end - n + 1
                    e = folded.find(" ", max(end, s + 1))
                    phrases.add(folded[s : e + 1])
                    after, before = folded.find(" ", e + 1), folded.rfind(" ", 0, s)
                    if after > 0:
                        phrases.add(folded[s : after + 1])
                    if before >= 0:
                        phrases.add(folded[before : e + 1])
                rows += [(p, y) for p in phrases if p.strip()]
            yield pd.DataFrame(rows, columns=["phrase", "y"]).astype({"y": "int32"})

    spared = texts.mapInPandas(around, "phrase string, y int").groupBy("phrase").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("c"))
    spared = spared.where((F.col("c") >= 3) & (F.col("t") * (clean + 1.0) <= F.col("c") * (toxic + 1.0))).orderBy(F.desc("c"), "phrase").limit(EXCEPTIONS)
    exceptions = {r["phrase"] for r in spared.collect() if r["phrase"] not in lexicon.weights}
    lexicon = ToxicLexicon(lexicon.weights, exceptions, twice=lexicon.twice)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            masses = lexicon.masses(frame["t"].tolist())
            yield pd.DataFrame({"y": frame["y"], "mass": masses[:, 0], "words": masses[:, 1]})

    fitted = texts.mapInPandas(weigh, "y int, mass double, words double").toPandas()  # three numbers for a row of the bounded sample
    x, y = _inputs(fitted[["mass", "words"]].to_numpy()), fitted["y"].to_numpy()
    scale = _logistic(x, y)
    scale[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - _cut(x @ scale, y)
    return ToxicLexicon(lexicon.weights, exceptions, tuple(float(v) for v in scale), lexicon.twice)


def score(docs: DataFrame, lexicon: ToxicLexicon, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from THRESHOLD on) of every whole text.

    A null text is empty and scores as a text without matches; repeated rows score alike; a table without rows gives none.
    All other columns stay, and existing ones of these names are replaced.
    """

    def run(part: pa.Array) -> list[pa.Array]:
        found = lexicon.scores(lexicon.masses(part.to_pylist()))
        return [pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))]

    return map_column(docs, F.coalesce(quoted(text), F.lit("")), [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], run)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: toxicity by a lexicon from labelled documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
