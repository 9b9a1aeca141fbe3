"""Runs of repeated words: maximal stretches of a text in which words q apart are identical.

Main-Lorentz divide and conquer on interned word ids: every stretch is halved; a run of at least four periods that crosses
the middle has a square that begins or ends there, which the Z-function of the half to the right, or of the reversed half
to the left, shows. All stretches of one depth, of all texts of a batch, are taken together as arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.columns import map_column, quoted

#: A run is at least so long, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
#: ASCII white space, which separates words.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Two moduli and bases of the hashes that long equal stretches are measured by; every found run is then compared itself.
_MODULI, _BASES = (2147483629, 2147483587), (1_000_003, 69_069)
#: Words that are compared one after another before hashes are.
_STEPS = 8
#: Times that the smallest period of a stretch is measured before all that are left.
ROUNDS = 4


class Words:
    """The words of some texts: their bytes, their bounds within the texts, and a number for each distinct word."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = ends[:-1][ends[:-1] < ends[-1]] - ends[0]
        first[begins] = inside[begins]  # a text's first byte doesn't continue the text before
        starts = np.flatnonzero(first)
        self.bytes = data[inside]
        before = np.concatenate([[0], np.cumsum(inside)])  # word bytes before each byte
        self.offsets = np.append(before[starts], before[-1])
        self.bounds = np.searchsorted(starts, ends - ends[0])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.bytes)])
        self.ids = np.asarray(words.dictionary_encode().indices, np.int64)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Each text's kept words, joined by one space."""
        lengths = np.diff(self.offsets)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[kept]
        sizes = lengths[kept] + 1  # with the space before, which a text's first word doesn't have
        leads = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.empty(0, bool)
        sizes = sizes - leads
        out = np.full(int(sizes.sum()), 32, np.uint8)
        ends = np.cumsum(sizes)
        word = np.repeat(kept, lengths)
        place = np.repeat(ends - lengths[kept] - np.cumsum(lengths[kept]) + lengths[kept], lengths[kept]) + np.arange(int(lengths[kept].sum()))
        out[place] = self.bytes[word]
        total = np.zeros(len(self.bounds) - 1, np.int64)
        np.add.at(total, text, sizes)
        offsets = np.concatenate([[0], np.cumsum(total)])
        return pa.Array.from_buffers(pa.large_string(), len(total), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())


class Matches:
    """How far two stretches of an id array agree, to the right and to the left."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.sums: list[tuple[np.ndarray, np.ndarray, int]] = []

    def _prepare(self) -> None:
        for m, base in zip(_MODULI, _BASES, strict=True):
            powers = np.ones(self.n + 1, np.int64)
            have = 1
            while have <= self.n:
                step = pow(base, have, m)
                more = powers[: min(have, self.n + 1 - have)] * step % m
                powers[have : have + len(more)] = more
                have += len(more)
            sums = np.concatenate([[0], np.cumsum((self.ids + 1) % m * powers[:-1] % m)]) % m
            self.sums.append((sums, powers, m))

    def _same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        held = np.ones(len(i), bool)
        for sums, powers, m in self.sums:
            held &= (sums[i + size] - sums[i]) % m * powers[j - i] % m == (sums[j + size] - sums[j]) % m
        return held

    def _extend(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, sign: int) -> np.ndarray:
        size = np.zeros(len(i), np.int64)
        live = np.flatnonzero(room > 0)
        for step in range(_STEPS):
            live = live[self.ids[i[live] + sign * step] == self.ids[j[live] + sign * step]]
            size[live] = step + 1
            live = live[room[live] > step + 1]
            if not len(live):
                return size
        if not self.sums:
            self._prepare()
        low, high, a, b = size[live], room[live], i[live], j[live]
        while (low < high).any():  # the first `low` agree, those after `high` aren't asked about
            middle = (low + high + 1) // 2
            same = self._same(a, b, middle) if sign > 0 else self._same(a - middle + 1, b - middle + 1, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        size[live] = low
        return size

    def right(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j > i on, where j's stay before end."""
        return self._extend(i, j, end - j, 1)

    def left(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j > i back, where i's stay from begin on."""
        return self._extend(i, j, i - begin + 1, -1)


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 3]: rows [0, 0, 1, 1, 1] and numbers [1, 2, 1, 2, 3]."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def find_runs(ids: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """All runs of texts whose ids lie in ids[bounds[k]:bounds[k+1]]: rows (text, start, length, period), sorted, starts within ids.

    least_periods is at least 4. Work is proportional to n log n, and log n more where texts repeat themselves.
    """
    if least_periods < 4:
        raise ValueError("shorter runs need not have a square at the middle")
    matches = Matches(ids)
    text = np.flatnonzero(np.diff(bounds) >= least_words)
    low, high = bounds[text].astype(np.int64), bounds[text + 1].astype(np.int64)
    found = [np.empty((0, 4), np.int64)]
    while len(text):
        middle = (low + high) // 2
        for to_right in (True, False):
            # A square from the middle on, or up to it, of every period that fits.
            row, period = _ragged((high - middle if to_right else middle - low) // 2)
            at = middle[row] if to_right else middle[row] - 1 - period
            same = np.flatnonzero(ids[at] == ids[at + period])
            row, period, at = row[same], period[same], at[same]
            far = lambda k: matches.right(at[k], at[k] + period[k], bounds[text[row[k]] + 1]) if to_right else matches.left(at[k], at[k] + period[k], bounds[text[row[k]]])  # noqa: B023, E731
            z = np.full(len(row), -1)
            for _ in range(ROUNDS):  # within a run of the smallest period no other one begins at its place
                open_ = np.flatnonzero(z < 0)
                least = open_[np.unique(row[open_], return_index=True)[1]]
                z[least] = far(least)
                reach = np.zeros(len(middle), np.int64)
                reach[row[least]] = np.where(z[least] >= period[least], z[least] + period[least], 0)
                z[(z < 0) & (2 * period <= reach[row])] = 0
            rest = np.flatnonzero(z < 0)
            z[rest] = far(rest)
            begin, end = bounds[text[row]], bounds[text[row] + 1]
            square = z >= period
            row, period, at, z, begin, end = (x[square] for x in (row, period, at, z, begin, end))
            if to_right:
                start = at - matches.left(at - 1, at - 1 + period, begin)
                stop = at + period + z
            else:
                start = at - z + 1
                stop = at + period + 1 + matches.right(at + 1, at + period + 1, end)
            size = stop - start
            long = size >= np.maximum(least_words, least_periods * period)
            found.append(np.stack([text[row], start, size, period], 1)[long])
        text, low, high = np.concatenate([text, text]), np.concatenate([low, middle]), np.concatenate([middle, high])
        more = high - low >= least_words
        text, low, high = text[more], low[more], high[more]
    rows = _smallest(np.concatenate(found))
    for _, start, size, period in rows.tolist():  # hashes only measured them
        if not np.array_equal(ids[start : start + size - period], ids[start + period : start + size]):
            raise ArithmeticError("two different stretches of words have equal hashes")
    return rows


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Distinct stretches with their smallest period, by text, start and period."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    new = np.concatenate([[True], (rows[1:, 1:3] != rows[:-1, 1:3]).any(1)])
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1]))]


def _kept(n: int, rows: np.ndarray) -> np.ndarray:
    """Which words stay when of every run only its first period does."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, rows[:, 1] + rows[:, 3], 1)
    np.add.at(change, rows[:, 1] + rows[:, 2], -1)
    return np.cumsum(change)[:-1] == 0


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", words: str = "n_words") -> DataFrame:
    """docs with the runs of every whole text, its number of words, and the text collapsed.

    Words are separated by ASCII white space. runs: array<struct<start, length, period>>, every maximal stretch with
    smallest period q of at least max(6, 4 q) words, by start, then period. collapsed: the words that no run holds after
    its first q, joined by one space. A null or empty text has no words and no runs and collapses to an empty text. Rows
    that repeat have equal results; all other columns stay, one named as an output is replaced; no rows give no rows. A
    text must fit a task's memory some fifty times over as words; texts are taken in slices of some megabytes.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        w = Words(texts)
        rows = find_runs(w.ids, w.bounds)
        ends = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
        start = rows[:, 1] - w.bounds[rows[:, 0]]
        listed = pa.StructArray.from_arrays([pa.array(x) for x in (start, rows[:, 2], rows[:, 3])], names=RUN.names)
        return [pa.ListArray.from_arrays(pa.array(ends), listed), w.joined(_kept(len(w.ids), rows)), pa.array(np.diff(w.bounds))]

    added = [T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType()), T.StructField(words, T.LongType())]
    return map_column(docs, quoted(text), added, run)


def _planted(key: Column, text: Column) -> Column:
    """The text, or for one key in ten its words made periodic from some word on, joined by one space."""
    h = F.crc32(key.cast("string").cast("binary"))
    words = lambda then: F.element_at(F.transform(F.array(F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")), then), 1)  # noqa: E731  split once

    def periodic(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise(text)

    return F.when(h % 10 == 0, words(periodic)).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, one in ten made periodic: number of runs, the longest one, all runs and the collapsed text as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    done = periodic_runs(docs).select("doc_id", "runs", "collapsed")
    # Most words first, then the earliest, then the smallest period.
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    told = done.withColumn("best", F.when(F.size("runs") > 0, best))
    length = -F.col("best.short")
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
