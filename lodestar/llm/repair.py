"""Repair of conversations: the cheapest edits that make the turns a legal conversation.

The edit lattice has a node for each (rows read, state of the roles). A* walks it by (cost + heuristic, audit): the
heuristic is a suffix sum of the deletions that are mandatory and of the charge that a truncated row can't escape, so it
never exceeds the true rest, and of equally cheap edits those with the least audit arrive first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.columns import quoted
from lodestar.session import materialize

SPACES = " \t\n\v\f\r"
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CHARGE = 2, 3, 2, 1
#: States of the roles so far: none, after the system's, after a user's, after an assistant's. Legal ends are NONE and BOTH.
NONE, SYSTEM, USER, BOTH = range(4)
ENDS = (NONE, BOTH)
#: What a role's initial leads to from a state.
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (BOTH, "u"): USER, (USER, "a"): BOTH}
LEGAL_PAIRS = ("su", "ua", "au")
#: Rows that are searched at once; of a longer conversation all ways through each block are found, then joined.
BLOCK = 256
Row = tuple[str, int]  # the role's initial, the fault


def fault_of(role: str, text: str, seen: set) -> int:
    """The first fault of a row; seen gets the row."""
    body = text.rstrip(SPACES)
    if not body:
        seen.add((role, text))
        return BLANK
    if (role, text) in seen:
        return DUPLICATE
    seen.add((role, text))
    return CLEAN if body[-1] in ".!?" else TRUNCATED


def search(rows: Sequence[Row], entry: int = NONE, exits: Sequence[int] = ENDS, first: bool = True) -> dict[int, tuple[int, str]]:
    """{exit: (cost, audit)} of the cheapest ways through the lattice, of the least audit each; only the best one if `first`."""
    rest = [0]
    for _, fault in reversed(rows):
        rest.append(rest[-1] + (DELETE if fault in (BLANK, DUPLICATE) else CHARGE if fault == TRUNCATED else 0))
    rest.reverse()
    heap, closed, found = [(rest[0], "", 0, entry)], set(), {}
    while heap:
        key, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == len(rows) and state in exits:
            found[state] = key, audit
            if first or len(found) == len(exits):
                break
        cost = key - rest[i]
        speak = BOTH if state == USER else USER
        steps = [("I", INSERT, i, speak)]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append(("D", DELETE, i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                charge = CHARGE if fault == TRUNCATED else 0
                if (state, initial) in NEXT:
                    steps.append(("K", charge, i + 1, NEXT[state, initial]))
                steps.append(("R", REROLE + charge, i + 1, speak))
        for letter, price, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(heap, (cost + price + rest[j], audit + letter, j, to))
    return found


Cells = list[tuple[int, int, int, str]]  # entry, exit, cost, audit


def ways(rows: Sequence[Row], entries: Sequence[int]) -> Cells:
    """The cheapest way through the rows from each entry to each exit."""
    cells: Cells = []
    for entry in entries:
        best = {entry: (0, "")}
        for a in range(0, len(rows), BLOCK):
            best = join(best, [(s, e, *way) for s in best for e, way in search(rows[a : a + BLOCK], s, range(4), False).items()])
        cells += [(entry, e, *way) for e, way in best.items()]
    return cells


def join(best: dict[int, tuple[int, str]], cells: Cells) -> dict[int, tuple[int, str]]:
    """Ways so far, by their exit, joined with the ways through what follows.

    Of two equally cheap ways through the same rows to the same exit no audit begins with the other, as it would have more
    insertions; so the lesser one stays less whatever follows.
    """
    out: dict[int, tuple[int, str]] = {}
    for entry, exit_, cost, audit in cells:
        if entry in best:
            way = best[entry][0] + cost, best[entry][1] + audit
            if exit_ not in out or way < out[exit_]:
                out[exit_] = way
    return out


def solve(rows: Sequence[Row]) -> tuple[int, str]:
    """(cost, audit) of the cheapest legal conversation."""
    found = search(rows) if len(rows) <= BLOCK else {e: (c, a) for _, e, c, a in ways(rows, [NONE]) if e in ENDS}
    return min(found.values())


def apply(audit: str, rows: Sequence[tuple[str, str]], entry: int = NONE) -> list[tuple[str, str]]:
    """The (role, text) rows that an audit leaves of rows (role, text)."""
    out, state, i = [], entry, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role, text = ("", "") if letter == "I" else rows[i]
        if letter != "K":
            role = "assistant" if state == USER else "user"
        i += letter != "I"
        state = NEXT[state, role[:1]]
        out.append((role, text))
    return out


class Tally:
    """Counts over a conversation's rows in order, or over a stretch of them."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail")

    def __init__(self):
        self.faults, self.illegal, self.turns, self.low, self.high, self.head, self.tail = [0] * 4, 0, 0, None, None, None, None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.tail = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def values(self) -> tuple:
        return (*self.faults[1:], self.illegal, self.turns, self.low, self.high, self.head, self.tail)


def gaps(turns: int, low: int | None, high: int | None) -> int:
    return 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


REPORT = _long("gaps", "blank", "duplicate", "truncated", "illegal", "cost") + _text("audit")
REPAIRED = T.StructField("repaired", T.ArrayType(T.StructType(_text("role", "text"))))
EDGE = [T.StructField("part", T.IntegerType()), *_long("seq", "turn"), *_text("role", "text")]


def _report(tally: Tally, cost: int, audit: str) -> tuple:
    return (gaps(tally.turns, tally.low, tally.high), *tally.faults[1:], tally.illegal, cost, audit)


def _arrow(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind.field(i).type) for i in range(len(kind))], schema=kind)


def _whole(key, rows: list[tuple]) -> tuple:
    """The output row of a conversation that lies within one partition."""
    seen, tally, read = set(), Tally(), []
    for turn, role, text in rows:
        read.append((role[:1], fault_of(role, text, seen)))
        tally.add(turn, *read[-1])
    cost, audit = solve(read)
    return (key, None, None, None, None, None, *_report(tally, cost, audit), [{"role": r, "text": t} for r, t in apply(audit, [x[1:] for x in rows])])


def _within(schema: T.StructType):
    """Repairs the conversations of a sorted partition; rows of its first and last one, which other partitions may share, go on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        edge = lambda key, n, row: (key, part, n, *row, *[None] * (len(schema) - 6))
        current, held, n, opened, out = None, [], 0, False, []
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), zip(*[c.to_pylist() for c in batch.columns[1:4]], strict=True)
            for key, row in zip(keys, rows, strict=True):
                if n and key != current:
                    if opened:
                        out.append(_whole(current, held))
                    held, opened, n = [], True, 0
                current = key
                if opened:
                    held.append(row)
                else:
                    out.append(edge(key, n, row))
                n += 1
            if out:
                yield _arrow(out, schema)
                out = []
        if held:
            yield _arrow([edge(current, i, row) for i, row in enumerate(held)], schema)

    return run


def _stretches(schema: T.StructType):
    """A row a (conversation, partition): counts, and the cheapest ways through. Rows with seq -1 name rows seen in earlier partitions."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        seen = {(r["role"], r["text"]) for r in rows if r["seq"] < 0}
        tally, read = Tally(), []
        for r in rows:
            if r["seq"] >= 0:
                read.append((r["role"][:1], fault_of(r["role"], r["text"], seen)))
                tally.add(r["turn"], *read[-1])
        cells = [dict(zip(("entry", "exit", "cost", "audit"), c, strict=True)) for c in ways(read, range(4))]
        return pa.Table.from_batches([_arrow([(rows[0]["key"], rows[0]["part"], *tally.values(), cells)], schema)])

    return run


def _joined(schema: T.StructType):
    """The best way through the stretches of one conversation: a row a stretch with its entry and its piece of the audit."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        best, steps = {NONE: (0, "")}, []
        total = Tally()
        for r in rows:
            cells = [(c["entry"], c["exit"], c["cost"], c["audit"]) for c in r["cells"]]
            before, best = best, join(best, cells)
            steps.append((before, cells))
            total.faults = [0, *(a + r[f] for a, f in zip(total.faults[1:], ("blank", "duplicate", "truncated"), strict=True))]
            total.illegal += r["illegal"] + (total.tail is not None and total.tail + r["head"] not in LEGAL_PAIRS)
            total.tail = r["tail"]
            total.turns += r["turns"] - (r["low"] is not None and r["low"] == total.high)
            if r["low"] is not None:
                total.low, total.high = r["low"] if total.low is None else total.low, r["high"]
        cost, audit, state = min((*best[e], e) for e in ENDS if e in best)
        out, spent, left = [], cost, audit
        for r, (before, cells) in zip(reversed(rows), reversed(steps), strict=True):
            entry, price, piece = next((s, c, a) for s, e, c, a in cells if e == state and s in before and before[s][0] + c == spent and before[s][1] + a == left)
            out.append((r["key"], r["part"], entry, piece, *([None] * len(REPORT))))
            state, spent, left = entry, spent - price, left[: len(left) - len(piece)]
        out[-1] = (*out[-1][:4], *_report(total, cost, audit))
        return pa.Table.from_batches([_arrow(out, schema)])

    return run


def _rewritten(schema: T.StructType):
    """The repaired rows of a stretch; the row with seq -1 has its entry (as turn) and audit (as text)."""

    def run(table: pa.Table) -> pa.Table:
        plan, *rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        done = apply(plan["text"], [(r["role"], r["text"]) for r in rows], plan["turn"])
        return pa.Table.from_batches([_arrow([(plan["key"], plan["part"], [{"role": r, "text": t} for r, t in done])], schema)])

    return run


def repair(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (array of role and text).

    A legal conversation's role initials are (s?(ua)+)?. Keep costs 0, Rerole to user or assistant 2, Delete 3 (a must for
    blank rows and those whose role and text came before), Insert of an empty user's or assistant's text 2; a truncated row
    (its last character but for white space isn't one of . ! ?) that stays costs 1. audit has the initials of the cheapest
    edits in order, of equally cheap ones the least.

    Rows are ordered by turn (null first), then role and text; a null role or text is one space; a null key is a
    conversation of its own. Other columns are not read. No rows give no rows. Rows are dealt by ranges of (key, turn), so
    a long conversation spreads over many partitions: within one, conversations are repaired as they pass; those that lie
    at its edges are repaired by stretches, whose ways through are then joined. A conversation's result is one row.
    """
    key_type = messages.select(quoted(key)).schema[0].dataType
    named = lambda *more: T.StructType([T.StructField("key", key_type), *more])
    filled = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    rows = messages.select(quoted(key).alias("key"), quoted(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    # Only rows that are equal in all columns are told apart by their number, so their order is of no matter.
    ordered = rows.withColumns({"start": F.substring("text", 1, 64), "digest": F.md5(F.col("text").cast("binary")), "number": F.monotonically_increasing_id()})
    by = [F.col("key").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "start", "digest", "number"]
    dealt = ordered.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "turn", "role", "text")
    schema = named(*EDGE, *REPORT, REPAIRED)
    first = materialize(dealt.mapInArrow(_within(schema), schema), "repair-within")
    done = first.where("part IS NULL").select("key", *[f.name for f in REPORT], "repaired")
    edges = first.where("part IS NOT NULL").select("key", *[f.name for f in EDGE])

    # Rows of an edge conversation that an earlier partition has had: once a partition, whatever their number.
    distinct = edges.groupBy("key", "role", "text", "part").agg(F.lit(1).alias("one")).drop("one").withColumn("digest", F.md5(F.to_json(F.struct("role", "text")).cast("binary")))
    firsts = distinct.groupBy("key", "digest").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), F.col("digest").alias("d"), "first")
    again = distinct.join(firsts, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")) & (F.col("part") > F.col("first")))
    seen = again.select("key", "part", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("long").alias("turn"), "role", "text")
    cell = T.ArrayType(T.StructType([*_long("entry", "exit", "cost"), *_text("audit")]))
    stretch_schema = named(T.StructField("part", T.IntegerType()), *_long(*Tally.FIELDS[:7]), *_text(*Tally.FIELDS[7:]), T.StructField("cells", cell))
    stretches = edges.unionByName(seen).groupBy("key", "part").applyInArrow(_stretches(stretch_schema), stretch_schema)
    plan_schema = named(T.StructField("part", T.IntegerType()), *_long("entry"), *_text("piece"), *REPORT)
    plans = materialize(stretches.groupBy("key").applyInArrow(_joined(plan_schema), plan_schema), "repair-plans")
    steps = plans.select("key", "part", F.lit(-1).cast("long").alias("seq"), F.col("entry").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("piece").alias("text"))
    piece_schema = named(T.StructField("part", T.IntegerType()), REPAIRED)
    pieces = edges.unionByName(steps).groupBy("key", "part").applyInArrow(_rewritten(piece_schema), piece_schema)
    merged = pieces.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "repaired"))), lambda x: x["repaired"])).alias("repaired"))
    told = plans.where("cost IS NOT NULL").select(F.col("key").alias("k"), *[f.name for f in REPORT])
    joined = told.join(merged, F.col("k").eqNullSafe(F.col("key"))).select("key", *[f.name for f in REPORT], "repaired")
    return done.unionByName(joined).withColumnRenamed("key", key)


def damaged(messages: DataFrame) -> DataFrame:
    """The rows of conversations with one in four damaged: dropped, emptied, without marks, repeated, or given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged: their faults and the cheapest repair, its rows as a digest."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = repair(damaged(messages))
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    counts = [f.name for f in REPORT[:-1]]
    named = done.select(F.col("conv_id").alias("id"), *counts, "audit", F.sha2(said.cast("binary"), 256).alias("repaired_sha256"))
    every = messages.select("conv_id").distinct()
    return every.join(named, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _step(j: str, states: dict[int, list[tuple[int, str, str]]], previous: str) -> str:
    """SQL columns of a step of the lattice: for each state the least (cost, audit) over (state before, cost, letter)."""
    options = {s: ", ".join(f"CASE WHEN {previous}{b} IS NOT NULL AND ({when}) THEN {{'c': {previous}{b}.c + ({price}), 'a': {previous}{b}.a || '{letter}'}} END" for b, price, letter, when in found) for s, found in states.items()}
    return ", ".join(f"least({o}) AS {j}{s}" for s, o in options.items())


def _oracle() -> str:
    charge, stays = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END", "fault NOT IN ('blank', 'duplicate')"
    read = {s: [(s, "3", "D", "TRUE")] for s in range(4)}
    for (before, initial), to in NEXT.items():
        read[to].append((before, charge, "K", f"{stays} AND initial = '{initial}'"))
    for before in range(4):
        read[BOTH if before == USER else USER].append((before, f"2 + {charge}", "R", stays))
    grown = {s: [(s, "0", "", "TRUE")] for s in range(4)}
    for before in range(4):
        grown[BOTH if before == USER else USER].append((before, "2", "I", "TRUE"))
    # Three insertions in a row come back to a state that was there before.
    inserts = lambda source: f"SELECT *, {_step('z', grown, 'y')} FROM (SELECT *, {_step('y', grown, 'x')} FROM ({source}))"
    undo = lambda j: "CASE " + " ".join(f"WHEN s = {b} AND l = '{i}' THEN {t}" for (b, i), t in NEXT.items()) + " ELSE s END"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
    lambda crc, byte: list_reduce([xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1], lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) % 20 AS kind
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, LATERAL (SELECT unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END)) WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged
), told AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN body = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM numbered
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id
), lattice AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': ''}} AS z0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS z1,
    {{'c': 2, 'a': 'I'}} AS z2, {{'c': 4, 'a': 'II'}} AS z3 FROM counted
  UNION ALL
  SELECT conv_id, i, z0, z1, z2, z3 FROM ({inserts(f"SELECT l.conv_id, t.i, {_step('x', read, 'z')} FROM lattice l JOIN told t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i + 1")})
), best AS (
  SELECT conv_id, unnest(least(z0, z3)) FROM lattice QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), walk AS (
  SELECT conv_id, a AS audit, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS i, 0 AS s, '' AS done FROM best
  UNION ALL
  SELECT conv_id, audit, k, i, {undo('')},
    done || CASE WHEN e = 'D' THEN '' ELSE CASE WHEN done = '' THEN '' ELSE chr(10) END || CASE e WHEN 'K' THEN role WHEN 'R' THEN spoken ELSE spoken END || ':' || CASE e WHEN 'I' THEN '' ELSE text END END
  FROM (
    SELECT w.conv_id, w.audit, w.k + 1 AS k, w.i + CASE e WHEN 'I' THEN 0 ELSE 1 END AS i, s, e, t.role, t.text, spoken, done,
      CASE e WHEN 'D' THEN '' WHEN 'K' THEN left(t.role, 1) ELSE left(spoken, 1) END AS l
    FROM (SELECT *, substr(audit, k + 1, 1) AS e, CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END AS spoken FROM walk WHERE k < length(audit)) w
    LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1)
), ended AS (
  SELECT conv_id, audit, done FROM walk WHERE k = length(audit)
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(c, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(done, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP11_SQL = _oracle()
