"""Predicates and policy filters with parameters: column expressions, and a chain that says which step rejected a row."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States after which nothing follows, and marks of content that must not be trusted.
TERMINAL = ("done", "closed", "cancelled", "archived", "superseded")
DAY = dt.timedelta(days=1)


def matches_properties(wanted: dict[str, Sequence]) -> Column:
    """All keys must match, each by any accepted value, strings whatever their case; a missing key doesn't match."""
    held = F.lit(True)
    for key, values in wanted.items():
        one = F.lit(False)
        for v in values:
            one = one | (F.lower(F.col(key).cast("string")) == str(v).lower() if isinstance(v, str) else F.col(key) == v)
        held = held & F.coalesce(one, F.lit(False))
    return held


def holds_term(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """Whether any of the columns holds one of the terms, whatever their case; no term is held by nothing."""
    held = F.lit(False)
    for c in columns:
        for t in terms:
            held = held | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t.lower()))
    return held


def _instant(raw: str, late: bool) -> str:
    """A timestamp literal; a date alone is its begin, or its last microsecond."""
    return f"{raw} 23:59:59.999999" if late and re.fullmatch(r"\d{4}-\d{2}-\d{2}", raw) else raw


def in_range(at: Column, since: str | None = None, until: str | None = None) -> Column:
    """Whether an instant is in a range, inclusive at both ends; a date alone as its end means the end of that day."""
    held = at.isNotNull()
    if since is not None:
        held = held & (at >= F.lit(_instant(since, False)).cast("timestamp"))
    if until is not None:
        held = held & (at <= F.lit(_instant(until, True)).cast("timestamp"))
    return held


def valid_at(since: Column, until: Column, at: str) -> Column:
    """Whether a fact holds at an instant: from since on, before until; an open end is null."""
    t = F.lit(at).cast("timestamp")
    return F.coalesce(since <= t, F.lit(True)) & F.coalesce(t < until, F.lit(True))


def expired(expires: Column, at: str) -> Column:
    """Whether a date or timestamp, as text, lies at or before an instant; null and what is no date never expires."""
    return F.coalesce(F.try_to_timestamp(expires) <= F.lit(at).cast("timestamp"), F.lit(False))


def within_days(at: Column, now: str, days: int) -> Column:
    """Whether an instant is at most `days` days before now, and not after it."""
    t = F.lit(now).cast("timestamp")
    return F.coalesce((at >= t - F.expr(f"INTERVAL {int(days)} DAYS")) & (at <= t), F.lit(False))


def has_status(status: Column, wanted: Sequence[str] = TERMINAL) -> Column:
    return F.coalesce(F.lower(F.trim(status)).isin([w.lower() for w in wanted]), F.lit(False))


def visible_to(viewer: str, owner: Column, visibility: Column) -> Column:
    """Rows of the viewer, and public ones; without a visibility a row is public."""
    return F.coalesce(owner == viewer, F.lit(False)) | (F.lower(F.coalesce(visibility, F.lit("public"))) == "public")


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in order; a null check doesn't hold."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def apply_policy(rows: DataFrame, steps: Sequence[tuple[str, Column]], rejected: str = "rejected_by") -> DataFrame:
    """rows with the name of the first step that rejects each, null for those that all steps keep.

    A step is a name and the condition that keeps a row; one that is null rejects. Filter on null for the kept rows: the
    optimizer then pushes the conditions to the scan.
    """
    told = F.lit(None).cast("string")
    for name, keeps in reversed(steps):
        told = F.when(~F.coalesce(keeps, F.lit(False)), F.lit(name)).otherwise(told)
    return rows.withColumn(rejected, told)


def time_point(raw: str, now: dt.datetime, late: bool = False) -> dt.datetime:
    """The instant that a literal names as a begin, or (late) as an end: today, yesterday, last week, last month, 3h, 2d, 1w, a date, a timestamp.

    An end of "today" is now; "yesterday" and a date end a millisecond before the next day; "last week" and "last month" are
    7 and 30 days before now at either end, as are hours, days and weeks. Everything is UTC, so is a timestamp without an
    offset; a day that doesn't exist and anything else is a ValueError.
    """
    text, day = raw.strip().lower(), now.replace(hour=0, minute=0, second=0, microsecond=0)
    back = {"last week": 7 * DAY, "last month": 30 * DAY}
    if text == "today":
        return now if late else day
    if text in back:
        return now - back[text]
    if m := re.fullmatch(r"(\d{1,4})([hdw])", text):
        return now - int(m[1]) * {"h": dt.timedelta(hours=1), "d": DAY, "w": 7 * DAY}[m[2]]
    if text == "yesterday":
        begin = day - DAY
    else:
        point = dt.datetime.fromisoformat(raw.strip())
        point = (point if point.tzinfo else point.replace(tzinfo=dt.UTC)).astimezone(dt.UTC).replace(tzinfo=now.tzinfo)
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            return point
        begin = point
    return begin + DAY - dt.timedelta(milliseconds=1) if late else begin


def time_range(since: str | None, until: str | None, now: dt.datetime) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Both ends of a range, None where open; a begin after the end is a ValueError."""
    begin, end = (time_point(since, now) if since is not None else None), (time_point(until, now, late=True) if until is not None else None)
    if begin is not None and end is not None and begin > end:
        raise ValueError("the begin is after the end")
    return begin, end
