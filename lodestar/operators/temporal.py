"""Times that texts state: the window a query declares, and the validity that a note declares, as column expressions.

Only forms that no language owns count: ISO dates and datetimes, <n>h, <n>d, <n>w, ISO intervals and durations. All is UTC;
the session's time zone must be UTC.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The notation; the age in days from which a window is historical, and what the freshness prior is then worth.
DATE, DATETIME, BACK = r"\d{4}-\d{2}-\d{2}", r"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[Zz]|[+-]\d{2}:?\d{2})?", r"(\d{1,4})([hdwHDW])"
ISO_TOKEN = rf"(?<![0-9-])(?:{DATETIME}|{DATE})(?![0-9-])"
DIRECTIVE = r"(?i)(?:^|\s)(?:since|until):\S+"
HISTORICAL_DAYS, DAMPING = 7, 0.5
HOUR, DAY = 3_600_000, 86_400_000


def _instant(token: Column) -> Column:
    """Milliseconds of an ISO datetime, null if there is no such time; without an offset it is UTC."""
    upper = F.regexp_replace(F.upper(token), r"([+-]\d{2})(\d{2})$", "$1:$2")
    upper = F.regexp_replace(upper, r"^(.{10}T\d{2}:\d{2})(?!:\d{2})", "$1:00")
    zoned = F.when(upper.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), upper).otherwise(F.concat(upper, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(zoned))


def _day(token: Column) -> Column:
    """Milliseconds of the begin of an ISO date, null if there is no such day."""
    return F.unix_millis(F.try_to_timestamp(token, F.lit("yyyy-MM-dd")))


def neutral_point(token: Column, now: dt.datetime, late: bool = False) -> Column:
    """Milliseconds of a time in a form that no language owns, as a begin or an end of a range; null for anything else."""
    now_ms = int(now.replace(tzinfo=dt.UTC).timestamp() * 1000)
    trimmed = F.trim(token)
    unit = F.lower(F.regexp_extract(trimmed, rf"^{BACK}$", 2))
    size = F.when(unit == "h", HOUR).when(unit == "d", DAY).otherwise(7 * DAY)
    ago = F.lit(now_ms) - F.regexp_extract(trimmed, rf"^{BACK}$", 1).try_cast("long") * size
    day = _day(trimmed) + (DAY - 1 if late else 0)
    return F.when(trimmed.rlike(f"^{DATE}$"), day).when(trimmed.rlike(f"^{BACK}$"), ago).when(trimmed.rlike(f"^{DATETIME}$"), _instant(trimmed))


def without_directives(text: Column) -> Column:
    """The query without its since: and until: directives, white space then collapsed; a query without any as it is."""
    return F.when(text.rlike(DIRECTIVE), F.trim(F.regexp_replace(F.regexp_replace(text, DIRECTIVE, " "), r"\s+", " "))).otherwise(text)


def temporal_intent(text: Column, now: dt.datetime) -> Column:
    """struct(since, until, historical, damping, rejected) of the window that a query's text declares, null if it declares none.

    The first since:<time> and until:<time> are the window's ends, the other end is open. Without directives all ISO dates
    and datetimes of the text span it together; those that don't exist are passed over. A directive of another form, or a
    begin after the end, isn't guessed at: rejected is true and the ends are null. A window that ended over a week before
    now is historical and damps the freshness prior. Ends are milliseconds, inclusive.
    """
    now_ms = int(now.replace(tzinfo=dt.UTC).timestamp() * 1000)
    field = lambda name: F.nullif(F.regexp_extract(text, rf"(?i)(?:^|\s){name}:(\S+)", 1), F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(ISO_TOKEN), F.lit(0))
    known = F.filter(F.transform(tokens, lambda t: F.struct(neutral_point(t, now).alias("a"), neutral_point(t, now, late=True).alias("b"))), lambda x: x["a"].isNotNull())

    def told(x: Column) -> Column:  # x: the directives, their ends, and the bare tokens' span
        directed = x["since"].isNotNull() | x["until"].isNotNull()
        bad = (x["since"].isNotNull() & x["begin"].isNull()) | (x["until"].isNotNull() & x["end"].isNull()) | F.coalesce(x["begin"] > x["end"], F.lit(False))
        begin, end = F.when(~directed, x["first"]).when(~bad, x["begin"]), F.when(~directed, x["last"]).when(~bad, x["end"])
        historical = F.coalesce(end < now_ms - HISTORICAL_DAYS * DAY, F.lit(False))
        window = F.struct(begin.alias("since"), end.alias("until"), historical.alias("historical"), F.when(historical, DAMPING).otherwise(1.0).alias("damping"), (directed & bad).alias("rejected"))
        return F.when(directed | x["first"].isNotNull(), window)

    parts = F.struct(
        field("since").alias("since"), field("until").alias("until"), neutral_point(field("since"), now).alias("begin"), neutral_point(field("until"), now, late=True).alias("end"),
        F.array_min(F.transform(known, lambda k: k["a"])).alias("first"), F.array_max(F.transform(known, lambda k: k["b"])).alias("last"),
    )
    return F.element_at(F.transform(F.array(parts), told), 1)


def validity(text: Column, now: dt.datetime) -> Column:
    """struct(valid_from, valid_until) of the validity that a note states; null where it states none.

    An interval of two dates wins; else a duration (P1Y6M, P2W, P10D) from the first date, or from now; else the first date
    alone begins it. Years, months, then days are added by the calendar, a day that a month lacks running over into the
    next. A date that doesn't exist is null.
    """
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))
    interval = rf"\b({DATE})/({DATE})\b"
    # The first P that is a word, as long as its parts go: a bare P, which states nothing, is not passed over for a later one.
    duration = F.regexp_extract(text, r"\b(P(?:\d+Y)?(?:\d+M)?(?:\d+W)?(?:\d+D)?)\b", 1)
    part = lambda unit: F.coalesce(F.regexp_extract(duration, rf"(\d+){unit}", 1).try_cast("int"), F.lit(0))
    lone = F.regexp_extract(text, rf"\b({DATE})\b", 1)
    stated = (part("Y") > 0) | (part("M") > 0) | (part("W") > 0) | (part("D") > 0)
    begin = F.when(lone != "", day(lone)).otherwise(F.lit(now.isoformat(sep=" ", timespec="seconds")).cast("timestamp"))

    def moved(at: Column, months: Column) -> Column:
        first = F.date_trunc("month", at)
        shifted = first + F.make_ym_interval(F.lit(0), months)
        return shifted + (at - first)  # the day and time of the month, run over where the month is shorter

    end = moved(moved(begin, part("Y") * 12), part("M")) + F.make_dt_interval(part("W") * 7 + part("D"))
    struct = lambda a, b: F.struct(a.cast("timestamp").alias("valid_from"), b.cast("timestamp").alias("valid_until"))
    none = F.lit(None).cast("timestamp")
    return (
        F.when(text.rlike(interval), struct(day(F.regexp_extract(text, interval, 1)), day(F.regexp_extract(text, interval, 2))))
        .when(stated, struct(begin, end))
        .when(lone != "", struct(day(lone), none))
    )
