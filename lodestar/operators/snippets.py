"""Reading results again: a lexical rerank of a query's pool, the best sentence, and the window around the first match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.scalars import clamp01

# Shares of the rerank's parts, how often a term counts at most, and the marker of a cut.
COVERAGE, PROXIMITY, DENSITY, MOST, ELLIPSIS = 0.6, 0.25, 0.15, 3, "…"


def tokens(text: Column) -> Column:
    """Runs of two or more letters and digits, lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rerank_score(asked: Column, text: Column) -> Column:
    """How well a text answers a query, 0 to 1, by its words alone.

    Mostly the share of the query's distinct words that it has; then how close together they first stand (words found over
    the span of their first places; the share itself for one word), and how often they occur, each counted thrice at most.
    Without a common word, or any words, it is 0.
    """

    def rated(x: Column) -> Column:
        spots = F.transform(x["q"], lambda t: F.struct(F.array_position(x["d"], t).alias("at"), F.least(F.lit(MOST), F.size(F.filter(x["d"], lambda w: w == t))).alias("n")))

        def blended(s: Column) -> Column:
            found = F.filter(F.transform(s, lambda e: e["at"]), lambda p: p > 0)
            share = F.size(found) / F.size(s)
            near = F.when(F.size(found) > 1, clamp01(F.size(found) / (F.array_max(found) - F.array_min(found) + 1))).otherwise(share)
            density = F.aggregate(s, F.lit(0), lambda acc, e: acc + e["n"]) / (MOST * F.size(s))
            return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(clamp01(COVERAGE * share + PROXIMITY * near + DENSITY * density))

        return F.when(F.size(x["q"]) == 0, F.lit(0.0)).otherwise(_let(spots, blended))

    return _let(F.struct(F.array_distinct(tokens(asked)).alias("q"), tokens(text).alias("d")), rated)


def match_offset(text: Column, terms: Column) -> Column:
    """Where the first of any of the lower-case terms stands in the text, from 0, whatever its case; -1 without a match."""
    spots = _let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0))
    return F.coalesce(F.array_min(spots) - 1, F.lit(-1))


def snippet(text: Column, at: Column, most: int) -> Column:
    """At most `most` characters around a place (its head for -1), with a mark where the text goes on; a short text whole."""
    start = F.when((F.length(text) <= most) | (at < 0), F.lit(0)).otherwise(F.greatest(F.lit(0), at - most // 2))
    body = F.substring(text, start + 1, F.lit(most))
    head, tail = F.when(start > 0, ELLIPSIS).otherwise(""), F.when(start + F.length(body) < F.length(text), ELLIPSIS).otherwise("")
    return F.concat(head, body, tail)


def best_span(text: Column, subject: Column) -> Column:
    """The sentence or line that has most of the subject's distinct words, the first of equals; a text without one, trimmed.

    Spans end after . ! ? (or their CJK forms) before white space, and at line ends.
    """
    words = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}_-]+"), lambda w: F.length(w) > 1))
    said = F.coalesce(text, F.lit(""))
    spans = F.filter(F.transform(F.split(said, r"(?<=[.!?。！？])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    rated = F.transform(spans, lambda s, i: F.struct(F.size(F.array_intersect(words(s), subject)).alias("n"), (-i).alias("early"), s.alias("span")))
    return F.coalesce(F.array_max(rated)["span"], F.regexp_replace(said, r"^\s+|\s+$", ""))
