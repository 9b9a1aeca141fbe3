"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def word_list(text: Column) -> Column:
    """Maximal runs of letters and digits, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_set(text: Column) -> Column:
    """Distinct words of letters, digits, _ and -, over one character."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_-]+"), lambda w: F.length(w) > 1))


def significant_terms(text: Column) -> Column:
    """Distinct words of three characters or more, in order."""
    return F.array_distinct(F.filter(word_list(text), lambda w: F.length(w) >= 3))


def token_count(text: Column) -> Column:
    """Pieces between spaces, tabs and line ends."""
    return F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_value(text: Column) -> Column:
    return F.lower(collapse(text))


def basename(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def contains_cjk(text: Column) -> Column:
    return text.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")


def jaccard(a: Column, b: Column) -> Column:
    """0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def weibull_recency(age_days: Column, shape: float = 0.8, scale: float = 30.0, amplitude: float = 0.05, cut: float = 0.0005) -> Column:
    boost = F.lit(amplitude) * F.exp(-F.pow(F.greatest(age_days, F.lit(0.0)) / scale, F.lit(shape)))
    return F.when(boost < cut, F.lit(0.0)).otherwise(boost)


def half_life(strength: Column, age_days: Column, days: float | None) -> Column:
    return strength if days is None else strength * F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0.0)) / days)


def usage_decay(count: Column, age_days: Column, days: float = 30.0, gain: float = 0.25) -> Column:
    return clamp01(F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / days) * (1 + gain * F.log1p(count)))


def wilson_lower(applied: Column, violated: Column, z: float = 1.96) -> Column:
    """Lower bound of the share applied; 0 without evidence."""
    n = (applied + violated).cast("double")
    p = applied / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n)))


def coverage_idf(df: Column, documents: Column) -> Column:
    return F.log(1 + documents / (1 + df))


def proximity(event: Column, since: Column, until: Column, pad_days: int = 7) -> Column:
    """1 inside a window (seconds), falling to 0 over pad_days + 1 days outside."""
    gap = F.greatest(since - event, event - until, F.lit(0)) / 86400.0
    return F.greatest(F.lit(0.0), 1 - gap / (pad_days + 1))


def content_hash(principle: Column, scope: Column) -> Column:
    return F.sha2(F.concat(F.trim(principle), F.lit("\n"), F.trim(F.coalesce(scope, F.lit("")))), 256)


def fold_overlap(since_a: Column, until_a: Column, since_b: Column, until_b: Column) -> Column:
    """Whether closed intervals meet; a null end is open."""
    return F.coalesce(since_a <= until_b, F.lit(True)) & F.coalesce(since_b <= until_a, F.lit(True))
