"""Markdown notes: links, wikilinks, entities, sentences, citations, line pointers and slugs, as column expressions.

Every function takes a text column; a null text gives an empty array or a null, an empty text no elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the notation.
CODE = r"(?s)```.*?```|~~~.*?~~~|`[^`\n]*`"
WIKILINK, MARKDOWN_LINK, TAG = r"\[\[([^\[\]\n]+)\]\]", r"\[([^\[\]\n]*)\]\(([^()\s]+)\)", r"(?:^|\s)#([\p{L}\p{N}_/-]*[\p{L}_][\p{L}\p{N}_/-]*)"
EXTERNAL = r"(?i)^(?:[a-z][a-z0-9+.-]*:|//|#)"
CITATION = r"\[Source: ([^,\]\n]+), (\d{4}-\d{2}-\d{2})\]"
POINTER = r"^(.+):L([0-9]+)-L([0-9]+)$"
ABBREVIATIONS = "e.g i.e etc vs cf ca approx dr mr mrs ms prof st no fig min max".split()
#: White space of any script, as within a character class.
SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SECRETS = [r"AKIA[0-9A-Z]{16}", r"ghp_[A-Za-z0-9]{20,}", r"sk-[A-Za-z0-9_-]{16,}", r"(?i)bearer [a-z0-9._~+/-]{16,}=*"]


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def without_code(text: Column) -> Column:
    """The text with fenced and inline code as spaces."""
    return F.regexp_replace(text, CODE, " ")


def wikilink_parts(inner: Column) -> Column:
    """target, anchor, block, alias of what stands between double brackets; empty parts are null."""
    part = lambda pattern: F.nullif(F.trim(F.regexp_extract(inner, pattern, 1)), F.lit(""))
    return F.struct(part(r"^([^|#^]*)").alias("target"), part(r"#([^|#^]*)").alias("anchor"), part(r"\^([^|#^]*)").alias("block"), part(r"\|(.*)$").alias("alias"))


def links(text: Column) -> Column:
    """Distinct links of a note in order: wikilinks, Markdown links to other notes (without fragment), tags.

    Code is left out, as are links to URLs, mail addresses and places in the same note.
    """
    clean = without_code(F.coalesce(text, F.lit("")))
    link = lambda kind, target, label: F.struct(F.lit(kind).alias("kind"), target.alias("target"), label.alias("label"))
    wiki = F.transform(_all(clean, WIKILINK), lambda x: link("wikilink", F.trim(F.regexp_extract(x, r"^([^|#^]*)", 1)), F.trim(F.regexp_extract(x, r"([^|]*)$", 1))))
    pairs = F.arrays_zip(_all(clean, MARKDOWN_LINK, 2).alias("t"), _all(clean, MARKDOWN_LINK, 1).alias("l"))
    inner = F.filter(pairs, lambda x: ~x["t"].rlike(EXTERNAL))
    plain = F.transform(inner, lambda x: link("markdown", F.regexp_replace(x["t"], "#.*$", ""), x["l"]))
    tags = F.transform(_all(clean, TAG), lambda x: link("tag", x, x))
    return F.array_distinct(F.filter(F.concat(wiki, plain, tags), lambda x: x["target"] != ""))


def link_key(name: Column) -> Column:
    """The leaf of a path without .md, in lower case."""
    return F.lower(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.md$", ""))


def resolve_links(found: DataFrame, notes: DataFrame) -> DataFrame:
    """found (source, kind, target, label) with doc, the note that a link names, and how it was found.

    notes: (doc, path, aliases array<string>). A target is a note's path, with or without .md, or else, for a wikilink
    without a slash that is no note's leaf name, an alias of the note with the lowest path. Tags aren't resolved. Notes
    with equal paths count as the least doc. Both sides join by equal keys; nothing is broadcast.
    """
    by_path = notes.groupBy(F.regexp_replace("path", r"\.md$", "").alias("wanted")).agg(F.min("doc").alias("by_path"))
    named = notes.select(F.col("doc"), "path", F.explode("aliases").alias("a"))
    by_alias = named.groupBy(F.lower(F.trim("a")).alias("alias_key")).agg(F.min_by("doc", F.struct("path", "doc")).alias("by_alias"))
    leaves = notes.select(link_key(F.col("path")).alias("alias_key")).distinct().withColumn("is_leaf", F.lit(True))
    keyed = found.withColumns({"wanted": F.when(F.col("kind") != "tag", F.regexp_replace("target", r"\.md$", "")), "alias_key": F.when((F.col("kind") == "wikilink") & ~F.col("target").contains("/"), F.lower(F.trim("target")))})
    joined = keyed.join(by_path, "wanted", "left").join(by_alias, "alias_key", "left").join(leaves, "alias_key", "left")
    alias = F.when(F.col("is_leaf").isNull(), F.col("by_alias"))
    how = F.when(F.col("by_path").isNotNull(), "path").when(alias.isNotNull(), "alias").otherwise("none")
    return joined.select("source", "kind", "target", "label", F.coalesce("by_path", alias).alias("doc"), how.alias("how"))


def entities(text: Column) -> Column:
    """Distinct names in a text, lower case: runs of capitalised words, quoted phrases, camelCase, capitals, letters with digits.

    Names have two characters or more.
    """
    clean = F.coalesce(text, F.lit(""))
    runs = _all(clean, r"\p{Lu}[\p{Ll}\p{N}]+(?: \p{Lu}[\p{Ll}\p{N}]+)+", 0)
    phrases = _all(clean, r'"([^"\n]{2,80})"')
    words = _all(clean, r"[\p{L}\p{N}]+", 0)
    marked = F.filter(words, lambda w: w.rlike(r"^(?:\p{Lu}[\p{Ll}\p{N}]+|\p{Ll}+\p{Lu}[\p{L}\p{N}]*|\p{Lu}{2,}\p{N}*|\p{L}+\p{N}+)$"))
    return F.array_distinct(F.filter(F.transform(F.concat(runs, phrases, marked), lambda x: F.lower(F.trim(x))), lambda x: F.length(x) >= 2))


def trimmed(text: Column) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def sentences(text: Column) -> Column:
    """Sentences of a text, trimmed: cut after . ! ? where white space and then A-Z, a digit, a quote or an open bracket follow.

    A full stop after an abbreviation (in any case, with or without one more stop) or a single letter A-Z doesn't end one.
    """
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    ends = rf"(?<=[.!?])(?<!(?:^|[{SPACE}])(?i:{known})\.?\.)(?<!(?:^|[{SPACE}])[A-Za-z]\.)(?=[{SPACE}]+[A-Z0-9\"'(\[])"
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ends), trimmed), lambda s: s != "")


def citations(text: Column) -> Column:
    """[Source: name, date] marks in order, as (name, date); a date that isn't one is null."""
    clean = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(_all(clean, CITATION, 1).alias("name"), _all(clean, CITATION, 2).alias("day"))
    return F.transform(pairs, lambda x: F.struct(F.trim(x["name"]).alias("name"), F.try_to_timestamp(x["day"], F.lit("yyyy-MM-dd")).cast("date").alias("day")))


def pointer(text: Column) -> Column:
    """path, first and last of a line pointer "path:L1-L9"; null when it isn't one or its ends are in the wrong order."""
    first, last = (F.regexp_extract(text, POINTER, g).try_cast("long") for g in (2, 3))
    return F.when(text.rlike(POINTER) & (first >= 1) & (first <= last), F.struct(F.regexp_extract(text, POINTER, 1).alias("path"), first.alias("first"), last.alias("last")))


def numbered_lines(text: Column, start: int = 1) -> Column:
    """The text with "[n] " before each line."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat(F.lit("["), (i + start).cast("string"), F.lit("] "), line)), "\n")


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case letters and digits with single dashes between, at most `most` characters."""
    dashed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, most), "-$", "")


def redacted(text: Column, mark: str = "[redacted]") -> Column:
    """The text with what looks like a key or token replaced."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def clipped(text: Column, budget: int) -> Column:
    """At most `budget` characters: up to the last sentence end within them, else the last line end, else a hard cut."""
    head = F.substring(text, 1, budget)
    by_sentence, by_line = F.regexp_extract(head, r"^((?s:.*)[.!?])(?:\s|$)", 1), F.regexp_extract(head, r"^((?s:.*))\n", 1)
    return F.when(F.length(text) <= budget, text).when(by_sentence != "", by_sentence).when(by_line != "", by_line).otherwise(head)


def cjk_bigrams(text: Column) -> Column:
    """Distinct tokens of the Han and kana runs of a text: pairs of neighbouring characters, a lone one by itself; Hangul singly."""
    clean = F.coalesce(text, F.lit(""))
    runs = _all(clean, r"[\p{IsHan}]+|[\p{IsHiragana}\p{IsKatakana}]+", 0)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(pairs, _all(clean, r"\p{IsHangul}", 0)))


def quantity(text: Column) -> Column:
    """value and unit of the first quantity: a currency sign and a number, a number and %, or a number and a three-letter code."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    money, percent, coded = (F.regexp_extract(text, p, 1) for p in (rf"[$€£]{number}", rf"{number} ?%", rf"{number} (?:USD|EUR|GBP)"))
    sign = F.regexp_extract(text, rf"([$€£]){number}", 1)
    code = F.when(sign == "$", "USD").when(sign == "€", "EUR").when(sign == "£", "GBP")
    value = F.when(money != "", money).when(percent != "", percent).when(coded != "", coded)
    unit = F.when(money != "", code).when(percent != "", "percent").when(coded != "", F.regexp_extract(text, rf"{number} (USD|EUR|GBP)", 2))
    return F.when(value.isNotNull(), F.struct(value.cast("double").alias("value"), unit.alias("unit")))


def citation_marks(text: Column) -> Column:
    """Every [Source: ...] of a text in order: line, raw, name, day and reason; either name and day, or why it is malformed.

    The name is all before the last comma; the day must exist. reason is "shape" (no name, comma and ISO day) or "day".
    """
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    shape = rf"(?s)^(.*[^{SPACE}])[{SPACE}]*,[{SPACE}]*(\d{{4}}-\d{{2}}-\d{{2}})$"

    def told(raw: Column, line: Column) -> Column:
        inner = trimmed(F.regexp_extract(raw, r"(?s)^\[Source:(.*)\]$", 1))
        day = F.try_to_timestamp(F.regexp_extract(inner, shape, 2), F.lit("yyyy-MM-dd")).cast("date")
        fine = inner.rlike(shape) & day.isNotNull()
        reason = F.when(~inner.rlike(shape), "shape").when(day.isNull(), "day")
        return F.struct(line.cast("long").alias("line"), raw.alias("raw"), F.when(fine, trimmed(F.regexp_extract(inner, shape, 1))).alias("name"), F.when(fine, day).alias("day"), reason.alias("reason"))

    return F.flatten(F.transform(lines, lambda line, i: F.transform(F.regexp_extract_all(line, F.lit(r"\[Source:[^\]]*\]"), F.lit(0)), lambda raw: told(raw, i + 1))))


def cjk_segments(text: Column, words: Column) -> Column:
    """Distinct search tokens of a text: dictionary words of its Han and kana runs, then pairs, other words, and single characters.

    words: an array of dictionary words. From the left of a run the longest word that fits is taken, else one character; a
    run without a word gives its pairs alone. Latin words with digits, _ and - are tokens as they stand. Single characters
    come last, so that they only help where nothing else matches. Null and empty texts have none.
    """
    clean = F.coalesce(text, F.lit(""))
    longest = F.array_sort(F.filter(F.array_distinct(words), lambda w: F.length(w) > 1), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))

    def cut(run: Column) -> Column:
        begin = F.struct(run.alias("rest"), F.array().cast("array<string>").alias("found"))

        def step(s: Column, _: Column) -> Column:
            fits = F.get(F.filter(longest, lambda w: F.startswith(s["rest"], w)), F.lit(0))
            head = F.coalesce(fits, F.left(s["rest"], F.lit(1)))
            longer = F.struct(F.substring(s["rest"], F.length(head) + 1, F.length(s["rest"])).alias("rest"), F.concat(s["found"], F.array(head)).alias("found"))
            return F.when(F.length(s["rest"]) > 0, longer).otherwise(s)

        parts = F.aggregate(F.sequence(F.lit(1), F.length(run)), begin, step, lambda s: s["found"])
        return F.filter(parts, lambda p: F.length(p) > 1)

    runs = _all(clean, r"[\p{IsHan}]+|[\p{IsHiragana}\p{IsKatakana}]+", 0)
    singles = F.filter(F.split(F.array_join(F.concat(runs, _all(clean, r"\p{IsHangul}", 0)), ""), ""), lambda c: c != "")
    latin = _all(clean, r"[[\p{L}\p{N}_\-]&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]+", 0)
    return F.array_distinct(F.concat(F.flatten(F.transform(runs, cut)), cjk_bigrams(text), latin, singles))
