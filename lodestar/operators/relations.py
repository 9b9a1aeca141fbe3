"""Typed relations of notes: the fields that declare them, and the note that each target names, by three rungs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that declare relations.
RELATIONS = ("related", "extends", "contradicts", "superseded_by", "supports", "derived_from")


def relation_target(raw: Column) -> Column:
    """The bare target of a field's value: pairs of brackets and quotes around it go, then what follows | or #; null if nothing is left."""

    def peel(s: Column, _: Column) -> Column:
        pair = lambda a, b, n: s.startswith(a) & s.endswith(b) & (F.length(s) >= 2 * n)
        inner = lambda n: F.trim(F.substring(s, F.lit(n + 1), F.length(s) - 2 * n))
        return F.when(pair("[[", "]]", 2), inner(2)).when(pair("[", "]", 1) | pair('"', '"', 1) | pair("'", "'", 1), inner(1)).otherwise(s)

    trimmed = F.trim(raw)
    layers = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(trimmed) / 2).cast("int")))
    bare = F.trim(F.regexp_extract(F.aggregate(layers, trimmed, peel), r"^([^|#]*)", 1))
    return F.nullif(bare, F.lit(""))


def relation_edges(notes: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(source, relation, target, pos) of notes (source, fields map<string, array<string>>): every value of a field that declares a relation.

    Field names count in any case, with - or blanks for _. A null or empty value declares nothing; repeats stay.
    """
    named = notes.select("source", F.explode("fields").alias("field", "items"))
    return declared_edges(named.select("source", "field", F.posexplode("items").alias("pos", "raw")), relations)


def declared_edges(values: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """relation_edges of single values (source, field, pos, raw), which need not be brought together by note."""
    relation = F.regexp_replace(F.lower(F.trim("field")), r"[\s-]+", "_")
    each = values.select("source", relation.alias("relation"), "pos", "raw").where(F.col("relation").isin(*relations))
    return each.select("source", "relation", relation_target(F.col("raw")).alias("target"), "pos").where("target IS NOT NULL")


def resolve_edges(edges: DataFrame, notes: DataFrame, leaf_only: bool = False) -> DataFrame:
    """edges with doc and state, the note (doc, path) that each target names and by which rung.

    "path": a note of exactly this path; "file": of this path and .md; "suffix": the only note whose path ends in a slash
    and this and .md (leaf_only: whose leaf name is this). Two such notes leave it "ambiguous", none "dangling", both
    without doc. Of notes with one path the least doc counts. A path's suffixes are as many as its folders, so each rung is
    an equal join; popular targets are one row on the notes' side, so hot edges only skew the edges' side, which may be split.
    """
    own = notes.where("path IS NOT NULL")
    exact = own.groupBy("path").agg(F.min("doc").alias("doc"))
    stem = F.regexp_replace("path", r"\.md$", "")
    parts = F.split(stem, "/")
    tails = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))).otherwise(F.array().cast("array<string>"))
    tails = F.when(F.size(parts) > 1, F.array(F.element_at(parts, -1))).otherwise(F.array().cast("array<string>")) if leaf_only else tails
    suffixes = own.where(F.col("path").endswith(".md")).select("doc", F.explode(tails).alias("target"))
    by_suffix = suffixes.groupBy("target").agg(F.count("*").alias("notes_there"), F.min("doc").alias("by_suffix"))
    joined = (
        edges.join(exact.select(F.col("path").alias("target"), F.col("doc").alias("by_path")), "target", "left")
        .join(exact.where(F.col("path").endswith(".md")).select(stem.alias("target"), F.col("doc").alias("by_file")), "target", "left")
        .join(by_suffix, "target", "left")
    )
    state = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_file").isNotNull(), "file").when(F.col("notes_there") == 1, "suffix").when(F.col("notes_there") > 1, "ambiguous").otherwise("dangling")
    doc = F.coalesce("by_path", "by_file", F.when(F.col("notes_there") == 1, F.col("by_suffix")))
    return joined.select(*edges.columns, doc.alias("doc"), state.alias("state"))
