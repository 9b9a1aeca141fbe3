"""Entities of the parts table: candidates for aliases and guarded merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import entities
from lodestar.registry import query, table

_NAME = "p_name || ' ' || lower(p_type) || CASE p_partkey % 3 WHEN 0 THEN ' size ' || p_size WHEN 1 THEN ' of  Size ' || p_size ELSE ' model ' || p_partkey % 40 END"
_ENTITIES = f"""e AS (SELECT p_partkey AS id, p_brand AS category, {_NAME} AS name, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' ' || lower(p_type) || ' of size ' || p_size END AS alias, CASE WHEN p_size = 50 THEN 'archived' ELSE 'active' END AS status, CASE WHEN p_partkey % 9 = 0 THEN p_type END AS identity FROM part),
    k AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: length(w) > 1)) AS w, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS key FROM e WHERE status = 'active'),
    pairs AS MATERIALIZED (SELECT a.category, a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS j FROM k a JOIN k b ON a.category = b.category AND a.id < b.id
      WHERE a.key <> b.key AND a.key IS DISTINCT FROM b.alias AND b.key IS DISTINCT FROM a.alias AND (a.alias IS NULL OR a.alias IS DISTINCT FROM b.alias)),
    cand AS MATERIALIZED (SELECT category, a, b, round(j, 4) AS similarity FROM pairs WHERE j >= 0.6)"""


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, name, aliases, status, identity) of every part; one in nine has a guarded identity."""
    alias = "CASE WHEN p_partkey % 7 = 0 THEN array(p_name || ' ' || lower(p_type) || ' of size ' || p_size) END AS aliases"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS category", f"{_NAME} AS name", alias, "CASE WHEN p_size = 50 THEN 'archived' ELSE 'active' END AS status", "CASE WHEN p_partkey % 9 = 0 THEN p_type END AS identity")


@query("alias_candidates", f"WITH {_ENTITIES} SELECT category, a, b, similarity FROM cand")
def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts of a brand whose names are alike, though neither goes by the other's name yet."""
    return entities.alias_candidates(part_entities(spark, sf_dir), 0.6)


_MERGED = f"""{_ENTITIES}, sym AS MATERIALIZED (SELECT a AS u, b AS v, similarity FROM cand UNION ALL SELECT b, a, similarity FROM cand), reach AS (SELECT DISTINCT u, u AS v FROM sym UNION SELECT r.u, s.v FROM reach r JOIN sym s ON s.u = r.v),
    roots AS MATERIALIZED (SELECT u AS id, min(v) AS root FROM reach GROUP BY u), kinds AS (SELECT root, count(DISTINCT identity) AS kinds, max(identity) AS sole FROM roots JOIN e USING (id) GROUP BY root),
    state AS (SELECT id, root, CASE WHEN kinds <= 1 THEN sole ELSE identity END AS identity, kinds > 1 AS divided, 0 AS n FROM roots JOIN kinds USING (root) JOIN e USING (id)
      UNION ALL SELECT s.id, any_value(s.root), coalesce(any_value(s.identity), arg_max(t.identity, {{'similarity': l.similarity, 'near': -l.v}}) FILTER (WHERE t.identity IS NOT NULL)), any_value(s.divided), any_value(s.n) + 1 FROM state s LEFT JOIN sym l ON l.u = s.id LEFT JOIN state t ON t.id = l.v AND s.divided WHERE s.n < 30 GROUP BY s.id),
    ended AS (SELECT id, root, identity, divided FROM state WHERE n = 30)"""


@query("entity_groups", f'WITH RECURSIVE {_MERGED} SELECT id, min(id) OVER (PARTITION BY root, identity) AS "group", identity, divided FROM ended')
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part that has an alias candidate, with the group it merges into; groups of two guarded identities are divided."""
    return entities.merged_entities(part_entities(spark, sf_dir), 0.6)


@query("entity_conflicts", f"WITH RECURSIVE {_MERGED} SELECT a, b, similarity, x.identity AS identity_a, y.identity AS identity_b FROM cand JOIN ended x ON x.id = a JOIN ended y ON y.id = b WHERE x.identity <> y.identity")
def entity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that the guard refuses."""
    parts = part_entities(spark, sf_dir)
    return entities.refused_aliases(parts, entities.merged_entities(parts, 0.6), 0.6)
