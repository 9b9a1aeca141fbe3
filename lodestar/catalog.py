"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar import registry
from lodestar.plans import claims, entities, evidence, filters, folds, graph, health, intents, ledger, notes, ranking, relations, retrieval, temporal, text  # noqa: F401  they register their queries
from lodestar.streaming import ingest  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
