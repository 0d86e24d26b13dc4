"""Registered queries over the driver's tables and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, composites, ingest, joins, predicates, rankings, scalars, streams
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "aggregates", "composites", "ingest", "joins", "predicates", "rankings", "scalars", "streams"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with fusion, pool, blend, cut and seat cap."""
    return QUERIES["j01_hybrid_search"](spark, sf_dir)
