"""The registered queries: one for each operator or group of them, named by inventory ids, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import analysis, artifacts, curation, delivery

FLAGSHIP = "a1_a3_score_per_field"
_ALL = curation.QUERIES | analysis.QUERIES | delivery.QUERIES | artifacts.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for name, q in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in _ALL.items() if q[1]}
