"""Queries and SQL twins of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumora.llm import cluster, cooccur, encode, mix, neighbours, quality, topn

_MODULES = (neighbours, cluster, cooccur, topn, encode, mix, quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.strip() for m in _MODULES for k, v in m.ORACLES.items()}
