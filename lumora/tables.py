"""Table access: typed reads, schema conformance, current rows.

A missing table reads as an empty frame, unknown columns are dropped and
missing ones are null-filled, so a partial library still answers queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: extras dropped, missing ones null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def table_or_empty(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """The conformed table, or an empty one where it does not exist."""
    try:
        return conform(table(spark, sf_dir, name), schema)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def current_rows(df: DataFrame, key: str, columns: list[str], version: str = "analyzed_at") -> DataFrame:
    """The row with the latest ``version`` of each ``key``, with the named columns.

    One partial aggregation (``max`` over a struct) instead of a window: a key
    with many versions is reduced map-side and never sorted. Among rows of one
    instant the greatest values win, so the result does not depend on file
    order; exact repeats collapse. Rows with a null key are dropped, a null
    version counts as the oldest.
    """
    best = F.max(F.struct(F.col(version), *[F.col(c) for c in columns])).alias("_best")
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(best)
        .select(key, *[F.col(f"_best.{c}").alias(c) for c in columns])
    )


def current_columns(df: DataFrame, key: str, groups: list[tuple[str, ...]], version: str = "analyzed_at") -> DataFrame:
    """Like :func:`current_rows`, with each group of columns an aggregate of its own.

    The optimiser drops the aggregates of columns that a query does not use, so
    that they are neither read nor shuffled. Among different rows of one instant
    each group takes its own greatest values; a version's columns are otherwise
    those of one row.
    """
    best = [F.max(F.struct(F.col(version), *[F.col(c) for c in g])).alias(f"_{i}") for i, g in enumerate(groups)]
    columns = [F.col(f"_{i}.{c}").alias(c) for i, g in enumerate(groups) for c in g]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*best).select(key, *columns)


def usable_number(c: Column) -> Column:
    """True for a number that is neither null nor NaN nor infinite."""
    d = c.cast("double")
    return c.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
