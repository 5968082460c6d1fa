"""Order-dependent helpers that no single group can overload.

A window over (group) sorts a whole group in one task. Here rows are windowed
by (group, day), and what crosses days is carried by one row per group and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def with_day(df: DataFrame) -> DataFrame:
    """``df`` with ``day``, the bucket of its time ``t`` in seconds."""
    return df.withColumn("day", F.floor(F.col("t") / DAY))


def with_previous(df: DataFrame, group: list[str], tie: str, cols: list[str]) -> DataFrame:
    """``df`` (with ``t`` and ``day``) with ``prev``: the struct of ``t``, ``tie`` and ``cols`` of the row before."""
    cur = F.struct("t", tie, *cols)
    local = F.lag(cur).over(Window.partitionBy(*group, "day").orderBy("t", tie))
    days = df.groupBy(*group, "day").agg(F.max(cur).alias("_last"))
    days = days.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*group).orderBy("day"))).drop("_last")
    return df.withColumn("_local", local).join(days, [*group, "day"], "left").withColumn("prev", F.coalesce("_local", "_carry")).drop("_local", "_carry")


def running_sum(df: DataFrame, group: list[str], tie: str, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over its group up to and with each row."""
    d = df.withColumn("_v", value)
    within = F.sum("_v").over(Window.partitionBy(*group, "day").orderBy("t", tie).rowsBetween(Window.unboundedPreceding, 0))
    days = d.groupBy(*group, "day").agg(F.sum("_v").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("_off", F.coalesce(ahead, F.lit(0))).drop("_n")
    return d.withColumn("_w", within).join(days, [*group, "day"], "left").withColumn(name, F.col("_w") + F.col("_off")).drop("_v", "_w", "_off")
