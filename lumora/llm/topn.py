"""Top N items within every group.

A global sort, range-partitioned on (group, score, identifier), spreads one
group over as many partitions as its rows need, so no task ever holds a whole
group. Each partition counts its groups in one streaming pass and keeps the
rows whose position inside the partition is at most N; the per-partition counts
are then prefix-summed over the partitions of a group into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.session import parallelism
from lumora.tables import current_rows, table, usable_number


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """The ``n`` rows of highest ``score`` of each ``group``, with ``position`` from 1.

    Of equal scores the smaller ``item`` comes first. ``df`` should have one row
    per (group, item); repeats would take positions of their own. Rows with a
    null group, item or score, or a score that is NaN, have no place. Other
    columns are dropped; an empty table gives an empty result.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s")).filter(
        F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s")
    )
    order = [F.col("g").asc(), F.col("s").desc(), F.col("i").asc()]
    ranged = rows.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    types = dict(rows.dtypes)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, seen = None, 0
        for b in batches:
            m = b.num_rows
            if m == 0:
                continue
            codes = pc.run_end_encode(b["g"]).run_ends.to_numpy()
            starts = np.concatenate([[0], codes[:-1]])
            local = np.arange(m) - np.repeat(starts, codes - starts) + 1
            if b["g"][0].as_py() == last:
                local[: codes[0]] += seen
            last, seen = b["g"][m - 1].as_py(), int(local[-1])
            keep = local <= n
            out = b.filter(pa.array(keep))
            k = out.num_rows
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(np.full(k, pid, np.int32)), pa.array(local[keep])], names=["g", "i", "s", "pid", "local"]
            )

    kept = ranged.mapInArrow(prune, f"g {types['g']}, i {types['i']}, s double, pid int, local long")
    # rows kept of a group in a partition = min(count, n), which is all that positions up to n need:
    # the last of them carries that count, and earlier partitions' counts add up to the offset
    per_part = Window.partitionBy("g").orderBy("pid", "local")
    ahead = F.sum(F.lit(1)).over(per_part.rowsBetween(Window.unboundedPreceding, -1))
    placed = kept.withColumn("position", F.coalesce(ahead, F.lit(0)) + 1)
    return placed.filter(F.col("position") <= n).select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("position").cast("int").alias("position")
    )


def best_images(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """The best images of each stored face cluster by current ``perception_iaa``."""
    shown = (
        table(spark, sf_dir, "face_occurrences")
        .select(F.col("cluster_id").cast("long").alias("cluster_id"), "image_id")
        .filter("cluster_id is not null and image_id is not null")
        .distinct()
    )
    scores = current_rows(table(spark, sf_dir, "analysis_perception"), "image_id", ["perception_iaa"]).filter(
        usable_number(F.col("perception_iaa")) & F.col("perception_iaa").between(0, 10)
    )
    return top_n_per_group(shown.join(scores, "image_id"), "cluster_id", "perception_iaa", "image_id", n)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best images of each stored cluster."""
    return best_images(spark, sf_dir).select("cluster_id", "image_id")


QUERIES = {"p5_found": p5_found}
ORACLES = {
    "p5_found": """
    WITH r AS (
      SELECT image_id, perception_iaa AS s,
             row_number() OVER (PARTITION BY image_id ORDER BY analyzed_at DESC NULLS LAST) AS rn
      FROM analysis_perception),
    f AS (SELECT DISTINCT cluster_id::BIGINT AS cluster_id, image_id FROM face_occurrences WHERE cluster_id IS NOT NULL),
    t AS (
      SELECT f.cluster_id, f.image_id, row_number() OVER (PARTITION BY f.cluster_id ORDER BY r.s DESC, f.image_id) AS p
      FROM f JOIN r ON r.image_id = f.image_id AND r.rn = 1
      WHERE r.s IS NOT NULL AND NOT isnan(r.s) AND r.s BETWEEN 0 AND 10)
    SELECT cluster_id, image_id FROM t WHERE p <= 5
    """
}
