"""Structured Streaming twins of the batch operators.

Each flow takes a streaming frame and returns one; :func:`drain` runs a flow
over what is there now, with checkpoints in the session's shared folder, and
gives the result as a batch frame, which is how the tests and queries use them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.registry import query
from lumora.session import ensure_checkpoint_dir


def read_table_stream(spark: SparkSession, d: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table of a data folder as a stream of its files."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path):
        return r.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return r.parquet(path)


def drain(flow: DataFrame, mode: str = "append") -> DataFrame:
    """Run a flow over all that is available and read back what it wrote."""
    spark = flow.sparkSession
    home = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = flow.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    else:
        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{home}/out")

        q = flow.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(flow.schema).parquet(f"{home}/out")


def windowed_profile(events: DataFrame, width: str = "5 seconds", late: str = "1 hour") -> DataFrame:
    """Q19: events by time bucket and kind, with a watermark for late rows."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_ms"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "max_ms")


def sliding_rate(events: DataFrame, width: str = "10 seconds", slide: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Q20: completions in a sliding window."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("completions"))
    return g.select(F.col("w.end").alias("at"), "completions")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Q16 Q23: results once each, remembered as long as the watermark allows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_ewma(events: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Q11 G-A23: state per key: the weighted mean of durations so far, in time order within a batch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        mean, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            mean = float(v) if mean is None else alpha * float(v) + (1 - alpha) * mean
            n += 1
        state.update((mean, n))
        yield pd.DataFrame({"event_type": [key[0]], "avg_ms": [mean], "samples": [n]})

    return events.groupBy("event_type").applyInPandasWithState(fold, "event_type string, avg_ms double, samples long", "mean double, n long", "update", "NoTimeout")


def each_batch(flow: DataFrame, action: Callable[[DataFrame], DataFrame], key: str, home: str) -> DataFrame:
    """Idempotent incremental sink: rows of ``action`` whose key is not there yet are appended."""
    spark = flow.sparkSession

    def step(batch: DataFrame, _: int) -> None:
        new = action(batch)
        try:
            have = spark.read.parquet(f"{home}/members").select(key)
            new = new.join(have, key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.dropDuplicates([key]).write.mode("append").parquet(f"{home}/members")

    q = flow.writeStream.foreachBatch(step).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{home}/members")


@query("stream_profile", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_profile(spark: SparkSession, d: str) -> DataFrame:
    """Q19: hourly buckets by a stream, complete at the end."""
    got = drain(windowed_profile(read_table_stream(spark, d, "events"), "1 hour"), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_album_add", "SELECT DISTINCT image_id FROM analysis_caption WHERE scene_type = 'street'")
def stream_album_add(spark: SparkSession, d: str) -> DataFrame:
    """Q14: album members added as captions arrive, each once."""
    home = f"{ensure_checkpoint_dir(spark)}/album-{uuid.uuid4().hex}"
    flow = read_table_stream(spark, d, "analysis_caption", 4)
    return each_batch(flow, lambda b: b.filter("scene_type = 'street'").select("image_id"), "image_id", home)


@query("stream_ewma")
def stream_ewma(spark: SparkSession, d: str) -> DataFrame:
    """Q11: weighted means by a stateful stream."""
    return drain(running_ewma(read_table_stream(spark, d, "events").select("event_type", "event_id", "ts", "value")), "update")


@query("stream_dedup", "SELECT count(DISTINCT event_id) AS results FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Q23: distinct results by a stream."""
    flow = deduplicated(read_table_stream(spark, d, "events").select("event_id", "ts"), ["event_id"], "365 days")
    return drain(flow).agg(F.count(F.lit(1)).alias("results"))
