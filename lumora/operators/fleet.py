"""Work-queue, fleet and profiler analytics over an event log.

``events`` stands for transitions: event_type is the module, user_id the image,
event_id the job, value the milliseconds. Skew-prone groups (a module may hold
a third of all rows) are reduced by aggregation or bounded top-N, never by a
window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions.dates import seconds
from lumora.operators.sequence import running_sum, with_day, with_previous
from lumora.registry import query
from lumora.tables import table

_STATUS = "CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'running' WHEN 3 THEN 'skipped' ELSE 'done' END"
_JOBS = f"WITH jobs AS (SELECT event_id AS job_id, user_id AS image_id, event_type AS module, {_STATUS} AS status, CAST(event_id % 4 AS INTEGER) AS attempts, CAST(event_id % 3 AS INTEGER) AS priority, ts AS queued_at, value AS ms, 'node-' || (user_id % 7) AS node FROM events)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """The queue as it stands in the log."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("image_id"), F.col("event_type").alias("module"), F.expr(_STATUS).alias("status"),
        (F.col("event_id") % 4).cast("int").alias("attempts"), (F.col("event_id") % 3).cast("int").alias("priority"), F.col("ts").alias("queued_at"),
        F.col("value").alias("ms"), F.concat(F.lit("node-"), (F.col("user_id") % 7).cast("string")).alias("node"),
    )


_S = ("pending", "running", "done", "failed", "skipped")


@query("queue_pivot", f"{_JOBS} SELECT module, " + ", ".join(f"count_if(status = '{s}') AS {s}" for s in _S) + " FROM jobs GROUP BY 1")
def queue_pivot(spark: SparkSession, d: str) -> DataFrame:
    """G-A2 Q12: jobs by module and status."""
    p = jobs(spark, d).groupBy("module").pivot("status", list(_S)).count()
    return p.select("module", *[F.coalesce(s, F.lit(0)).alias(s) for s in _S])


@query("queue_remaining", f"{_JOBS} SELECT count(DISTINCT CASE WHEN status IN ('pending', 'running') THEN image_id END) AS images, count_if(status IN ('pending', 'running')) AS jobs, count(DISTINCT CASE WHEN status = 'failed' THEN image_id END) AS failed_images FROM jobs")
def queue_remaining(spark: SparkSession, d: str) -> DataFrame:
    """Q12 G-A3: images and jobs still to do."""
    open_ = F.col("status").isin("pending", "running")
    return jobs(spark, d).agg(F.count_distinct(F.when(open_, F.col("image_id"))).alias("images"), F.count_if(open_).alias("jobs"), F.count_distinct(F.when(F.col("status") == "failed", F.col("image_id"))).alias("failed_images"))


@query("queue_running_by_node", f"{_JOBS} SELECT node, count(*) AS running FROM jobs WHERE status = 'running' GROUP BY 1")
def queue_running_by_node(spark: SparkSession, d: str) -> DataFrame:
    """Q12: running jobs by node."""
    return jobs(spark, d).filter("status = 'running'").groupBy("node").agg(F.count(F.lit(1)).alias("running"))


@query("queue_last_n_avg", f"{_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY queued_at DESC, job_id DESC) AS rn FROM jobs WHERE status = 'done') SELECT module, round(avg(ms), 6) AS avg_ms, count(*) AS samples FROM r WHERE rn <= 100 GROUP BY 1")
def queue_last_n_avg(spark: SparkSession, d: str) -> DataFrame:
    """G-A12 W2 Q21: mean of the last hundred durations of each module."""
    n = latest_per_group(jobs(spark, d).filter("status = 'done'"), "module", [F.desc("queued_at"), F.desc("job_id")], 100)
    return n.groupBy("module").agg(F.round(F.avg("ms"), 6).alias("avg_ms"), F.count(F.lit(1)).alias("samples"))


def latest_per_group(df: DataFrame, group: str, order: list[Column], n: int, salts: int = 32) -> DataFrame:
    """First ``n`` rows of each group: per salted part first, then among what those leave.

    No task sorts more than a part of a group, and the second step sees at most
    ``n`` times ``salts`` rows of it. Spark prunes within the window as well.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(salts)))
    part = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).filter(F.col("_rn") <= n)
    return part.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rn") <= n).drop("_salt", "_rn")


@query("queue_claim_order", f"{_JOBS} SELECT job_id, module, priority FROM jobs WHERE status = 'pending' AND attempts <= 2 ORDER BY priority DESC, queued_at, job_id LIMIT 32")
def queue_claim_order(spark: SparkSession, d: str) -> DataFrame:
    """The jobs claimed next."""
    return jobs(spark, d).filter("status = 'pending' and attempts <= 2").orderBy(F.desc("priority"), "queued_at", "job_id").limit(32).select("job_id", "module", "priority")


@query("queue_affinity_order", f"{_JOBS} SELECT job_id, module FROM jobs WHERE status = 'pending' ORDER BY CASE WHEN image_id % 5 = 0 THEN 0 ELSE 1 END, CASE WHEN module = 'click' THEN 0 ELSE 1 END, priority DESC, queued_at, job_id LIMIT 32")
def queue_affinity_order(spark: SparkSession, d: str) -> DataFrame:
    """Claims with preferred images and module first."""
    return jobs(spark, d).filter("status = 'pending'").orderBy(F.when(F.col("image_id") % 5 == 0, 0).otherwise(1), F.when(F.col("module") == "click", 0).otherwise(1), F.desc("priority"), "queued_at", "job_id").limit(32).select("job_id", "module")


@query("queue_pending_by_image", f"{_JOBS} SELECT image_id, count(*) AS jobs, count_if(module = 'purchase') AS urgent, min(queued_at) AS since FROM jobs WHERE status = 'pending' GROUP BY 1")
def queue_pending_by_image(spark: SparkSession, d: str) -> DataFrame:
    """Q17 G-A25: pending jobs by image with what decides their order."""
    return jobs(spark, d).filter("status = 'pending'").groupBy("image_id").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("module") == "purchase").alias("urgent"), F.min("queued_at").alias("since"))


def expire_leases(running: DataFrame, now: Column, ttl_seconds: int, max_attempts: int) -> DataFrame:
    """Running jobs after lease expiry: exhausted ones fail, the others wait again with one more attempt."""
    gone = seconds(F.col("queued_at")) + ttl_seconds <= seconds(now)
    status = F.when(~gone, F.col("status")).when(F.col("attempts") >= max_attempts, "failed").otherwise("pending")
    return running.withColumn("new_status", status).withColumn("new_attempts", F.col("attempts") + F.when(gone & (F.col("attempts") < max_attempts), 1).otherwise(0))


_NOW = "2024-01-15 12:00:00"


@query("queue_lease_expiry", f"{_JOBS}, r AS (SELECT *, epoch_us(queued_at) // 1000000 + 600 <= epoch_us(TIMESTAMP '{_NOW}') // 1000000 AS gone FROM jobs WHERE status = 'running') SELECT CASE WHEN NOT gone THEN status WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS new_status, attempts + CASE WHEN gone AND attempts < 3 THEN 1 ELSE 0 END AS new_attempts, count(*) AS jobs FROM r GROUP BY 1, 2")
def queue_lease_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Q4 Q5: outcome of expired leases."""
    r = expire_leases(jobs(spark, d).filter("status = 'running'"), F.lit(_NOW).cast("timestamp_ntz"), 600, 3)
    return r.groupBy("new_status", "new_attempts").agg(F.count(F.lit(1)).alias("jobs"))


@query("queue_orphans", f"{_JOBS} SELECT job_id FROM jobs WHERE status = 'running' AND node NOT IN (SELECT node FROM jobs WHERE status = 'done' AND queued_at > TIMESTAMP '{_NOW}')")
def queue_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Q5 Q10: running jobs of nodes that were not heard of since."""
    j = jobs(spark, d)
    alive = j.filter((F.col("status") == "done") & (F.col("queued_at") > F.lit(_NOW).cast("timestamp_ntz"))).select("node").distinct()
    return j.filter("status = 'running'").join(alive, "node", "left_anti").select("job_id")


@query("queue_remap", f"{_JOBS}, p AS (SELECT DISTINCT image_id, module FROM jobs WHERE status = 'pending') SELECT image_id, CASE WHEN module = 'view' THEN 'click' ELSE module END AS module FROM p WHERE NOT (module = 'view' AND EXISTS (SELECT 1 FROM p q WHERE q.image_id = p.image_id AND q.module = 'click'))")
def queue_remap(spark: SparkSession, d: str) -> DataFrame:
    """A module renamed, jobs dropped whose target exists."""
    p = jobs(spark, d).filter("status = 'pending'").select("image_id", "module").distinct()
    target = p.filter("module = 'click'").select("image_id", F.lit("view").alias("module"))
    return p.join(target, ["image_id", "module"], "left_anti").select("image_id", F.when(F.col("module") == "view", "click").otherwise(F.col("module")).alias("module"))


@query("queue_prerequisites", f"{_JOBS}, pre AS (SELECT image_id, max(CASE status WHEN 'failed' THEN 3 WHEN 'skipped' THEN 3 WHEN 'running' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END) AS w FROM jobs WHERE module = 'view' GROUP BY 1) SELECT job_id, CASE WHEN w = 3 THEN 'skip' WHEN w = 2 THEN 'defer 30' WHEN w = 1 THEN 'defer 15' ELSE 'run' END AS action FROM jobs LEFT JOIN pre USING (image_id) WHERE module = 'purchase' AND status = 'pending'")
def queue_prerequisites(spark: SparkSession, d: str) -> DataFrame:
    """Q13 Q24: what a job does about the job it needs."""
    j = jobs(spark, d)
    w = F.when(F.col("status").isin("failed", "skipped"), 3).when(F.col("status") == "running", 2).when(F.col("status") == "pending", 1).otherwise(0)
    pre = j.filter("module = 'view'").groupBy("image_id").agg(F.max(w).alias("w"))
    a = F.when(F.col("w") == 3, "skip").when(F.col("w") == 2, "defer 30").when(F.col("w") == 1, "defer 15").otherwise("run")
    return j.filter("module = 'purchase' and status = 'pending'").join(pre, "image_id", "left").select("job_id", a.alias("action"))


@query("fleet_choose_module", f"{_JOBS}, m AS (SELECT module, count_if(status = 'pending') AS pending, avg(ms) AS ms FROM jobs GROUP BY 1) SELECT module, round(pending * ms * CASE WHEN module = 'view' THEN 1.15 ELSE 1 END, 4) AS work FROM m ORDER BY work DESC, module LIMIT 1")
def fleet_choose_module(spark: SparkSession, d: str) -> DataFrame:
    """Q9: the module with most work waiting, the last one favoured."""
    m = jobs(spark, d).groupBy("module").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.avg("ms").alias("ms"))
    work = F.round(F.col("pending") * F.col("ms") * F.when(F.col("module") == "view", 1.15).otherwise(1.0), 4)
    return m.select("module", work.alias("work")).orderBy(F.desc("work"), "module").limit(1)


@query("fleet_claim_policy", f"{_JOBS}, n AS (SELECT count(DISTINCT node) AS nodes, count_if(status = 'pending') AS pending FROM jobs) SELECT nodes, pending, least(3, pending) AS lease_cap, least(4 * 8, 32) AS scan, greatest(8, pending // (nodes + 1)) AS master_share FROM n")
def fleet_claim_policy(spark: SparkSession, d: str) -> DataFrame:
    """Q8: lease cap, scan width and the master's fair share."""
    n = jobs(spark, d).agg(F.count_distinct("node").alias("nodes"), F.count_if(F.col("status") == "pending").alias("pending"))
    return n.select("nodes", "pending", F.least(F.lit(3), "pending").alias("lease_cap"), F.lit(32).alias("scan"), F.greatest(F.lit(8), F.floor(F.col("pending") / (F.col("nodes") + 1))).alias("master_share"))


@query(
    "worker_ewma",
    f"""{_JOBS}, r AS (SELECT node, module, ms, row_number() OVER (PARTITION BY node, module ORDER BY queued_at, job_id) AS i, count(*) OVER (PARTITION BY node, module) AS n FROM jobs WHERE status = 'done')
      SELECT node, module, round(sum(ms * CASE WHEN i = 1 THEN power(0.8::DOUBLE, n - 1) ELSE 0.2::DOUBLE * power(0.8::DOUBLE, n - i) END), 4) AS avg_ms, any_value(n) AS samples FROM r GROUP BY 1, 2""",
)
def worker_ewma(spark: SparkSession, d: str) -> DataFrame:
    """G-A23 Q11: exponentially weighted mean of each worker and module.

    The weight of a sample falls below double precision after some 200 later
    ones, so only the last 400 enter; the first sample's extra weight counts
    only in groups that short. Rank and count come from bounded rows.
    """
    done = jobs(spark, d).filter("status = 'done'").withColumn("g", F.concat_ws("/", "node", "module"))
    total = done.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.first("node").alias("node"), F.first("module").alias("module"))
    last = latest_per_group(done, "g", [F.desc("queued_at"), F.desc("job_id")], 400)
    j = last.withColumn("age", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("queued_at"), F.desc("job_id"))) - 1)
    j = j.select("g", "ms", "age").join(total, "g")
    weight = F.when(F.col("age") == F.col("n") - 1, F.pow(F.lit(0.8), F.col("age"))).otherwise(0.2 * F.pow(F.lit(0.8), F.col("age")))
    return j.groupBy("node", "module").agg(F.round(F.sum(F.col("ms") * weight), 4).alias("avg_ms"), F.first("n").alias("samples"))


def rolling_window(df: DataFrame, t: str, width: int, aggs: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates over the ``width`` seconds up to each row, without a window over all rows.

    Rows are copied into the next time bucket, so each bucket is a partition of
    its own and sees all it needs.
    """
    b = df.withColumn("_own", F.floor(F.col(t) / width)).withColumn("_bucket", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy("_bucket").orderBy(t).rangeBetween(-width, 0)
    for name, agg in aggs.items():
        b = b.withColumn(name, agg.over(w))
    return b.filter("_own = _bucket").drop("_own", "_bucket")


@query("rolling_rate", f"{_JOBS}, t AS (SELECT job_id, (epoch_us(queued_at) // 1000000) AS t FROM jobs WHERE status = 'done'), w AS (SELECT job_id, t, count(*) OVER x AS n, min(t) OVER x AS oldest FROM t WINDOW x AS (ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)) SELECT job_id, n AS completions, round(n / greatest(1, t - oldest)::DOUBLE, 6) AS per_second FROM w")
def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    """Q20 Q22: completions within the last hour and their rate at each completion."""
    j = jobs(spark, d).filter("status = 'done'").select("job_id", seconds(F.col("queued_at")).alias("t"))
    r = rolling_window(j, "t", 3600, {"n": F.count(F.lit(1)), "oldest": F.min("t")})
    return r.select("job_id", F.col("n").alias("completions"), F.round(F.col("n") / F.greatest(F.lit(1), F.col("t") - F.col("oldest")), 6).alias("per_second"))


@query("dedup_results", f"{_JOBS} SELECT node, status, count(*) AS results, max(queued_at) AS last_at FROM (SELECT DISTINCT job_id, queued_at, status, node FROM jobs WHERE status IN ('done', 'failed', 'skipped')) GROUP BY 1, 2")
def dedup_results(spark: SparkSession, d: str) -> DataFrame:
    """Q16 Q23: results counted once by job, time and status."""
    r = jobs(spark, d).filter(F.col("status").isin("done", "failed", "skipped")).dropDuplicates(["job_id", "queued_at", "status"])
    return r.groupBy("node", "status").agg(F.count(F.lit(1)).alias("results"), F.max("queued_at").alias("last_at"))


_EV = "WITH e AS (SELECT event_type, value AS ms, CAST(json_extract(props, '$.k') AS BIGINT) AS batch, ts FROM events)"


def profile_events(spark: SparkSession, d: str) -> DataFrame:
    """Profiler events: module, duration and batch size."""
    return table(spark, d, "events").select("event_type", F.col("value").alias("ms"), F.from_json("props", "k long").getField("k").alias("batch"), "ts")


@query("prof_by_module", f"{_EV} SELECT event_type, count(*) AS n, round(avg(ms), 6) AS avg_ms, round(min(ms), 6) AS min_ms, round(max(ms), 6) AS max_ms, round(sum(ms), 4) AS total_ms FROM e GROUP BY 1")
def prof_by_module(spark: SparkSession, d: str) -> DataFrame:
    """G-A10 Q19: durations by module."""
    return profile_events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("avg_ms"), F.round(F.min("ms"), 6).alias("min_ms"), F.round(F.max("ms"), 6).alias("max_ms"), F.round(F.sum("ms"), 4).alias("total_ms"))


@query("prof_by_batch", f"{_EV} SELECT batch, count(*) AS n, round(avg(ms), 6) AS avg_ms FROM e GROUP BY 1")
def prof_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """G-A10: durations by batch size."""
    return profile_events(spark, d).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("avg_ms"))


@query("prof_throughput", f"{_EV} SELECT event_type, round(count(*) / (sum(ms) / 1000), 6) AS per_second FROM e GROUP BY 1 HAVING sum(ms) > 0")
def prof_throughput(spark: SparkSession, d: str) -> DataFrame:
    """G-A10: events per second of work."""
    return profile_events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("s")).filter("s > 0").select("event_type", F.round(F.col("n") / (F.col("s") / 1000), 6).alias("per_second"))


@query("prof_bottleneck", f"{_EV}, t AS (SELECT event_type, sum(ms) AS total FROM e GROUP BY 1) SELECT event_type, round(total, 4) AS total_ms, round(total / (SELECT sum(total) FROM t), 6) AS share FROM t ORDER BY total DESC, event_type LIMIT 1")
def prof_bottleneck(spark: SparkSession, d: str) -> DataFrame:
    """G-A11: the module that takes most time."""
    t = profile_events(spark, d).groupBy("event_type").agg(F.sum("ms").alias("total"))
    g = t.agg(F.max_by("event_type", "total").alias("event_type"), F.max("total").alias("m"), F.sum("total").alias("s"))
    return g.select("event_type", F.round("m", 4).alias("total_ms"), F.round(F.col("m") / F.col("s"), 6).alias("share"))


@query("prof_hit_rate", f"{_EV} SELECT round(count_if(event_type = 'click') / count(*)::DOUBLE, 6) AS hit_rate FROM e")
def prof_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    """G-A10: share of events of one kind."""
    return profile_events(spark, d).agg(F.round(F.count_if(F.col("event_type") == "click") / F.count(F.lit(1)), 6).alias("hit_rate"))


@query("prof_percentiles", f"{_EV} SELECT event_type, round(median(ms), 6) AS median_ms, round(list_sort(list(ms))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1], 6) AS p95_ms FROM e GROUP BY 1")
def prof_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """G-A20: exact median and 95th percentile by position.

    Values are counted first, so a group is as long as its distinct values; the
    position is found from running counts over (group, value bucket).
    """
    v = profile_events(spark, d).groupBy("event_type", "ms").agg(F.count(F.lit(1)).alias("c")).withColumn("bucket", F.floor("ms"))
    b = v.groupBy("event_type", "bucket").agg(F.sum("c").alias("bc"))
    w = Window.partitionBy("event_type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.coalesce(F.sum("bc").over(w), F.lit(0)))
    n = b.groupBy("event_type").agg(F.sum("bc").alias("n"))
    inner = F.sum("c").over(Window.partitionBy("event_type", "bucket").orderBy("ms"))
    p = v.withColumn("upto", inner).join(b, ["event_type", "bucket"]).join(n, "event_type")
    p = p.withColumn("hi", F.col("before") + F.col("upto")).withColumn("lo", F.col("hi") - F.col("c"))
    at = lambda k: F.max(F.when((F.col("lo") <= k) & (F.col("hi") > k), F.col("ms")))
    mid1, mid2 = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    p95 = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    g = p.groupBy("event_type").agg(at(mid1).alias("a"), at(mid2).alias("b"), at(p95).alias("p95"))
    return g.select("event_type", F.round((F.col("a") + F.col("b")) / 2, 6).alias("median_ms"), F.round("p95", 6).alias("p95_ms"))


@query("prof_snapshot_5s", f"{_EV} SELECT time_bucket(INTERVAL 5 SECONDS, ts) AS start, count(*) AS n, round(max(ms), 6) AS max_ms FROM e GROUP BY 1")
def prof_snapshot_5s(spark: SparkSession, d: str) -> DataFrame:
    """Q19: five-second buckets of the log."""
    g = profile_events(spark, d).groupBy(F.window("ts", "5 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("ms"), 6).alias("max_ms"))
    return g.select(F.col("w.start").alias("start"), "n", "max_ms")


@query("lru_evict", "WITH o AS (SELECT image_id, file_size, sum(file_size) OVER (ORDER BY file_hash NULLS FIRST, image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT * FROM images) WHERE file_size IS NOT NULL) SELECT image_id, file_size FROM o WHERE coalesce(before, 0) < 1000000000")
def lru_evict(spark: SparkSession, d: str) -> DataFrame:
    """G-A24: the least recently used entries until a gigabyte is free.

    A first pass sums sizes by a prefix of the order, so the running sum is
    taken over the few prefixes first and only inside those that matter.
    """
    i = table(spark, d, "images").dropDuplicates(["image_id"]).filter("file_size is not null").select("image_id", "file_size", "file_hash")
    i = i.withColumn("p", F.coalesce(F.substring("file_hash", 1, 2), F.lit("")))
    g = i.groupBy("p").agg(F.sum("file_size").alias("s"))
    g = g.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = i.join(g.filter("before < 1000000000").select("p", "before"), "p")
    w = Window.partitionBy("p").orderBy(F.asc_nulls_first("file_hash"), "image_id").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("mine", F.col("before") + F.coalesce(F.sum("file_size").over(w), F.lit(0)))
    return near.filter("mine < 1000000000").select("image_id", "file_size")


@query("embedding_staleness", "WITH c AS (SELECT image_id, max(analyzed_at) AS a FROM analysis_caption GROUP BY 1), f AS (SELECT image_id, min(created_at) AS e FROM face_occurrences WHERE embedding IS NOT NULL GROUP BY 1) SELECT count(*) AS images, count_if(f.e IS NULL) AS without_embedding, count_if(f.e < c.a) AS stale FROM c LEFT JOIN f USING (image_id)")
def embedding_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Q25: embeddings older than the analysis of their image."""
    c = table(spark, d, "analysis_caption").groupBy("image_id").agg(F.max("analyzed_at").alias("a"))
    f = table(spark, d, "face_occurrences").filter("embedding is not null").groupBy("image_id").agg(F.min("created_at").alias("e"))
    return c.join(f, "image_id", "left").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("e").isNull()).alias("without_embedding"), F.count_if(F.col("e") < F.col("a")).alias("stale"))


@query("user_sessions", f"WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000000) AS t FROM events), l AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 1800 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM l) SELECT user_id, session::BIGINT AS session, count(*) AS events, max(t) - min(t) AS seconds FROM s GROUP BY 1, 2")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user by gaps of thirty minutes."""
    e = with_day(table(spark, d, "events").select("user_id", "event_id", seconds(F.col("ts")).alias("t")))
    e = with_previous(e, ["user_id"], "event_id", [])
    new = F.when(F.col("t") - F.col("prev.t") <= 1800, 0).otherwise(1)
    s = running_sum(e, ["user_id"], "event_id", new, "session")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), (F.max("t") - F.min("t")).alias("seconds"))

