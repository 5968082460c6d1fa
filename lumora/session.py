"""Session settings and reliable materialisation.

Lineage is cut only through tables written to the shared folder that the
cluster names in ``spark.checkpoint.dir``; every executor can read those files,
so the loss of an executor costs a retry and not the job.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "lumora", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LUMORA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The one already set wins, then ``spark.checkpoint.dir``. Only a local
    master, where all executors share this machine, may fall back to a
    temporary folder; elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lumora-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, sizes taken from the files.

    A checkpointed plan would inherit the size its optimiser guessed, and in a
    loop of joins such guesses multiply. :func:`discard` removes the files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path  # noqa: SLF001
    return out


def cut_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` with one row for each ``key``, as a table in the shared folder in ``parts`` buckets of ``key``.

    Joins on ``key`` then move only the other side. Of several rows of one key
    any one stays.
    """
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    df.repartition(parts, key).dropDuplicates([key]).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._cut_path, out._cut_name = path, name  # noqa: SLF001
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete the files of frames made by :func:`cut` that nothing reads any more.

    Also lets Spark drop the shuffle files of plans nobody refers to.
    """
    for df in dfs:
        path = getattr(df, "_cut_path", None)
        if path is None:
            continue
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001
        df._cut_path = None  # noqa: SLF001
        if hasattr(df, "_cut_name"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._cut_name}")  # noqa: SLF001
    if dfs:
        release(dfs[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans nobody refers to any more."""
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()  # noqa: SLF001
    except AttributeError:
        pass


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions that hold at most about ``per_task`` rows each, and no fewer than the session's."""
    return max(parallelism(spark), -(-rows // per_task))
