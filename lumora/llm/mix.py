"""Mixing sources to target weights under a cap on repetition.

Sizes are counted in tokens over all documents and reduced to one row per
source. Capped water-filling then sets how much each source gives: sources that
cannot fill their share are clamped at their cap, and what is missing goes to
the others in proportion to their weights until all fit. Documents are drawn by
whole repetitions plus one more with the fractional probability, decided by a
seeded hash of the identifier, so any executor repeats the same draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.encode import PATTERN, TOKENIZERS
from lumora.tables import table

#: Most sources that the driver fills; one row each.
MAX_SOURCES = 100_000
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):  # noqa: ANN202
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(df: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """``df`` with ``tokens`` (long); null and empty texts have none."""
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(path)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return df.withColumn("tokens", count(F.col(text)))


def water_fill(weights: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """Amounts proportional to ``weights`` that sum to ``total``, none above its cap.

    If all caps together are below ``total``, every source of positive weight
    gives its cap.
    """
    w, caps = np.maximum(weights.astype(float), 0), caps.astype(float)
    out = np.zeros(len(w))
    free, left = w > 0, float(total)
    while free.any() and left > 0:
        want = left * w * free / (w[free].sum())
        over = free & (want >= caps)
        if not over.any():
            out[free] = want[free]
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        free &= ~over
    return out


def mix_plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> pd.DataFrame:
    """One row per target source: what it has, may give, gives, and its share.

    ``sizes`` has ``source`` and ``tokens`` (summed per source), ``targets`` has
    ``source``, ``weight`` and ``max_repeats``. A target without documents has
    no tokens and gives none. A null weight counts as 0, null repeats as 1.
    ``total`` defaults to the tokens of all target sources. ``misses`` marks
    positive weights that water-filling leaves below their share of ``total``.
    """
    t = (
        targets.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
        .join(sizes, "source", "left")
        .limit(MAX_SOURCES + 1)
        .toPandas()
    )
    if len(t) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    t = t.sort_values("source", ignore_index=True)
    t["tokens"] = t["tokens"].fillna(0).astype("int64")
    t["weight"] = t["weight"].fillna(0.0).astype(float)
    t["max_repeats"] = t["max_repeats"].fillna(1).astype("int64").clip(lower=0)
    whole = float(t["tokens"].sum() if total is None else total)
    t["target_tokens"] = t["weight"] * whole
    t["cap_tokens"] = (t["max_repeats"] * t["tokens"]).astype(float)
    t["planned_tokens"] = water_fill(t["weight"].to_numpy(), t["cap_tokens"].to_numpy(), whole)
    t["repeats"] = np.where(t["tokens"] > 0, t["planned_tokens"] / t["tokens"].clip(lower=1), 0.0)
    t["planned_share"] = t["planned_tokens"] / max(t["planned_tokens"].sum(), 1.0)
    t["misses"] = (t["weight"] > 0) & (t["planned_tokens"] < t["target_tokens"] * (1 - 1e-12))
    return t


def draw(docs: DataFrame, plan: pd.DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """``docs`` of planned sources with ``copies`` > 0, by seeded whole and fractional repetitions."""
    spark = docs.sparkSession
    rate = spark.createDataFrame(plan[["source", "repeats"]], "source string, repeats double")
    u = (F.xxhash64(F.lit(seed), F.col(key).cast("string")).bitwiseAND((1 << 52) - 1)) / float(1 << 52)
    whole = F.floor("repeats")
    copies = (whole + F.when(u < F.col("repeats") - whole, 1).otherwise(0)).cast("int")
    return docs.join(rate, "source").withColumn("copies", copies).filter("copies > 0").drop("repeats")


def source_sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens by source over all documents of the target sources, and the targets."""
    targets = table(spark, sf_dir, "mix_targets")
    docs = table(spark, sf_dir, "documents").select("source", "text").join(targets.select("source").distinct(), "source", "left_semi")
    return count_tokens(docs, "text").groupBy("source").agg(F.sum("tokens").alias("tokens")), targets


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that miss their target within their allowed repeats."""
    plan = mix_plan(*source_sizes(spark, sf_dir))
    return spark.createDataFrame(plan.loc[plan["misses"], ["source"]], "source string")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, planned and actual tokens and shares of each source after the draw."""
    targets = table(spark, sf_dir, "mix_targets")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(targets.select("source").distinct(), "source", "left_semi")
    from lumora.session import cut

    counted = cut(count_tokens(docs, "text").select("doc_id", "source", "tokens"))
    plan = mix_plan(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets)
    drawn = draw(counted, plan).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"))
    cols = ["source", "weight", "max_repeats", "tokens", "planned_tokens", "planned_share"]
    p = spark.createDataFrame(plan[cols], "source string, weight double, max_repeats long, tokens long, planned_tokens double, planned_share double")
    out = p.join(drawn, "source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    total = out.agg(F.sum("actual_tokens").alias("all_tokens"))
    return out.join(F.broadcast(total)).withColumn("actual_share", F.try_divide("actual_tokens", "all_tokens")).drop("all_tokens")


QUERIES = {"p8_found": p8_found, "p8_mix": p8_mix}
ORACLES: dict[str, str] = {}
