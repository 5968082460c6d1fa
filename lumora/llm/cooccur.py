"""Items that appear together, against what chance would give.

Pairs are counted exactly. The null model is the bipartite configuration
model: item i is in basket b with probability x_i y_b / (1 + x_i y_b), fitted so
that expected item frequencies and basket sizes equal the observed ones. Both
sides enter only through their degree, so the fit works on the table of
distinct degrees, which stays small whatever the number of baskets. Under the
null a pair count is Poisson-binomial; its upper tail gives the surprise, and
the Benjamini-Hochberg rule bounds the share of false discoveries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.session import cut
from lumora.tables import current_rows, table


def list_entries(c: Column) -> Column:
    """Entries of a list in one of its notations, as raw strings.

    JSON or single-quoted list, the same inside a JSON string, a list of
    objects with ``label``, or text separated by commas. Null, blank, ``null``
    and ``[]`` give an empty list.
    """
    t = F.trim(c)
    inner = F.when(t.startswith('"'), F.element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 1)).otherwise(t)
    inner = F.trim(inner)
    labels = F.transform(F.from_json(inner, "array<struct<label:string>>"), lambda x: x["label"])
    words = F.from_json(inner, "array<string>")
    plain = F.split(inner, ",")
    got = (
        F.when(inner.isNull() | inner.isin("", "null", "[]"), F.array().cast("array<string>"))
        .when(inner.rlike(r"^\[\s*\{"), labels)
        .when(inner.startswith("["), F.coalesce(words, F.split(F.regexp_replace(inner, r"^\[|\]$", ""), ",")))
        .otherwise(plain)
    )
    return F.coalesce(got, F.array().cast("array<string>"))


def clean_item(x: Column, confidence: bool) -> Column:
    """Trimmed, lower-case entry, without its ``:71%`` where it may have one."""
    if confidence:
        x = F.regexp_replace(x, r"\s*:\s*[0-9.]+\s*%?\s*$", "")
    return F.lower(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def baskets_of(captions: DataFrame) -> DataFrame:
    """``basket``, ``items``: the set of keywords and object labels of each current caption."""
    cur = current_rows(captions, "image_id", ["keywords", "detected_objects"])
    both = F.concat(
        F.transform(list_entries(F.col("keywords")), lambda x: clean_item(x, False)),
        F.transform(list_entries(F.col("detected_objects")), lambda x: clean_item(x, True)),
    )
    items = F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != "")))
    return cur.select(F.col("image_id").alias("basket"), items.alias("items")).filter(F.size("items") > 0)


def fit_configuration(
    item_degrees: np.ndarray, item_n: np.ndarray, sizes: np.ndarray, size_n: np.ndarray, steps: int = 500, tol: float = 1e-9
) -> tuple[np.ndarray, np.ndarray]:
    """x by distinct item degree and y by distinct basket size, by fixed-point iteration.

    Items and baskets must have the same number of entries in all.
    """
    k, s = item_degrees.astype(float), sizes.astype(float)
    if abs((k * item_n).sum() - (s * size_n).sum()) > 1e-6 * max((s * size_n).sum(), 1.0):
        raise ValueError("item degrees and basket sizes differ in their sums")
    total = max((k * item_n).sum(), 1.0)
    x, y = k / math.sqrt(total), s / math.sqrt(total)
    for _ in range(steps):
        xn = k / np.maximum((size_n * y / (1 + x[:, None] * y)).sum(1), 1e-300)
        yn = s / np.maximum((item_n[:, None] * xn[:, None] / (1 + xn[:, None] * y)).sum(0), 1e-300)
        move = max(np.abs(np.log(xn / x)).max(), np.abs(np.log(yn / y)).max())
        x, y = xn, yn
        if move < tol:
            break
    return x, y


def poisson_binomial_log10_tail(count: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 P(S >= count) with ``n`` trials of probability ``p`` per class; rows are cases.

    Lugannani-Rice saddlepoint with the lattice correction, exact for the mass
    at zero. Counts up to the mean get an upper bound of 1 through the normal
    approximation there.
    """
    count = count.astype(float)
    mean = (n * p).sum(1)
    var = np.maximum((n * p * (1 - p)).sum(1), 1e-12)
    top = np.where(p > 0, n, 0).sum(1)
    out = np.zeros(len(count))
    far = (count > mean + 0.5) & (count < top)
    if far.any():
        c, q = count[far], p[far]
        t = np.log(np.maximum(c, 1e-9) / np.maximum(mean[far], 1e-300))
        lo, hi = np.zeros(len(c)), np.maximum(t * 2 + 5, 50.0)
        for _ in range(80):
            e = np.exp(t)[:, None]
            w = q * e / (1 - q + q * e)
            g = (n * w).sum(1) - c
            h = np.maximum((n * w * (1 - w)).sum(1), 1e-300)
            lo, hi = np.where(g < 0, t, lo), np.where(g >= 0, t, hi)
            new = t - g / h
            t = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        e = np.exp(t)[:, None]
        w = q * e / (1 - q + q * e)
        cgf = (n * np.log1p(q * (e - 1))).sum(1)
        v = np.sqrt(np.maximum((n * w * (1 - w)).sum(1), 1e-300))
        z = np.sqrt(np.maximum(2 * (t * c - cgf), 1e-12))
        u = (1 - np.exp(-t)) * v
        # Phi-bar(z) + phi(z) (1/u - 1/z), with phi taken out so that far tails do not vanish
        mills = np.where(z < 30, np.array([math.erfc(a / math.sqrt(2)) / 2 / max(math.exp(-a * a / 2) / math.sqrt(2 * math.pi), 1e-300) for a in np.minimum(z, 30)]), 1 / z)
        factor = np.maximum(mills + 1 / u - 1 / z, 1e-12)
        out[far] = (-z * z / 2 - 0.5 * math.log(2 * math.pi) + np.log(factor)) / math.log(10)
    full = count >= top
    if full.any():
        with np.errstate(divide="ignore"):
            out[full] = np.where(top[full] > 0, (n * np.where(p[full] > 0, np.log(np.maximum(p[full], 1e-300)), 0)).sum(1) / math.log(10), 0.0)
    near = ~far & ~full
    if near.any():
        z = (count[near] - 0.5 - mean[near]) / np.sqrt(var[near])
        out[near] = np.log10(np.maximum([math.erfc(a / math.sqrt(2)) / 2 for a in z], 1e-300))
    return np.minimum(out, 0.0)


def cooccurrence(baskets: DataFrame, min_count: int = 5, min_share: float = 0.0, fdr: float = 0.01) -> DataFrame:
    """Pairs ``item_a`` < ``item_b`` with exact counts, lift and surprise.

    ``baskets`` has ``basket`` and ``items`` (a set). A pair needs ``min_count``
    baskets and ``min_share`` of all of them. An item in fewer baskets than that
    can be in no such pair and is left out before pairs are formed, which loses
    nothing; counts, N and the null model still rest on all items and baskets.

    Columns: ``n_ab``, ``n_a``, ``n_b``, ``n`` (baskets), ``expected`` under the
    null, ``lift`` (n_ab n / (n_a n_b)), ``log10_p`` and ``significant`` (at the
    false-discovery rate ``fdr`` over all pairs of the items). Empty
    baskets do not count. An empty table gives no rows.
    """
    spark = baskets.sparkSession
    b = cut(baskets.select("basket", "items"))
    n = b.count()
    need = max(min_count, math.ceil(min_share * n - 1e-9), 1)
    freq = cut(b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("k")))
    # degree tables: at most sqrt(2 * entries) distinct degrees on either side
    deg = freq.groupBy("k").agg(F.count(F.lit(1)).alias("c")).orderBy("k").toPandas()
    size = b.groupBy(F.size("items").alias("s")).agg(F.count(F.lit(1)).alias("c")).orderBy("s").toPandas()
    frequent = freq.filter(F.col("k") >= need)
    entries = b.select("basket", F.explode("items").alias("item")).join(frequent.select("item"), "item", "left_semi")
    kept = entries.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items") > 1)
    left = kept.select(F.posexplode("items").alias("i", "item_a"), "items")
    pairs = (
        left.select("item_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"))
        .groupBy("item_a", "item_b")
        .agg(F.count(F.lit(1)).alias("n_ab"))
        .filter(F.col("n_ab") >= need)
    )
    pairs = pairs.join(frequent.select(F.col("item").alias("item_a"), F.col("k").alias("n_a")), "item_a").join(
        frequent.select(F.col("item").alias("item_b"), F.col("k").alias("n_b")), "item_b"
    )
    if n == 0:
        deg, size = pd.DataFrame({"k": [1], "c": [1]}), pd.DataFrame({"s": [1], "c": [1]})
    x, y = fit_configuration(deg["k"].to_numpy(), deg["c"].to_numpy(float), size["s"].to_numpy(), size["c"].to_numpy(float))
    by_degree, counts = dict(zip(deg["k"].tolist(), x.tolist())), size["c"].to_numpy(float)

    def surprise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            pa_ = np.array([by_degree[k] for k in d["n_a"]])[:, None] * y
            pb_ = np.array([by_degree[k] for k in d["n_b"]])[:, None] * y
            p = (pa_ / (1 + pa_)) * (pb_ / (1 + pb_))
            d = d.assign(
                n=n,
                expected=(p * counts).sum(1),
                lift=d["n_ab"] * float(n) / (d["n_a"] * d["n_b"].astype(float)),
                log10_p=poisson_binomial_log10_tail(d["n_ab"].to_numpy(), p, counts) if len(d) else np.empty(0),
            )
            yield d[["item_a", "item_b", "n_ab", "n_a", "n_b", "n", "expected", "lift", "log10_p"]]

    schema = "item_a string, item_b string, n_ab long, n_a long, n_b long, n long, expected double, lift double, log10_p double"
    scored = cut(pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b").mapInPandas(surprise, schema))
    # Benjamini-Hochberg over all pairs of items: one that did not reach the count was tested too, and not
    # found. Ranks come from bins of a thousandth of a decade; what is below fdr / m is significant whatever
    # its rank and shares a bin, so there are some 1000 log10(m / fdr) bins
    items = int(deg["c"].sum()) if n else 0
    m = max(items * (items - 1) / 2, 1.0)
    least = math.log10(fdr / m)
    bins = scored.groupBy(F.ceil(F.greatest(F.col("log10_p"), F.lit(least - 0.01)) * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("c")).orderBy("bin").toPandas()
    limit = -math.inf
    if len(bins):
        rank = bins["c"].cumsum().to_numpy()
        ok = bins["bin"].to_numpy() / 1000 <= np.log10(fdr * rank / m)
        limit = float(bins["bin"].to_numpy()[ok].max() / 1000) if ok.any() else -math.inf
    return scored.withColumn("significant", F.col("log10_p") <= F.lit(limit))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in at least five images and 1 % of all, three times as often as chance."""
    pairs = cooccurrence(baskets_of(table(spark, sf_dir, "analysis_caption")), min_count=5, min_share=0.01)
    keep = (F.col("n_ab") >= 5) & (F.col("n_ab") * 100 >= F.col("n")) & (F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b"))
    return pairs.filter(keep).select("item_a", "item_b")


def p4_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in at least five images that the null model does not explain."""
    pairs = cooccurrence(baskets_of(table(spark, sf_dir, "analysis_caption")), min_count=5)
    return pairs.filter("significant").select("item_a", "item_b", "n_ab", "expected", "lift", "log10_p")


QUERIES = {"p4_found": p4_found, "p4_surprise": p4_surprise}
ORACLES: dict[str, str] = {}
