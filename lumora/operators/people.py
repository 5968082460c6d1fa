"""Face and vector analytics: representatives, votes, centroids, purity, suggestions, greedy clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions.vec import cosine, dot
from lumora.registry import query
from lumora.tables import table
from lumora.views import SQL_FACE, faces

_AREA = "(bbox_x2 - bbox_x1) * (bbox_y2 - bbox_y1)"


@query("representative", f"WITH {SQL_FACE} SELECT cluster_id, arg_max(id, {{'a': {_AREA}, 'i': -id}}) AS id, count(*) AS faces FROM face WHERE cluster_id IS NOT NULL GROUP BY 1")
def representative(spark: SparkSession, d: str) -> DataFrame:
    """The face with the largest box of each cluster; ``max_by`` instead of a window, so big clusters reduce map-side."""
    f = faces(spark, d).filter("cluster_id is not null")
    return f.groupBy("cluster_id").agg(F.max_by("id", F.struct(F.expr(_AREA), -F.col("id"))).alias("id"), F.count(F.lit(1)).alias("faces"))


@query("mode_per_group", f"WITH {SQL_FACE}, n AS (SELECT cluster_id, identity_name, count(*) AS n FROM face WHERE cluster_id IS NOT NULL AND identity_name IS NOT NULL GROUP BY 1, 2) SELECT cluster_id, arg_max(identity_name, {{'n': n, 'v': identity_name}}) AS identity_name, max(n) AS votes FROM n GROUP BY 1")
def mode_per_group(spark: SparkSession, d: str) -> DataFrame:
    """G-A14: the commonest name of each cluster, ties by name."""
    n = faces(spark, d).filter("cluster_id is not null and identity_name is not null").groupBy("cluster_id", "identity_name").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("cluster_id").agg(F.max_by("identity_name", F.struct("n", "identity_name")).alias("identity_name"), F.max("n").alias("votes"))


@query("majority_vote", f"WITH {SQL_FACE}, n AS (SELECT cluster_id, person_id, count(*) AS n FROM face WHERE cluster_id IS NOT NULL AND person_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY cluster_id) AS total FROM n) SELECT cluster_id, person_id, n AS votes, total::BIGINT AS total FROM t WHERE n * 2 > total")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """G-A15 J12: the person that more than half of a cluster's tagged faces name."""
    n = faces(spark, d).filter("cluster_id is not null and person_id is not null").groupBy("cluster_id", "person_id").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("cluster_id").agg(F.max_by("person_id", "n").alias("person_id"), F.max("n").alias("votes"), F.sum("n").alias("total"))
    return g.filter("votes * 2 > total")


@query("person_summary", f"WITH {SQL_FACE} SELECT p.id, p.name, count(face.id) AS faces, count(DISTINCT image_id) AS images, count(DISTINCT cluster_id) AS clusters FROM face_persons p LEFT JOIN face ON person_id = p.id GROUP BY 1, 2")
def person_summary(spark: SparkSession, d: str) -> DataFrame:
    """V10 G-A3: persons with their faces, images and clusters."""
    f = faces(spark, d).filter("person_id is not null").groupBy("person_id").agg(F.count("id").alias("faces"), F.count_distinct("image_id").alias("images"), F.count_distinct("cluster_id").alias("clusters"))
    p = table(spark, d, "face_persons").withColumnRenamed("id", "person_id")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("faces", "images", "clusters")}
    return p.join(f, "person_id", "left").withColumns(zero).withColumnRenamed("person_id", "id")


@query("cluster_unlinked", f"WITH {SQL_FACE} SELECT cluster_id, count(*) AS faces FROM face WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(person_id) = 0 AND count(*) >= 3")
def cluster_unlinked(spark: SparkSession, d: str) -> DataFrame:
    """G-A4: clusters of three faces and more of which none names a person."""
    f = faces(spark, d).filter("cluster_id is not null")
    return f.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("faces"), F.count("person_id").alias("named")).filter("named = 0 and faces >= 3").select("cluster_id", "faces")


@query("cluster_labels", f"WITH {SQL_FACE} SELECT image_id, cluster_id, max(coalesce(display_name, 'Cluster ' || cluster_id)) AS label, max(person_id) AS person_id FROM face LEFT JOIN face_cluster_labels USING (cluster_id) WHERE cluster_id IS NOT NULL GROUP BY 1, 2")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    """G-A13 M27 R18: the clusters shown on each image with their labels."""
    f = faces(spark, d).filter("cluster_id is not null").join(table(spark, d, "face_cluster_labels"), "cluster_id", "left")
    label = F.coalesce("display_name", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
    return f.groupBy("image_id", "cluster_id").agg(F.max(label).alias("label"), F.max("person_id").alias("person_id"))


@query("quality_faces", f"WITH {SQL_FACE} SELECT image_id, count(DISTINCT person_id) AS persons FROM face WHERE det_score >= 0.65 AND {_AREA} >= 2500 AND person_id IS NOT NULL GROUP BY 1")
def quality_faces(spark: SparkSession, d: str) -> DataFrame:
    """A1: persons on each image, by faces that are sharp and large enough."""
    f = faces(spark, d).filter(f"det_score >= 0.65 and {_AREA} >= 2500 and person_id is not null")
    return f.groupBy("image_id").agg(F.count_distinct("person_id").alias("persons"))


def vector_sum(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, n, centroid): mean vector of each key.

    Element-wise sums, partial in each task; no key's vectors are gathered.
    """
    u = rows.select(key, *[F.col(vector)[i].cast("double").alias(f"_{i}") for i in range(dim)])
    g = u.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_{i}").alias(f"_{i}") for i in range(dim)])
    return g.select(key, "n", F.array(*[f"_{i}" for i in range(dim)]).alias("centroid"))


def unit(vector: str) -> F.Column:
    return F.transform(F.col(vector), lambda x: x.cast("double") / F.sqrt(dot(F.col(vector), F.col(vector))))


_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
_CEN = f"u AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS centroid, any_value(n) AS n FROM (SELECT label, i, avg(v[i]) AS m, count(*) AS n FROM u, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)"


def _unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", unit("embedding").alias("v"))


@query("centroid_by_label", f"WITH {_CEN} SELECT label, n, round(sqrt(list_dot_product(centroid, centroid)), 6) AS norm, round(centroid[1], 6) AS c0, round(centroid[64], 6) AS c63 FROM c")
def centroid_by_label(spark: SparkSession, d: str) -> DataFrame:
    """G-A17: mean vectors of the labels."""
    c = vector_sum(_unit_vectors(spark, d), "label", "v", 64)
    return c.select("label", "n", F.round(F.sqrt(dot(F.col("centroid"), F.col("centroid"))), 6).alias("norm"), F.round(F.col("centroid")[0], 6).alias("c0"), F.round(F.col("centroid")[63], 6).alias("c63"))


_PUR = f"{_CEN}, s AS (SELECT label, vec_id, list_cosine_similarity(v, centroid) AS sim, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM u JOIN c USING (label))"


@query("cluster_purity", f"WITH {_PUR} SELECT label, count(*) AS n, round(min(sim), 4) AS purity FROM s GROUP BY 1")
def cluster_purity(spark: SparkSession, d: str) -> DataFrame:
    """V3 G-A18: the least similarity of a member to its label's centroid."""
    return purity(_unit_vectors(spark, d), "label", "v", 64)


def purity(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, n, purity); a single member is pure."""
    c = vector_sum(rows, key, vector, dim)
    s = rows.join(c, key).select(key, "n", cosine(F.col(vector), F.col("centroid")).alias("sim"))
    return s.groupBy(key).agg(F.first("n").alias("n"), F.round(F.min("sim"), 4).alias("purity")).withColumn("purity", F.when(F.col("n") < 2, 1.0).otherwise(F.col("purity")))


@query("impure_clusters", f"WITH {_PUR}, p AS (SELECT label, count(*) AS n, round(min(sim), 4) AS purity FROM s GROUP BY 1) SELECT * FROM p WHERE purity < 0.75 AND n >= 3 ORDER BY purity, label")
def impure_clusters(spark: SparkSession, d: str) -> DataFrame:
    """V3: clusters of three and more that are not pure, the worst first."""
    return cluster_purity(spark, d).filter("purity < 0.75 and n >= 3").orderBy("purity", "label")


#: Labels that may be held against everything at once, 8 bytes a number each.
MOST_LABELS = 10_000


def few_labels(centroids: DataFrame) -> DataFrame:
    """``centroids`` of a checked number; beyond it, the neighbour graph is the way."""
    n = centroids.limit(MOST_LABELS + 1).count()
    if n > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels to compare with")
    return centroids


@query("link_suggestions", f"WITH {_CEN}, x AS (SELECT a.label AS label_a, b.label AS label_b, round(list_cosine_similarity(a.centroid, b.centroid), 6) AS similarity FROM c a, c b WHERE a.label <> b.label) SELECT label_a, arg_max(label_b, {{'s': similarity, 'l': -label_b}}) AS label_b, max(similarity) AS similarity FROM x GROUP BY 1")
def link_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """The label nearest to each label by centroid; labels are few and broadcast only below Spark's size limit."""
    c = vector_sum(_unit_vectors(spark, d), "label", "v", 64)
    c = few_labels(c)
    a, b = c.select(F.col("label").alias("label_a"), F.col("centroid").alias("ca")), c.select(F.col("label").alias("label_b"), F.col("centroid").alias("cb"))
    x = a.join(b, F.col("label_a") != F.col("label_b")).withColumn("similarity", F.round(cosine(F.col("ca"), F.col("cb")), 6))
    return x.groupBy("label_a").agg(F.max_by("label_b", F.struct("similarity", -F.col("label_b"))).alias("label_b"), F.max("similarity").alias("similarity"))


@query("similar_for_label", f"WITH {_CEN} SELECT vec_id, round(list_cosine_similarity(v, centroid), 6) AS similarity FROM u, (SELECT centroid FROM c WHERE label = 3) WHERE u.label <> 3 AND list_cosine_similarity(v, centroid) >= 0.1 ORDER BY 2 DESC, 1 LIMIT 50")
def similar_for_label(spark: SparkSession, d: str) -> DataFrame:
    """V8: vectors of other labels near a label's centroid."""
    u = _unit_vectors(spark, d)
    c = vector_sum(u.filter("label = 3"), "label", "v", 64).select("centroid")
    s = u.filter("label <> 3").join(F.broadcast(c)).withColumn("sim", cosine(F.col("v"), F.col("centroid"))).filter("sim >= 0.1")
    return s.select("vec_id", F.round("sim", 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(50)


@query("match_threshold", f"WITH {_CEN}, x AS (SELECT vec_id, c.label, round(list_cosine_similarity(v, centroid), 6) AS sim FROM u, c) SELECT vec_id, CASE WHEN max(sim) >= 0.4 THEN CAST(arg_max(label, {{'s': sim, 'l': -label}}) AS VARCHAR) ELSE 'Unknown' END AS match, max(sim) AS similarity FROM x GROUP BY 1")
def match_threshold(spark: SparkSession, d: str) -> DataFrame:
    """V9: the best label of each vector, or Unknown below 0.40."""
    u = _unit_vectors(spark, d)
    c = vector_sum(u, "label", "v", 64).select(F.col("label").alias("l"), "centroid")
    x = u.join(F.broadcast(few_labels(c))).withColumn("sim", F.round(cosine(F.col("v"), F.col("centroid")), 6))
    g = x.groupBy("vec_id").agg(F.max(F.struct("sim", -F.col("l"))).alias("m"))
    best = (-F.col("m")["col2"]).cast("string")
    return g.select("vec_id", F.when(F.col("m.sim") >= 0.4, best).otherwise("Unknown").alias("match"), F.col("m.sim").alias("similarity"))


@query("pairwise_distance", f"WITH u AS (SELECT label, {_UNIT} AS v FROM embeddings), g AS (SELECT label, i, sum(v[i]) AS s, count(*) AS n FROM u, range(1, 65) r(i) GROUP BY 1, 2) SELECT label, round(1 - (sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 6) AS distance FROM g GROUP BY 1")
def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    """G-A21: mean cosine distance of all pairs of a group, from the group's sum and not from its pairs."""
    c = vector_sum(_unit_vectors(spark, d), "label", "v", 64)
    n = F.col("n")
    mean = (dot(F.col("centroid"), F.col("centroid")) * n * n - n) / (n * (n - 1))
    return c.select("label", F.round(1 - mean, 6).alias("distance"))


def greedy_clusters(vectors: DataFrame, key: str, vector: str, threshold: float = 0.55) -> DataFrame:
    """Clusters in key order (V1): each vector joins the running mean it is nearest to, or starts a cluster.

    The definition is sequential, so this runs in one task and only for
    collections that fit there (at most 200,000 rows, checked). For larger ones
    the neighbour graph and the bisecting clusters give the same groups where
    groups are apart.
    """
    if vectors.limit(200_001).count() > 200_000:
        raise ValueError("greedy clustering is sequential; use graph clusters beyond 200,000 rows")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: list[np.ndarray] = []
        counts: list[int] = []
        for b in batches:
            out = []
            for v in b[vector]:
                x = np.asarray(v, float)
                x = x / max(np.linalg.norm(x), 1e-12)
                best = -1
                if sums:
                    s = np.array(sums) @ x / np.array(counts)
                    best = int(s.argmax()) if s.max() >= threshold else -1
                if best < 0:
                    sums.append(x)
                    counts.append(1)
                    best = len(sums) - 1
                else:
                    sums[best] = sums[best] + x
                    counts[best] += 1
                out.append(best + 1)
            yield pd.DataFrame({"key": b[key], "cluster": out})

    kind = dict(vectors.dtypes)[key]
    return vectors.select(key, vector).coalesce(1).sortWithinPartitions(key).mapInPandas(run, f"key {kind}, cluster long").withColumnRenamed("key", key)


@query("greedy_cluster_sizes")
def greedy_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Greedy clusters of the vectors and their sizes."""
    return greedy_clusters(table(spark, d, "embeddings"), "vec_id", "embedding").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def farthest_points(x: np.ndarray, k: int) -> list[int]:
    """Rows of a greedy farthest-point sample from row 0 (V5)."""
    got = [0]
    best = x @ x[0]
    while len(got) < min(k, len(x)):
        i = int(best.argmin())
        got.append(i)
        best = np.maximum(best, x @ x[i])
    return got


@query("fps_sample")
def fps_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five far-apart representatives among the newest hundred of each label."""
    w = Window.partitionBy("label").orderBy(F.desc("vec_id"))
    rows = _unit_vectors(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 100")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ascending=False, ignore_index=True)
        return pdf.loc[farthest_points(np.stack(pdf["v"]), 5), ["label", "vec_id"]]

    return rows.groupBy("label").applyInPandas(pick, "label int, vec_id long")


@query("split_cluster")
def split_cluster(spark: SparkSession, d: str) -> DataFrame:
    """V2: each label split greedily at 0.65; the largest part keeps the id, the others follow by size."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        sums, n, of = [], [], []
        for v in pdf["v"]:
            x = np.asarray(v)
            s = [a @ x / c for a, c in zip(sums, n)]
            b = int(np.argmax(s)) if s and max(s) >= 0.65 else -1
            if b < 0:
                sums.append(x), n.append(1)
                b = len(sums) - 1
            else:
                sums[b], n[b] = sums[b] + x, n[b] + 1
            of.append(b)
        rank = {b: r for r, b in enumerate(sorted(range(len(n)), key=lambda b: (-n[b], b)))}
        return pd.DataFrame({"label": pdf["label"], "vec_id": pdf["vec_id"], "part": [rank[b] for b in of]})

    return _unit_vectors(spark, d).groupBy("label").applyInPandas(split, "label int, vec_id long, part long")
