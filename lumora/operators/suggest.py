"""Suggestions for persons and clusters of faces, from the vectors of the faces themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions.vec import cosine
from lumora.registry import query
from lumora.tables import table

DIM = 512
#: Newest faces of a cluster that stand for it, representatives of a person at most, and
#: the least similarity of an image to a person.
NEWEST, REPS, NEAR = 5, 150, 0.35


def usable(v: Column) -> Column:
    """True for a vector of ``DIM`` finite numbers, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == DIM) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def face_vectors(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct faces with a usable vector: ``id``, the named columns and ``v``."""
    f = table(spark, d, "face_occurrences").select("id", *columns, F.col("embedding").alias("v"))
    return f.filter(usable(F.col("v"))).dropDuplicates(["id"])


def newest_centroids(f: DataFrame, newest: int = NEWEST) -> DataFrame:
    """(cluster_id, n, centroid): the mean vector of the ``newest`` faces of each cluster.

    A rank filter on one window is cut down before the shuffle, so a large
    cluster sends few rows.
    """
    w = Window.partitionBy("cluster_id").orderBy(F.desc("created_at"), F.desc("id"))
    top = f.filter("cluster_id is not null").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= newest)
    return mean_vectors(top, "cluster_id")


def mean_vectors(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, centroid): mean vector of each key, element by element.

    One aggregate over (key, element) stays inside generated code at this
    width, which one aggregate an element does not; it is partial in each task.
    """
    each = rows.select(key, F.posexplode("v").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    whole = each.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    return whole.select(key, "n", F.transform("c", lambda x: x["m"]).alias("centroid"))


def farthest(vectors: list[list[float]], k: int) -> list[int]:
    """V5: up to ``k`` positions, each the farthest from those chosen; starts at the first, never twice the same."""
    import numpy as np

    x = np.asarray(vectors, float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if len(x) <= k:
        return list(range(len(x)))
    chosen, near = [0], x @ x[0]
    near[0] = np.inf
    while len(chosen) < k:
        nxt = int(np.argmin(near))
        chosen.append(nxt)
        near = np.maximum(near, x @ x[nxt])
        near[chosen] = np.inf
    return chosen


def link_candidates(spark: SparkSession, d: str, person: int, limit: int = 20) -> DataFrame:
    """Unlinked clusters most like a person: (cluster_id, faces, score), best first.

    The person stands for itself by the centroids of its clusters, at most
    ``REPS`` of them and those farthest apart. The pool of candidates is bounded
    by ``limit``, so both sides of the comparison are small.
    """
    faces = face_vectors(spark, d, "cluster_id", "person_id", "created_at")
    own = newest_centroids(faces.filter(F.col("person_id") == person)).select("cluster_id", "n", "centroid")
    head = own.orderBy("cluster_id").limit(20 * REPS).collect()
    reps = [head[i].centroid for i in farthest([r.centroid for r in head], REPS)] if head else []
    per = faces.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("faces"), F.max("person_id").alias("linked"))
    pool = per.filter("linked is null").orderBy(F.desc("faces"), "cluster_id").limit(max(50 * limit, 500))
    c = newest_centroids(faces.join(F.broadcast(pool.select("cluster_id")), "cluster_id", "left_semi")).select("cluster_id", "centroid")
    r = F.broadcast(spark.createDataFrame([(v,) for v in reps], "rep array<double>"))
    score = c.join(r).groupBy("cluster_id").agg(F.round(F.max(cosine(F.col("centroid"), F.col("rep"))), 5).alias("score"))
    return pool.join(score, "cluster_id").select("cluster_id", "faces", "score").orderBy(F.desc("score"), F.desc("faces"), "cluster_id").limit(limit)


def person_images(spark: SparkSession, d: str, person: int, limit: int = 50) -> DataFrame:
    """V8: images not linked to a person whose best face is near the person's mean: (image_id, similarity)."""
    f = face_vectors(spark, d, "image_id", "person_id")
    mine = f.filter(F.col("person_id") == person)
    c = mean_vectors(mine, "person_id").select("centroid")
    s = f.join(mine.select("image_id").distinct(), "image_id", "left_anti").join(F.broadcast(c)).select("image_id", cosine(F.col("v"), F.col("centroid")).alias("s"))
    best = s.groupBy("image_id").agg(F.round(F.max("s"), 5).alias("similarity")).filter(F.col("similarity") >= NEAR)
    return best.orderBy(F.desc("similarity"), "image_id").limit(limit)


_OK = "embedding IS NOT NULL AND len(embedding) = 512 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_FV = f"fv AS (SELECT DISTINCT ON (id) id, image_id, cluster_id, person_id, created_at, embedding::DOUBLE[] AS v FROM face_occurrences WHERE {_OK})"
_CENT = "(SELECT cluster_id, list(m ORDER BY i) AS centroid FROM (SELECT cluster_id, i, avg(v[i]) AS m FROM (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, id DESC) <= 5), range(1, 513) r(i) GROUP BY 1, 2) GROUP BY 1)"


@query(
    "link_candidates",
    f"""WITH {_FV}, per AS (SELECT cluster_id, count(*) AS faces FROM fv WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING max(person_id) IS NULL ORDER BY faces DESC, cluster_id LIMIT 500),
      mine AS (SELECT * FROM fv WHERE person_id = 1 AND cluster_id IS NOT NULL), free AS (SELECT * FROM fv WHERE cluster_id IN (SELECT cluster_id FROM per)),
      reps AS {_CENT.format(src='mine')}, cand AS {_CENT.format(src='free')},
      s AS (SELECT cand.cluster_id, round(max(list_cosine_similarity(cand.centroid, reps.centroid)), 5) AS score FROM cand, reps GROUP BY 1)
      SELECT cluster_id, faces, score FROM per JOIN s USING (cluster_id) ORDER BY score DESC, faces DESC, cluster_id LIMIT 10""",
)
def link_candidates_q(spark: SparkSession, d: str) -> DataFrame:
    """V4 W4 G-A17 J9: clusters that may be the most frequent person."""
    return link_candidates(spark, d, 1, 10)


@query(
    "person_images",
    f"""WITH {_FV}, c AS (SELECT list(m ORDER BY i) AS centroid FROM (SELECT i, avg(v[i]) AS m FROM fv, range(1, 513) r(i) WHERE person_id = 1 GROUP BY 1)),
      s AS (SELECT image_id, round(max(list_cosine_similarity(v, centroid)), 5) AS similarity FROM fv, c WHERE image_id NOT IN (SELECT image_id FROM fv WHERE person_id = 1) GROUP BY 1)
      SELECT image_id, similarity FROM s WHERE similarity >= 0.35 ORDER BY similarity DESC, image_id LIMIT 50""",
)
def person_images_q(spark: SparkSession, d: str) -> DataFrame:
    """V8: images that may show the most frequent person."""
    return person_images(spark, d, 1)


@query("dual_windows", f"WITH {_FV}, w AS (SELECT id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, id DESC) AS a, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS b FROM fv WHERE cluster_id IS NOT NULL) SELECT cluster_id, id FROM w WHERE a <= 3 OR b <= 3")
def dual_windows(spark: SparkSession, d: str) -> DataFrame:
    """The three newest or the three first faces of each cluster.

    Two ranks, each cut down before its shuffle, and their union: with one
    filter on both ranks whole clusters would be sorted twice.
    """
    f = face_vectors(spark, d, "cluster_id", "created_at").filter("cluster_id is not null").select("id", "cluster_id", "created_at")
    take = lambda *order: f.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).filter("rn <= 3").select("cluster_id", "id")
    return take(F.desc("created_at"), F.desc("id")).unionByName(take("id")).distinct()


@query(
    "purity_first_20",
    f"""WITH {_FV}, f AS (SELECT * FROM fv WHERE cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY id) <= 20),
      n AS (SELECT cluster_id, count(*) AS faces FROM fv WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
      c AS (SELECT cluster_id, list(m ORDER BY i) AS centroid FROM (SELECT cluster_id, i, avg(v[i]) AS m FROM f JOIN n USING (cluster_id), range(1, 513) r(i) GROUP BY 1, 2) GROUP BY 1)
      SELECT cluster_id, any_value(faces) AS faces, round(min(list_cosine_similarity(v, centroid)), 4) AS purity FROM f JOIN c USING (cluster_id) JOIN n USING (cluster_id) GROUP BY 1 HAVING round(min(list_cosine_similarity(v, centroid)), 4) < 0.75""",
)
def purity_first_20(spark: SparkSession, d: str) -> DataFrame:
    """V3 W3 G-A18: clusters of three faces and more whose first twenty by id are not pure."""
    f = face_vectors(spark, d, "cluster_id").filter("cluster_id is not null")
    n = f.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("faces")).filter("faces >= 3")
    first = f.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))).filter("rn <= 20").join(n, "cluster_id")
    c = mean_vectors(first, "cluster_id").select("cluster_id", "centroid")
    s = first.join(c, "cluster_id").groupBy("cluster_id").agg(F.max("faces").alias("faces"), F.round(F.min(cosine(F.col("v"), F.col("centroid"))), 4).alias("purity"))
    return s.filter("purity < 0.75")
