"""Geographic analytics: cells, heatmaps, radius search, gap filling, trips and stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions.dates import seconds
from lumora.functions.geo import geohash, geohash_sql, haversine_km, haversine_sql, radius_box, zoom_precision
from lumora.operators.sequence import running_sum, with_day, with_previous
from lumora.registry import query
from lumora.views import SQL_META, SQL_PER, metadata, perception



def located(meta: DataFrame) -> DataFrame:
    """Rows with a valid position, as ``lat`` and ``lng``."""
    return meta.filter("has_position").withColumns({"lat": F.col("gps_latitude"), "lng": F.col("gps_longitude")})


def cells(points: DataFrame, precision: int, limit: int | None = None) -> DataFrame:
    """Cells with their mean position, count and smallest image, the fullest first."""
    g = (
        points.groupBy(geohash(F.col("lat"), F.col("lng"), precision).alias("cell"))
        .agg(
            F.round(F.avg("lat") + 1e-9, 6).alias("lat"),
            F.round(F.avg("lng") + 1e-9, 6).alias("lng"),
            F.count(F.lit(1)).alias("images"),
            F.min("image_id").alias("first_image"),
        )
    )
    return g.orderBy(F.desc("images"), "cell").limit(limit) if limit else g


def in_box(points: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Points in a box, borders included."""
    return points.filter(F.col("lat").between(south, north) & F.col("lng").between(west, east))


_PTS = f"WITH {SQL_META}, p AS (SELECT *, gps_latitude AS lat, gps_longitude AS lng FROM meta WHERE has_position)"


def _cells_sql(precision: int, where: str = "true", limit: int | None = None) -> str:
    tail = f"ORDER BY images DESC, cell LIMIT {limit}" if limit else ""
    return f"""{_PTS} SELECT {geohash_sql('lat', 'lng', precision)} AS cell, round(avg(lat) + 1e-9, 6) AS lat, round(avg(lng) + 1e-9, 6) AS lng,
      count(*) AS images, min(image_id) AS first_image FROM p WHERE {where} GROUP BY 1 {tail}"""


@query("geo_clusters", _cells_sql(zoom_precision(6), "lat BETWEEN 30 AND 70 AND lng BETWEEN -20 AND 60", 500))
def geo_clusters(spark: SparkSession, d: str) -> DataFrame:
    """E1 G-A6: the 500 fullest map cells of a viewport at zoom 6."""
    return cells(in_box(located(metadata(spark, d)), 30, 70, -20, 60), zoom_precision(6), 500)


@query("geo_heatmap", _cells_sql(4))
def geo_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """E5: every cell of four characters with its weight."""
    return cells(located(metadata(spark, d)), 4)


@query("geo_cell_top10", _cells_sql(5, limit=10))
def geo_cell_top10(spark: SparkSession, d: str) -> DataFrame:
    """G-A6: the ten fullest cells."""
    return cells(located(metadata(spark, d)), 5, 10)


@query("geo_encode", f"{_PTS} SELECT image_id, {geohash_sql('lat', 'lng', 8)} AS cell FROM p")
def geo_encode(spark: SparkSession, d: str) -> DataFrame:
    """The geohash of each position."""
    return located(metadata(spark, d)).select("image_id", geohash(F.col("lat"), F.col("lng"), 8).alias("cell"))


@query("geo_cell_prefix", f"WITH {SQL_META} SELECT image_id, geohash FROM meta WHERE geohash LIKE 'u1%'")
def geo_cell_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Images by stored geohash prefix."""
    return metadata(spark, d).filter(F.col("geohash").startswith("u1")).select("image_id", "geohash")


_BOX = radius_box(51.0, 8.9, 50.0)


@query(
    "geo_nearby",
    f"{_PTS} SELECT image_id, round({haversine_sql('51.0::DOUBLE', '8.9::DOUBLE', 'lat', 'lng')}, 6) AS km FROM p"
    f" WHERE lat BETWEEN {_BOX[0]!r} AND {_BOX[1]!r} AND lng BETWEEN {_BOX[2]!r} AND {_BOX[3]!r}",
)
def geo_nearby(spark: SparkSession, d: str) -> DataFrame:
    """Images in the box around a place, with their distance."""
    p = in_box(located(metadata(spark, d)), *_BOX)
    return p.select("image_id", F.round(haversine_km(F.lit(51.0), F.lit(8.9), F.col("lat"), F.col("lng")), 6).alias("km"))


@query(
    "geo_stats",
    f"""WITH {SQL_META} SELECT count(*) AS images, count_if(has_position) AS located,
      count(DISTINCT CASE WHEN trim(location_country) <> '' THEN location_country END) AS countries,
      count(DISTINCT CASE WHEN trim(location_city) <> '' THEN location_city END) AS cities FROM meta""",
)
def geo_stats(spark: SparkSession, d: str) -> DataFrame:
    """E4 P15 G-A3: totals of the located library, in one pass."""
    named = lambda c: F.when(F.trim(c) != "", F.col(c))
    return metadata(spark, d).agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if("has_position").alias("located"),
        F.count_distinct(named("location_country")).alias("countries"),
        F.count_distinct(named("location_city")).alias("cities"),
    )


@query(
    "geo_stats_month",
    f"WITH {SQL_META} SELECT strftime(taken, '%Y-%m') AS month, count(*) AS images, count_if(has_position) AS located FROM meta WHERE taken IS NOT NULL GROUP BY 1",
)
def geo_stats_month(spark: SparkSession, d: str) -> DataFrame:
    """G-A7: images and located images by month."""
    return (
        metadata(spark, d).filter("taken is not null").groupBy(F.date_format("taken", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("images"), F.count_if("has_position").alias("located"))
    )


@query(
    "geo_diversity_month",
    f"WITH {SQL_META} SELECT strftime(taken, '%Y-%m') AS month, count(DISTINCT substr(geohash, 1, 4)) AS places FROM meta WHERE taken IS NOT NULL AND geohash IS NOT NULL GROUP BY 1",
)
def geo_diversity_month(spark: SparkSession, d: str) -> DataFrame:
    """G-A5: distinct cells visited by month."""
    return (
        metadata(spark, d).filter("taken is not null and geohash is not null").groupBy(F.date_format("taken", "yyyy-MM").alias("month"))
        .agg(F.count_distinct(F.substring("geohash", 1, 4)).alias("places"))
    )


@query("geo_source_breakdown", f"WITH {SQL_META} SELECT coalesce(gps_source, 'unknown') AS source, count(*) AS images FROM meta WHERE has_position GROUP BY 1")
def geo_source_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Located images by where the position comes from."""
    return located(metadata(spark, d)).groupBy(F.coalesce("gps_source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("images"))


@query(
    "geo_pair_top100",
    f"""WITH {SQL_META} SELECT location_country, camera_make, count(*) AS images FROM meta
      WHERE location_country IS NOT NULL AND camera_make IS NOT NULL GROUP BY 1, 2 ORDER BY images DESC, 1, 2 LIMIT 100""",
)
def geo_pair_top100(spark: SparkSession, d: str) -> DataFrame:
    """G-A8: the commonest pairs of country and camera."""
    m = metadata(spark, d).filter("location_country is not null and camera_make is not null")
    return m.groupBy("location_country", "camera_make").agg(F.count(F.lit(1)).alias("images")).orderBy(F.desc("images"), "location_country", "camera_make").limit(100)


@query(
    "geo_furthest",
    f"{_PTS} SELECT image_id, round({haversine_sql('51.0::DOUBLE', '8.9::DOUBLE', 'lat', 'lng')}, 6) AS km FROM p ORDER BY km DESC, image_id LIMIT 1",
)
def geo_furthest(spark: SparkSession, d: str) -> DataFrame:
    """The image furthest from home."""
    km = F.round(haversine_km(F.lit(51.0), F.lit(8.9), F.col("lat"), F.col("lng")), 6)
    return located(metadata(spark, d)).select("image_id", km.alias("km")).orderBy(F.desc("km"), "image_id").limit(1)


@query(
    "geo_text_centroid",
    f"{_PTS} SELECT round(avg(lat) + 1e-9, 6) AS lat, round(avg(lng) + 1e-9, 6) AS lng, count(*) AS images FROM p WHERE location_city ILIKE '%vel%' OR location_country ILIKE '%vel%'",
)
def geo_text_centroid(spark: SparkSession, d: str) -> DataFrame:
    """E10 G-A9 P4: centre of the images whose place matches a text."""
    p = located(metadata(spark, d)).filter(F.col("location_city").ilike("%vel%") | F.col("location_country").ilike("%vel%"))
    return p.agg(F.round(F.avg("lat") + 1e-9, 6).alias("lat"), F.round(F.avg("lng") + 1e-9, 6).alias("lng"), F.count(F.lit(1)).alias("images"))


def spread_sample(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """Up to ``n`` rows of each group, evenly spread along ``order``."""
    w = Window.partitionBy(group)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    # row i is taken if it is the first with its value of floor(i * n / size)
    slot = lambda i: F.floor(i * F.lit(n) / F.col("_n"))
    return placed.filter((F.col("_i") == 0) | (slot(F.col("_i")) != slot(F.col("_i") - 1))).drop("_i", "_n")


@query(
    "geo_cluster_preview",
    f"""WITH {SQL_META}, {SQL_PER},
      p AS (SELECT image_id, substr(geohash, 1, 4) AS cell, taken, perception_iaa FROM meta LEFT JOIN per USING (image_id) WHERE has_position AND geohash IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY taken NULLS LAST, image_id) - 1 AS i, count(*) OVER (PARTITION BY cell) AS n FROM p),
      s AS (SELECT * FROM r WHERE i = 0 OR floor(i * 8 / n::DOUBLE) <> floor((i - 1) * 8 / n::DOUBLE))
      SELECT cell, image_id, coalesce(perception_iaa > 7.5, false) AS best FROM s""",
)
def geo_cluster_preview(spark: SparkSession, d: str) -> DataFrame:
    """Eight images of each cell, spread over time, the best marked."""
    p = metadata(spark, d).filter("has_position and geohash is not null").join(perception(spark, d), "image_id", "left")
    p = p.select("image_id", F.substring("geohash", 1, 4).alias("cell"), "taken", "perception_iaa")
    s = spread_sample(p, "cell", [F.asc_nulls_last("taken"), F.asc("image_id")], 8)
    return s.select("cell", "image_id", F.coalesce(F.col("perception_iaa") > 7.5, F.lit(False)).alias("best"))


def gap_fill(points: DataFrame, group: list[str], max_minutes: float) -> DataFrame:
    """Positions of timed rows without one, from the nearest timed neighbours of their group.

    Between two neighbours within ``max_minutes`` the position is interpolated
    by time, with confidence max(0.1, 1 - gap/max) over the whole gap; beside
    one it is copied, with max(0.1, 0.7 (1 - gap/max)). The previous neighbour
    is strictly earlier, the next may be simultaneous.
    """
    # a neighbour within the limit lies in the same time bucket or the one beside it, so positions are
    # copied there and no window spans more than a bucket
    wide = int(max_minutes * 60)
    t = points.filter("taken is not null").withColumn("t", seconds(F.col("taken"))).withColumn("bucket", F.floor(F.col("t") / wide))
    fix = F.struct(F.col("t").alias("t"), F.col("gps_latitude").alias("lat"), F.col("gps_longitude").alias("lng"))
    known = t.filter("has_position").select(*group, "t", fix.alias("fix"), F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])).alias("bucket"))
    both = t.filter("not has_position").withColumn("fix", F.lit(None)).unionByName(known, allowMissingColumns=True)
    w = Window.partitionBy(*group, "bucket").orderBy("t")
    prev = F.max("fix").over(w.rangeBetween(Window.unboundedPreceding, -1))
    nxt = F.min("fix").over(w.rangeBetween(0, Window.unboundedFollowing))
    m = F.lit(max_minutes * 60.0)
    j = both.withColumn("p", prev).withColumn("n", nxt).filter("fix is null")
    j = j.withColumn("gp", F.col("t") - F.col("p.t")).withColumn("gn", F.col("n.t") - F.col("t"))
    p_ok, n_ok = F.coalesce(F.col("gp") <= m, F.lit(False)), F.coalesce(F.col("gn") <= m, F.lit(False))
    whole = F.col("gp") + F.col("gn")
    share = F.when(whole > 0, F.col("gp") / whole).otherwise(0.0)
    mix = lambda c: F.col(f"p.{c}") + (F.col(f"n.{c}") - F.col(f"p.{c}")) * share
    lat = F.when(p_ok & n_ok, mix("lat")).when(p_ok, F.col("p.lat")).when(n_ok, F.col("n.lat"))
    lng = F.when(p_ok & n_ok, mix("lng")).when(p_ok, F.col("p.lng")).when(n_ok, F.col("n.lng"))
    one = lambda g: F.greatest(F.lit(0.1), 0.7 * (1 - F.col(g) / m))
    conf = F.when(p_ok & n_ok, F.greatest(F.lit(0.1), 1 - whole / m)).when(p_ok, one("gp")).when(n_ok, one("gn"))
    return j.withColumn("lat", lat).withColumn("lng", lng).withColumn("confidence", conf).filter("lat is not null")


_GAP_SQL = f"""WITH {SQL_META},
  t AS (SELECT *, CAST(epoch(taken) AS BIGINT) AS t, CASE WHEN has_position THEN {{'t': CAST(epoch(taken) AS BIGINT), 'lat': gps_latitude, 'lng': gps_longitude}} END AS fix
        FROM meta WHERE taken IS NOT NULL AND camera_model IS NOT NULL),
  j AS (SELECT *, max(fix) OVER (PARTITION BY camera_model ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
               min(fix) OVER (PARTITION BY camera_model ORDER BY t RANGE BETWEEN 0 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM t),
  g AS (SELECT *, t - p.t AS gp, n.t - t AS gn FROM j WHERE NOT has_position),
  k AS (SELECT *, coalesce(gp <= 21600, false) AS pok, coalesce(gn <= 21600, false) AS nok, CASE WHEN gp + gn > 0 THEN gp / (gp + gn)::DOUBLE ELSE 0.0 END AS share FROM g),
  f AS (SELECT image_id,
    CASE WHEN pok AND nok THEN p.lat + (n.lat - p.lat) * share WHEN pok THEN p.lat WHEN nok THEN n.lat END AS lat,
    CASE WHEN pok AND nok THEN p.lng + (n.lng - p.lng) * share WHEN pok THEN p.lng WHEN nok THEN n.lng END AS lng,
    CASE WHEN pok AND nok THEN greatest(0.1, 1 - (gp + gn) / 21600::DOUBLE) WHEN pok THEN greatest(0.1, 0.7 * (1 - gp / 21600::DOUBLE))
         WHEN nok THEN greatest(0.1, 0.7 * (1 - gn / 21600::DOUBLE)) END AS confidence FROM k)
  SELECT image_id, round(lat + 1e-9, 6) AS lat, round(lng + 1e-9, 6) AS lng, round(confidence + 1e-9, 6) AS confidence FROM f WHERE lat IS NOT NULL"""


@query("geo_gapfill_preview", _GAP_SQL)
def geo_gapfill_preview(spark: SparkSession, d: str) -> DataFrame:
    """Positions proposed for images without one, by camera, within six hours."""
    f = gap_fill(metadata(spark, d).filter("camera_model is not null"), ["camera_model"], 360)
    return f.select("image_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("lat", "lng", "confidence")])


@query("geo_gapfill_apply", f"SELECT image_id, lat, lng, 'interpolated' AS gps_source, {geohash_sql('lat', 'lng', 6)} AS cell FROM ({_GAP_SQL}) WHERE confidence >= 0.5")
def geo_gapfill_apply(spark: SparkSession, d: str) -> DataFrame:
    """The proposals that are applied, with their cell and source."""
    f = geo_gapfill_preview(spark, d).filter("confidence >= 0.5")
    return f.select("image_id", "lat", "lng", F.lit("interpolated").alias("gps_source"), geohash(F.col("lat"), F.col("lng"), 6).alias("cell"))


def segments(points: DataFrame, group: list[str], gap_hours: float) -> DataFrame:
    """Timed points numbered by segment: a new one after a gap of more than ``gap_hours``."""
    p = with_previous(with_day(points.withColumn("t", seconds(F.col("taken")))), group, "image_id", [])
    new = F.when(F.col("prev").isNull() | (F.col("t") - F.col("prev.t") > gap_hours * 3600), 1).otherwise(0)
    return running_sum(p, group, "image_id", new, "segment")


def trips(points: DataFrame, group: list[str], gap_hours: float = 4.0, min_images: int = 3) -> DataFrame:
    """Segments that go somewhere: path, displacement, start and end."""
    key = [*group, "segment"]
    s = segments(points, group, gap_hours)
    w = Window.partitionBy(*key).orderBy("t", "image_id")
    s = s.withColumn("step", haversine_km(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")))
    at = F.struct("t", "image_id")
    g = s.groupBy(*key).agg(
        F.count(F.lit(1)).alias("images"),
        F.sum(F.coalesce("step", F.lit(0.0))).alias("path"),
        F.min_by(F.struct("lat", "lng"), at).alias("a"),
        F.max_by(F.struct("lat", "lng"), at).alias("b"),
        F.min("taken").alias("start"),
        F.max("taken").alias("end"),
    )
    g = g.withColumn("disp", haversine_km(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")))
    return g.filter((F.col("images") >= min_images) & ~((F.col("disp") < 10) & (F.col("path") < 20)))


_SEG_SQL = f"""{_PTS}, c AS (SELECT *, CAST(epoch(taken) AS BIGINT) AS t FROM p WHERE taken IS NOT NULL AND camera_model IS NOT NULL),
  l AS (SELECT *, lag(t) OVER (PARTITION BY camera_model ORDER BY t, image_id) AS before FROM c),
  seg AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before > 4 * 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_model ORDER BY t, image_id) AS segment FROM l)"""


@query("trip_segments", f"{_SEG_SQL} SELECT image_id, camera_model, CAST(segment AS BIGINT) AS segment FROM seg")
def trip_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segment of each timed and located image."""
    p = located(metadata(spark, d)).filter("taken is not null and camera_model is not null")
    return segments(p, ["camera_model"], 4).select("image_id", "camera_model", "segment")


@query(
    "trip_detect",
    f"""{_SEG_SQL}, st AS (SELECT *, {haversine_sql('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS step FROM seg WINDOW w AS (PARTITION BY camera_model, segment ORDER BY t, image_id)),
      g AS (SELECT camera_model, segment, count(*) AS images, sum(coalesce(step, 0)) AS path, arg_min({{'lat': lat, 'lng': lng}}, {{'t': t, 'i': image_id}}) AS a,
            arg_max({{'lat': lat, 'lng': lng}}, {{'t': t, 'i': image_id}}) AS b, min(taken) AS start, max(taken) AS "end" FROM st GROUP BY 1, 2),
      h AS (SELECT *, {haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS disp FROM g)
      SELECT camera_model, CAST(segment AS BIGINT) AS segment, images, round(path, 4) AS path_km, round(disp, 4) AS displacement_km, start, "end"
      FROM h WHERE images >= 3 AND NOT (disp < 10 AND path < 20)""",
)
def trip_detect(spark: SparkSession, d: str) -> DataFrame:
    """Trips by camera."""
    p = located(metadata(spark, d)).filter("taken is not null and camera_model is not null")
    return trips(p, ["camera_model"]).select(
        "camera_model", "segment", "images", F.round("path", 4).alias("path_km"), F.round("disp", 4).alias("displacement_km"), "start", "end"
    )


def stops(points: DataFrame, group: list[str], minutes: float = 30, precision: int = 6) -> DataFrame:
    """Stays: consecutive points of one cell at most ``minutes`` apart."""
    p = points.withColumn("t", seconds(F.col("taken"))).withColumn("cell", geohash(F.col("lat"), F.col("lng"), precision))
    p = with_previous(with_day(p), group, "image_id", ["cell"])
    same = (F.col("prev.cell") == F.col("cell")) & (F.col("t") - F.col("prev.t") <= minutes * 60)
    p = running_sum(p, group, "image_id", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1), "stop")
    return p.groupBy(*group, "stop").agg(
        F.count(F.lit(1)).alias("images"), F.round(F.avg("lat") + 1e-9, 6).alias("lat"), F.round(F.avg("lng") + 1e-9, 6).alias("lng"),
        F.min_by("image_id", F.struct("t", "image_id")).alias("cover"), F.min("taken").alias("start"), F.max("taken").alias("end"),
    )


@query(
    "trip_stops",
    f"""{_PTS}, c AS (SELECT *, CAST(epoch(taken) AS BIGINT) AS t, {geohash_sql('lat', 'lng', 6)} AS cell FROM p WHERE taken IS NOT NULL AND camera_model IS NOT NULL),
      n AS (SELECT *, CASE WHEN coalesce(lag(cell) OVER w = cell AND t - lag(t) OVER w <= 1800, false) THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY camera_model ORDER BY t, image_id)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY camera_model ORDER BY t, image_id) AS stop FROM n)
      SELECT camera_model, CAST(stop AS BIGINT) AS stop, count(*) AS images, round(avg(lat) + 1e-9, 6) AS lat, round(avg(lng) + 1e-9, 6) AS lng,
        arg_min(image_id, {{'t': t, 'i': image_id}}) AS cover, min(taken) AS start, max(taken) AS "end" FROM s GROUP BY 1, 2""",
)
def trip_stops(spark: SparkSession, d: str) -> DataFrame:
    """Stops along the way of each camera."""
    return stops(located(metadata(spark, d)).filter("taken is not null and camera_model is not null"), ["camera_model"])


def rdp(points: list[tuple[float, float]], epsilon: float) -> list[int]:
    """Indices kept by Ramer-Douglas-Peucker, without recursion."""
    if len(points) < 3:
        return list(range(len(points)))
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (x1, y1), (x2, y2) = points[a], points[b]
        dx, dy = x2 - x1, y2 - y1
        norm = (dx * dx + dy * dy) ** 0.5
        worst, at = 0.0, -1
        for i in range(a + 1, b):
            x, y = points[i]
            dist = abs(dy * (x - x1) - dx * (y - y1)) / norm if norm else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5
            if dist > worst:
                worst, at = dist, i
        if worst > epsilon:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return sorted(keep)


def simplify_routes(points: DataFrame, key: list[str], cap: int = 1000) -> DataFrame:
    """The simplified line of each route (V6): more than 100 points within 0.1 % of the extent, at most ``cap`` by stride."""

    def line(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(["t", "image_id"], ignore_index=True)
        pts = list(zip(pdf["lat"], pdf["lng"]))
        idx = list(range(len(pts)))
        if len(pts) > 100:
            extent = max(pdf["lat"].max() - pdf["lat"].min(), pdf["lng"].max() - pdf["lng"].min())
            idx = rdp(pts, extent * 0.001)
        if len(idx) > cap:
            idx = idx[:: -(-len(idx) // cap)]
        out = pdf.iloc[idx][[*key, "image_id", "lat", "lng"]].copy()
        out["ordinal"] = range(len(out))
        return out

    kinds = dict(points.dtypes)
    return points.groupBy(*key).applyInPandas(line, ", ".join(f"{k} {kinds[k]}" for k in key) + ", image_id long, lat double, lng double, ordinal long")


@query("route_rdp")
def route_rdp(spark: SparkSession, d: str) -> DataFrame:
    """V6: the simplified route of each trip segment."""
    p = located(metadata(spark, d)).filter("taken is not null and camera_model is not null")
    s = segments(p, ["camera_model"], 4).select("camera_model", "segment", "image_id", "t", "lat", "lng")
    return simplify_routes(s, ["camera_model", "segment"])


@query(
    "geocode_backfill",
    f"""{_PTS}, k AS (SELECT round_even(lat, 2) AS la, round_even(lng, 2) AS lo, location_city AS city, count(*) AS n FROM p WHERE trim(location_city) <> '' GROUP BY 1, 2, 3),
      cache AS (SELECT la, lo, arg_max(city, {{'n': n, 'c': city}}) AS city FROM k GROUP BY 1, 2)
      SELECT image_id, cache.city FROM p JOIN cache ON la = round_even(lat, 2) AND lo = round_even(lng, 2) WHERE coalesce(trim(location_city), '') = ''""",
)
def geocode_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Missing cities taken from the cache of rounded positions."""
    p = located(metadata(spark, d)).withColumns({"la": F.bround("lat", 2), "lo": F.bround("lng", 2)})
    k = p.filter("trim(location_city) <> ''").groupBy("la", "lo", F.col("location_city").alias("city")).agg(F.count(F.lit(1)).alias("n"))
    cache = k.groupBy("la", "lo").agg(F.max_by("city", F.struct("n", "city")).alias("city"))
    return p.filter("coalesce(trim(location_city), '') = ''").join(cache, ["la", "lo"]).select("image_id", "city")
