"""Smart albums and stories: rules, membership, moments, chapters, heroes, evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.dates import seconds
from lumora.functions.geo import geohash, geohash_sql, haversine_km, haversine_sql
from lumora.operators.search import tokens
from lumora.operators.sequence import running_sum, with_day, with_previous
from lumora.registry import query
from lumora.session import cut
from lumora.tables import table
from lumora.views import SQL_CAP, SQL_FACE, SQL_META, SQL_PER, captions, faces, metadata, perception

_AREA = "(bbox_x2 - bbox_x1) * (bbox_y2 - bbox_y1)"


class Rules:
    """Compiles album rules to frames of image ids; unknown and empty rules are skipped."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    def person(self, r: dict) -> DataFrame | None:
        """All or any of some persons, by faces that are sharp and large enough (A1)."""
        ids = r.get("person_ids") or []
        if not ids:
            return None
        f = faces(self.spark, self.d).filter(f"det_score >= 0.65 and {_AREA} >= 2500").filter(F.col("person_id").isin(ids))
        g = f.groupBy("image_id").agg(F.count_distinct("person_id").alias("n"))
        return g.filter(F.col("n") >= (len(set(ids)) if r.get("match", "any") == "all" else 1)).select("image_id")

    def date_range(self, r: dict) -> DataFrame | None:
        """A closed range of days (A2)."""
        if not (r.get("from") or r.get("to")):
            return None
        m = metadata(self.spark, self.d)
        if r.get("from"):
            m = m.filter(F.col("taken") >= F.lit(f"{r['from']} 00:00:00").cast("timestamp_ntz"))
        if r.get("to"):
            m = m.filter(F.col("taken") <= F.lit(f"{r['to']} 23:59:59").cast("timestamp_ntz"))
        return m.select("image_id")

    def location(self, r: dict) -> DataFrame | None:
        """Country and city, exact (A3)."""
        want = {c: r[k] for c, k in (("location_country", "country"), ("location_city", "city")) if r.get(k)}
        if not want:
            return None
        return reduce(lambda m, kv: m.filter(F.col(kv[0]) == kv[1]), want.items(), metadata(self.spark, self.d)).select("image_id")

    def keyword(self, r: dict) -> DataFrame | None:
        """Any of some phrases among the words of the caption (A4)."""
        phrases = [" ".join(p.lower().split()) for p in r.get("keywords") or [] if p.strip()]
        if not phrases:
            return None
        blob = F.concat(F.lit(" "), F.array_join(tokens(F.concat_ws("  ", "description", "main_subject", "keywords")), " "), F.lit(" "))
        hit = reduce(lambda a, b: a | b, [F.contains(blob, F.lit(f" {p} ")) for p in phrases])
        return captions(self.spark, self.d).filter(hit).select("image_id")

    def scene(self, r: dict) -> DataFrame | None:
        """Any of some scene types (A5)."""
        return captions(self.spark, self.d).filter(F.col("scene_type").isin(r["scenes"])).select("image_id") if r.get("scenes") else None

    def camera(self, r: dict) -> DataFrame | None:
        """Make and model, exact."""
        want = {c: r[k] for c, k in (("camera_make", "make"), ("camera_model", "model")) if r.get(k)}
        if not want:
            return None
        return reduce(lambda m, kv: m.filter(F.col(kv[0]) == kv[1]), want.items(), metadata(self.spark, self.d)).select("image_id")

    def min_quality(self, r: dict) -> DataFrame | None:
        """At least an aesthetic score."""
        v = r.get("aesthetic_score")
        return None if v is None else perception(self.spark, self.d).filter(F.col("perception_iaa") >= float(v)).select("image_id")

    def evaluate(self, album: dict) -> DataFrame:
        """Images of an album: all rules by intersection, any by union; none without a usable rule."""
        parts = []
        for r in album.get("rules") or []:
            fn = getattr(self, str(r.get("type")), None) if str(r.get("type")) in RULE_TYPES else None
            got = fn(r) if fn else None
            if got is not None:
                parts.append(got.distinct())
        if not parts:
            return table(self.spark, self.d, "images").filter(F.lit(False)).select("image_id")
        if album.get("match", "all") == "any":
            return reduce(DataFrame.union, parts).distinct()
        return reduce(lambda a, b: a.join(b, "image_id", "left_semi"), parts)


RULE_TYPES = ("person", "date_range", "location", "keyword", "scene", "camera", "min_quality")
_Q_FACES = f"det_score >= 0.65 AND {_AREA} >= 2500"


@query("rule_person_all", f"WITH {SQL_FACE} SELECT image_id FROM face WHERE {_Q_FACES} AND person_id IN (1, 2) GROUP BY 1 HAVING count(DISTINCT person_id) = 2")
def rule_person_all(spark: SparkSession, d: str) -> DataFrame:
    """A1: images that show both of two persons."""
    return Rules(spark, d).evaluate({"rules": [{"type": "person", "person_ids": [1, 2], "match": "all"}]})


@query("rule_date", f"WITH {SQL_META} SELECT image_id FROM meta WHERE taken BETWEEN TIMESTAMP '2020-01-01' AND TIMESTAMP '2020-12-31 23:59:59'")
def rule_date(spark: SparkSession, d: str) -> DataFrame:
    """The year in review, its last evening included."""
    return Rules(spark, d).evaluate(year_in_review(2020))


@query("rule_location", f"WITH {SQL_META} SELECT image_id FROM meta WHERE location_country = 'Ostravia' AND location_city = 'Velmora'")
def rule_location(spark: SparkSession, d: str) -> DataFrame:
    """A3: images of a city."""
    return Rules(spark, d).evaluate({"rules": [{"type": "location", "country": "Ostravia", "city": "Velmora"}]})


_KW = "' ' || array_to_string(regexp_extract_all(lower(concat_ws('  ', description, main_subject, keywords)), '[\\p{L}\\p{N}_]+'), ' ') || ' '"


@query("rule_keyword", f"WITH {SQL_CAP} SELECT image_id FROM (SELECT image_id, {_KW} AS b FROM cap) WHERE contains(b, ' night market ') OR contains(b, ' espresso ')")
def rule_keyword(spark: SparkSession, d: str) -> DataFrame:
    """A4: any of two phrases."""
    return Rules(spark, d).evaluate({"rules": [{"type": "keyword", "keywords": ["night market", "espresso"]}]})


@query("rule_scene", f"WITH {SQL_CAP} SELECT image_id FROM cap WHERE scene_type IN ('street', 'event')")
def rule_scene(spark: SparkSession, d: str) -> DataFrame:
    """A5: two scene types."""
    return Rules(spark, d).evaluate({"rules": [{"type": "scene", "scenes": ["street", "event"]}]})


@query("rule_camera", f"WITH {SQL_META} SELECT image_id FROM meta WHERE camera_make = 'Orvex' AND camera_model = 'Orvex M5'")
def rule_camera(spark: SparkSession, d: str) -> DataFrame:
    """One camera."""
    return Rules(spark, d).evaluate({"rules": [{"type": "camera", "make": "Orvex", "model": "Orvex M5"}]})


@query("rule_min_quality", f"WITH {SQL_PER} SELECT image_id FROM per WHERE perception_iaa >= 7")
def rule_min_quality(spark: SparkSession, d: str) -> DataFrame:
    """A least aesthetic score."""
    return Rules(spark, d).evaluate({"rules": [{"type": "min_quality", "aesthetic_score": 7}]})


ALBUM = {"match": "all", "rules": [{"type": "location", "country": "Ostravia"}, {"type": "min_quality", "aesthetic_score": 5}, {"type": "nonsense"}]}
_ALBUM = f"{SQL_META}, {SQL_PER}, album AS (SELECT meta.image_id FROM meta JOIN per USING (image_id) WHERE location_country = 'Ostravia' AND perception_iaa >= 5)"


@query("rules_match_all", f"WITH {_ALBUM} SELECT image_id FROM album")
def rules_match_all(spark: SparkSession, d: str) -> DataFrame:
    """All rules, an unknown one skipped."""
    return Rules(spark, d).evaluate(ALBUM)


@query("rules_match_any", f"WITH {SQL_META}, {SQL_PER} SELECT image_id FROM meta WHERE location_country = 'Lusara' UNION SELECT image_id FROM per WHERE perception_iaa >= 8")
def rules_match_any(spark: SparkSession, d: str) -> DataFrame:
    """Any rule, each image once."""
    return Rules(spark, d).evaluate({"match": "any", "rules": [{"type": "location", "country": "Lusara"}, {"type": "min_quality", "aesthetic_score": 8}]})


@query("rules_empty", "SELECT image_id FROM images WHERE false")
def rules_empty(spark: SparkSession, d: str) -> DataFrame:
    """No rules, no images."""
    return Rules(spark, d).evaluate({"rules": []})


def year_in_review(year: int) -> dict:
    """Preset: everything of a year."""
    return {"match": "all", "rules": [{"type": "date_range", "from": f"{year}-01-01", "to": f"{year}-12-31"}]}


def on_this_day(month: int, day: int, years: range) -> dict:
    """Preset: one day of several years, as a union."""
    return {"match": "any", "rules": [{"type": "date_range", "from": f"{y}-{month:02d}-{day:02d}", "to": f"{y}-{month:02d}-{day:02d}"} for y in years]}


def together(person_ids: list[int]) -> dict:
    """Preset: images that show all of some persons."""
    return {"match": "all", "rules": [{"type": "person", "person_ids": person_ids, "match": "all"}]}


def person_timeline(person_id: int) -> dict:
    """Preset: every image of a person; the growth story is the same album told year by year."""
    return {"match": "all", "rules": [{"type": "person", "person_ids": [person_id], "match": "any"}]}


def location_story(country: str) -> dict:
    """Preset: every image of a country."""
    return {"match": "all", "rules": [{"type": "location", "country": country}]}


@query("preset_year_in_review", f"WITH {SQL_META} SELECT image_id FROM meta WHERE year(taken) = 2019")
def preset_year_in_review(spark: SparkSession, d: str) -> DataFrame:
    """A year in review."""
    return Rules(spark, d).evaluate(year_in_review(2019))


@query("preset_location", f"WITH {SQL_META} SELECT image_id FROM meta WHERE location_country = 'Lusara'")
def preset_location(spark: SparkSession, d: str) -> DataFrame:
    """A place."""
    return Rules(spark, d).evaluate(location_story("Lusara"))


@query("preset_person_timeline", f"WITH {SQL_FACE} SELECT DISTINCT image_id FROM face WHERE {_Q_FACES} AND person_id = 1")
def preset_person_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The story of a person."""
    return Rules(spark, d).evaluate(person_timeline(1))


@query("preset_together", f"WITH {SQL_FACE} SELECT image_id FROM face WHERE {_Q_FACES} AND person_id IN (1, 3) GROUP BY 1 HAVING count(DISTINCT person_id) = 2")
def preset_together(spark: SparkSession, d: str) -> DataFrame:
    """Images of two persons together."""
    return Rules(spark, d).evaluate(together([1, 3]))


@query("preset_on_this_day", f"WITH {SQL_META} SELECT image_id FROM meta WHERE strftime(taken, '%m-%d') = '07-14' AND year(taken) BETWEEN 2015 AND 2024")
def preset_on_this_day(spark: SparkSession, d: str) -> DataFrame:
    """The same day of ten years."""
    return Rules(spark, d).evaluate(on_this_day(7, 14, range(2015, 2025)))


@query("album_cover", f"WITH {_ALBUM} SELECT count(*) AS images, arg_max(image_id, {{'a': coalesce(perception_iaa, -1), 'i': image_id}}) AS cover FROM album LEFT JOIN per USING (image_id)")
def album_cover(spark: SparkSession, d: str) -> DataFrame:
    """Size and cover of an album, by score and id."""
    m = Rules(spark, d).evaluate(ALBUM).join(perception(spark, d), "image_id", "left")
    return m.agg(F.count(F.lit(1)).alias("images"), F.max_by("image_id", F.struct(F.coalesce("perception_iaa", F.lit(-1.0)), "image_id")).alias("cover"))


@query("album_check", f"WITH {_ALBUM} SELECT count(*) > 0 AS member FROM album WHERE image_id = 48")
def album_check(spark: SparkSession, d: str) -> DataFrame:
    """A10: whether one image belongs to an album."""
    return Rules(spark, d).evaluate(ALBUM).filter("image_id = 48").agg((F.count(F.lit(1)) > 0).alias("member"))


def moments(points: DataFrame, minutes: float = 30) -> DataFrame:
    """Points (album, image_id, taken, lat, lng) with ``moment``: a new one after a gap or at another place.

    An unknown place goes with any. Untimed points form moment 0.
    """
    cell = F.when(F.col("lat").isNotNull(), geohash(F.col("lat"), F.col("lng"), 6))
    t = with_day(points.filter("taken is not null").withColumn("t", seconds(F.col("taken"))).withColumn("cell", cell))
    t = with_previous(t, ["album"], "image_id", ["cell"])
    near = (F.col("t") - F.col("prev.t") <= minutes * 60) & (F.col("cell").isNull() | F.col("prev.cell").isNull() | (F.col("cell") == F.col("prev.cell")))
    t = running_sum(t, ["album"], "image_id", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1), "moment")
    cols = ["album", "image_id", "taken", "t", "lat", "lng", "moment"]
    untimed = points.filter("taken is null").withColumn("t", F.lit(None).cast("long")).withColumn("moment", F.lit(0).cast("long"))
    return t.select(*cols).unionByName(untimed.select(*cols))


def chapters(m: DataFrame, gap_hours: float = 4, km: float = 50) -> DataFrame:
    """Moments (album, moment, start, end, lat, lng) with ``chapter``: new after a gap, a distance or a year's end."""
    s = m.withColumn("t", F.col("start_t"))
    s = with_previous(with_day(s), ["album"], "moment", ["end_t", "start", "lat", "lng"])
    far = haversine_km(F.col("prev.lat"), F.col("prev.lng"), F.col("lat"), F.col("lng")) > km
    new = F.col("prev").isNull() | (F.col("start_t") - F.col("prev.end_t") > gap_hours * 3600) | F.coalesce(far, F.lit(False)) | (F.year("start") != F.year("prev.start"))
    return running_sum(s, ["album"], "moment", F.when(new, 1).otherwise(0), "chapter")


def album_points(spark: SparkSession, d: str) -> DataFrame:
    """Timeline points of the library, one album per country."""
    pos = lambda c: F.when(F.col("has_position"), F.col(c))
    return metadata(spark, d).filter("location_country is not null").select(F.col("location_country").alias("album"), "image_id", "taken", pos("gps_latitude").alias("lat"), pos("gps_longitude").alias("lng"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Timed points with their moment, materialised: chapters and heroes both start from it."""
    return cut(moments(album_points(spark, d)).filter("moment > 0"))


def moment_table(m: DataFrame) -> DataFrame:
    """Moments of a timeline with their span and mean position."""
    return m.groupBy("album", "moment").agg(
        F.count(F.lit(1)).alias("images"), F.min("taken").alias("start"), F.max("taken").alias("end"), F.min("t").alias("start_t"), F.max("t").alias("end_t"),
        F.avg("lat").alias("lat"), F.avg("lng").alias("lng"),
    )


_MOM = f"""WITH {SQL_META}, {SQL_PER}, pts AS (SELECT location_country AS album, image_id, taken, CASE WHEN has_position THEN gps_latitude END AS lat, CASE WHEN has_position THEN gps_longitude END AS lng FROM meta WHERE location_country IS NOT NULL),
  tt AS (SELECT *, epoch(taken)::BIGINT AS t, CASE WHEN lat IS NOT NULL THEN {geohash_sql('lat', 'lng', 6)} END AS cell FROM pts WHERE taken IS NOT NULL),
  nn AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w <= 1800 AND (cell IS NULL OR lag(cell) OVER w IS NULL OR cell = lag(cell) OVER w), false) THEN 0 ELSE 1 END AS new FROM tt WINDOW w AS (PARTITION BY album ORDER BY t, image_id)),
  mo AS (SELECT *, sum(new) OVER (PARTITION BY album ORDER BY t, image_id)::BIGINT AS moment FROM nn),
  mt AS (SELECT album, moment, count(*) AS images, min(taken) AS start, max(taken) AS "end", min(t) AS start_t, max(t) AS end_t, avg(lat) AS lat, avg(lng) AS lng FROM mo GROUP BY 1, 2),
  cn AS (SELECT *, CASE WHEN lag(moment) OVER w IS NULL OR start_t - lag(end_t) OVER w > 14400 OR coalesce({haversine_sql('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} > 50, false) OR year(start) <> year(lag(start) OVER w) THEN 1 ELSE 0 END AS nw FROM mt WINDOW w AS (PARTITION BY album ORDER BY start_t, moment)),
  ch AS (SELECT *, sum(nw) OVER (PARTITION BY album ORDER BY start_t, moment)::BIGINT AS chapter FROM cn)"""


_UNTIMED = "SELECT album, 0 AS moment, count(*) AS images, NULL::TIMESTAMP AS start, NULL::TIMESTAMP AS \"end\", round(avg(lat), 10) AS lat, round(avg(lng), 10) AS lng FROM pts WHERE taken IS NULL GROUP BY 1"


@query("moments", f'{_MOM} SELECT album, moment, images, start, "end", round(lat, 10) AS lat, round(lng, 10) AS lng FROM mt UNION ALL {_UNTIMED}')
def moments_q(spark: SparkSession, d: str) -> DataFrame:
    """Moments of each album; images without a time are moment 0."""
    m = moment_table(cut(moments(album_points(spark, d))))
    return m.select("album", "moment", "images", "start", "end", F.round("lat", 10).alias("lat"), F.round("lng", 10).alias("lng"))


@query("chapters", f'{_MOM} SELECT album, chapter, count(*) AS moments, sum(images)::BIGINT AS images, min(start) AS start, max("end") AS "end" FROM ch GROUP BY 1, 2')
def chapters_q(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of each album."""
    c = chapters(moment_table(timeline(spark, d)))
    return c.groupBy("album", "chapter").agg(F.count(F.lit(1)).alias("moments"), F.sum("images").alias("images"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("chapter_titles", f"""{_MOM}, c AS (SELECT album, chapter, min(start) AS a, max("end") AS b FROM ch GROUP BY 1, 2) SELECT album, chapter, CASE WHEN CAST(a AS DATE) = CAST(b AS DATE) THEN strftime(a, '%b %d, %Y') ELSE strftime(a, '%b %d, %Y') || ' - ' || strftime(b, '%b %d, %Y') END AS title FROM c""")
def chapter_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of chapters by their days."""
    c = chapters_q(spark, d)
    day = lambda x: F.date_format(x, "MMM dd, yyyy")
    same = F.to_date("start") == F.to_date("end")
    return c.select("album", "chapter", F.when(same, day("start")).otherwise(F.concat(day("start"), F.lit(" - "), day("end"))).alias("title"))


@query("chapter_gaps", f"{_MOM}, c AS (SELECT album, chapter, min(start_t) AS a, max(end_t) AS b FROM ch GROUP BY 1, 2) SELECT album, chapter, (a - lag(b) OVER (PARTITION BY album ORDER BY chapter)) AS gap_seconds FROM c QUALIFY gap_seconds IS NOT NULL")
def chapter_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Time between chapters, by joining each with the next number."""
    c = chapters(moment_table(timeline(spark, d))).groupBy("album", "chapter").agg(F.min("start_t").alias("a"), F.max("end_t").alias("b"))
    prev = c.select("album", (F.col("chapter") + 1).alias("chapter"), F.col("b").alias("pb"))
    return c.join(prev, ["album", "chapter"]).select("album", "chapter", (F.col("a") - F.col("pb")).alias("gap_seconds"))


def base_scores(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, iaa, score): aesthetic, technical and face parts of a hero's base score (Y3, G-A26)."""
    area = faces(spark, d).groupBy("image_id").agg(F.max(F.expr(_AREA)).alias("area"))
    p = perception(spark, d).join(area, "image_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = 0.35 * z("perception_iaa") / 10 + 0.15 * z("perception_iqa") / 10 + 0.25 * F.least(F.lit(1.0), z("area") / 40000)
    return p.select("image_id", F.col("perception_iaa").alias("iaa"), s.alias("score"))


_BASE = f"{SQL_FACE}, ar AS (SELECT image_id, max({_AREA}) AS area FROM face GROUP BY 1), bs AS (SELECT image_id, perception_iaa AS iaa, 0.35::DOUBLE * coalesce(perception_iaa, 0) / 10 + 0.15::DOUBLE * coalesce(perception_iqa, 0) / 10 + 0.25::DOUBLE * least(1, coalesce(area, 0) / 40000) AS score FROM per LEFT JOIN ar USING (image_id))"


@query("hero_base_score", f"WITH {SQL_PER}, {_BASE} SELECT image_id, round(score + 1e-9, 6) AS score FROM bs")
def hero_base_score(spark: SparkSession, d: str) -> DataFrame:
    """Base score of every image."""
    return base_scores(spark, d).select("image_id", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query("moment_hero", f"{_MOM}, {_BASE} SELECT album, moment, arg_max(image_id, {{'s': coalesce(round(score, 9), 0), 't': -t, 'i': -image_id}}) AS hero FROM mo LEFT JOIN bs USING (image_id) GROUP BY 1, 2")
def moment_hero(spark: SparkSession, d: str) -> DataFrame:
    """The best image of each moment, the first of equals."""
    m = timeline(spark, d).join(base_scores(spark, d), "image_id", "left")
    key = F.struct(F.coalesce(F.round("score", 9), F.lit(0.0)), -F.col("t"), -F.col("image_id"))
    return m.groupBy("album", "moment").agg(F.max_by("image_id", key).alias("hero"))


@query("chapter_cover", f"{_MOM}, {_BASE} SELECT ch.album, chapter, arg_max(image_id, {{'a': coalesce(iaa, -1), 'i': -image_id}}) AS cover FROM mo JOIN ch ON ch.album = mo.album AND ch.moment = mo.moment LEFT JOIN bs USING (image_id) GROUP BY 1, 2")
def chapter_cover(spark: SparkSession, d: str) -> DataFrame:
    """The most aesthetic image of each chapter."""
    line = timeline(spark, d)
    c = chapters(moment_table(line)).select("album", "moment", "chapter")
    m = line.join(c, ["album", "moment"]).join(base_scores(spark, d), "image_id", "left")
    return m.groupBy("album", "chapter").agg(F.max_by("image_id", F.struct(F.coalesce("iaa", F.lit(-1.0)), -F.col("image_id"))).alias("cover"))


@query("album_top_city", f"WITH {SQL_META}, n AS (SELECT location_country, location_city, count(*) AS n FROM meta WHERE trim(location_city) <> '' AND location_country IS NOT NULL GROUP BY 1, 2) SELECT location_country, arg_max(location_city, {{'n': n, 'c': location_city}}) AS city, max(n) AS images FROM n GROUP BY 1")
def album_top_city(spark: SparkSession, d: str) -> DataFrame:
    """The commonest city of each country, ties by name."""
    n = metadata(spark, d).filter("trim(location_city) <> '' and location_country is not null").groupBy("location_country", "location_city").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("location_country").agg(F.max_by("location_city", F.struct("n", "location_city")).alias("city"), F.max("n").alias("images"))


@query("chapter_hero_diverse")
def chapter_hero_diverse(spark: SparkSession, d: str) -> DataFrame:
    """One hero per moment of a chapter, each far from those chosen before.

    Candidates are the moment's three best by base score with a face vector;
    a chapter's moments are bounded by its time span.
    """
    line = timeline(spark, d)
    c = chapters(moment_table(line)).select("album", "moment", "chapter")
    m = line.join(base_scores(spark, d), "image_id", "left")
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), "image_id")), asc=False), 1, 3)
    cand = m.groupBy("album", "moment").agg(best.alias("x")).select("album", "moment", F.explode("x").alias("x")).select("album", "moment", "x.score", "x.image_id")
    vec = table(spark, d, "face_occurrences").filter("embedding is not null and size(embedding) = 512").select("image_id", "id", "embedding")
    vec = vec.join(cand.select("image_id").distinct(), "image_id", "left_semi").groupBy("image_id").agg(F.min_by("embedding", "id").alias("v"))
    rows = cand.join(vec, "image_id", "left").join(c, ["album", "moment"])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        out, chosen = [], []
        for moment, g in pdf.sort_values(["moment", "image_id"]).groupby("moment"):
            best, at, bv = -1.0, None, None
            for r in g.itertuples():
                v = None if r.v is None else np.asarray(r.v, float)
                v = None if v is None or not np.isfinite(v).all() or not v.any() else v / np.linalg.norm(v)
                far = 0.5 if not chosen else 0.0 if v is None else float(np.mean([1 - v @ w for w in chosen]))
                if r.score + 0.25 * far > best:
                    best, at, bv = r.score + 0.25 * far, r.image_id, v
            if bv is not None:
                chosen.append(bv)
            out.append((pdf["album"].iloc[0], pdf["chapter"].iloc[0], moment, at))
        return pd.DataFrame(out, columns=["album", "chapter", "moment", "hero"])

    return rows.select("album", "chapter", "moment", "image_id", "score", "v").groupBy("album", "chapter").applyInPandas(pick, "album string, chapter long, moment long, hero long")


@query(
    "story_eval",
    f"""{_MOM}, c AS (SELECT album, chapter, count(*) AS moments, sum(images) AS images FROM ch GROUP BY 1, 2)
      SELECT album, count(*) AS chapters, sum(moments)::BIGINT AS moments, sum(images)::BIGINT AS images, round(avg(moments), 6) AS moments_per_chapter, max(images)::BIGINT AS largest_chapter FROM c GROUP BY 1""",
)
def story_eval(spark: SparkSession, d: str) -> DataFrame:
    """Measures of a story on which its criteria rest."""
    c = chapters_q(spark, d)
    return c.groupBy("album").agg(F.count(F.lit(1)).alias("chapters"), F.sum("moments").alias("moments"), F.sum("images").alias("images"), F.round(F.avg("moments"), 6).alias("moments_per_chapter"), F.max("images").alias("largest_chapter"))


@query("rule_accuracy", f"WITH {_ALBUM}, {SQL_CAP}, truth AS (SELECT image_id FROM cap WHERE has_people = 1), b AS (SELECT count(*) AS n FROM album WHERE image_id IN (SELECT image_id FROM truth)) SELECT round(n / (SELECT count(*) FROM album)::DOUBLE, 6) AS prec, round(n / (SELECT count(*) FROM truth)::DOUBLE, 6) AS recall FROM b")
def rule_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """G-A27: precision and recall of one set against another."""
    a = Rules(spark, d).evaluate(ALBUM).withColumn("a", F.lit(1))
    t = captions(spark, d).filter("has_people = 1").select("image_id").withColumn("t", F.lit(1))
    j = a.join(t, "image_id", "full_outer").agg(F.sum(F.col("a") * F.col("t")).alias("n"), F.sum("a").alias("a"), F.sum("t").alias("t"))
    return j.select(F.round(F.col("n") / F.col("a"), 6).alias("prec"), F.round(F.col("n") / F.col("t"), 6).alias("recall"))
