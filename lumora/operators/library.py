"""Projections, filters, joins, sorts and paging over the library views."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions.dates import day_part
from lumora.registry import query
from lumora.tables import current_rows, table
from lumora.views import SQL_CAP, SQL_FACE, SQL_IMG, SQL_META, SQL_PER, captions, faces, images, metadata, perception, wide

_WIDE = f"WITH {SQL_IMG}, {SQL_META}, {SQL_CAP}, {SQL_PER}"
_STAR = f"{_WIDE}, w AS (SELECT * FROM img LEFT JOIN meta USING (image_id) LEFT JOIN cap USING (image_id) LEFT JOIN per USING (image_id))"


@query(
    "wide_star",
    f"""{_STAR} SELECT image_id, file_path, width, height, camera_make, camera_model, iso, taken, location_city, location_country, scene_type, main_subject,
      coalesce(face_count, 0) AS face_count, coalesce(has_people, 0) = 1 AS has_people, round(perception_iaa, 6) AS aesthetic, round(perception_iqa, 6) AS quality FROM w""",
)
def wide_star(spark: SparkSession, d: str) -> DataFrame:
    """The wide row of every image with its fallbacks."""
    return wide(spark, d).select(
        "image_id", "file_path", "width", "height", "camera_make", "camera_model", "iso", "taken", "location_city", "location_country", "scene_type", "main_subject",
        F.coalesce("face_count", F.lit(0)).alias("face_count"), (F.coalesce("has_people", F.lit(0)) == 1).alias("has_people"),
        F.round("perception_iaa", 6).alias("aesthetic"), F.round("perception_iqa", 6).alias("quality"),
    )


@query("point_lookup", "WITH " + SQL_IMG + " SELECT image_id, file_path, format FROM img WHERE image_id = 48")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One image by id; the filter reaches the scan."""
    return table(spark, d, "images").filter("image_id = 48").dropDuplicates(["image_id"]).select("image_id", "file_path", "format")


@query("latest_child", "SELECT image_id, description FROM (SELECT image_id, description, row_number() OVER (PARTITION BY image_id ORDER BY analyzed_at DESC) AS rn FROM (SELECT * FROM analysis_caption WHERE trim(description) <> '')) WHERE rn = 1")
def latest_child(spark: SparkSession, d: str) -> DataFrame:
    """The latest description that is not blank."""
    return current_rows(table(spark, d, "analysis_caption").filter("trim(description) <> ''"), "image_id", ["description"])


@query("filter_icase_contains", f"WITH {SQL_META} SELECT image_id FROM meta WHERE contains(lower(camera_model), 'phone') OR contains(lower(lens_model), '70-200')")
def filter_icase_contains(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive substring, wildcards taken literally."""
    return metadata(spark, d).filter(F.contains(F.lower("camera_model"), F.lit("phone")) | F.contains(F.lower("lens_model"), F.lit("70-200"))).select("image_id")


@query("filter_like_live", f"WITH {SQL_META} SELECT image_id, concat_ws(' | ', camera_make, camera_model, lens_model) AS snippet FROM meta WHERE camera_model ILIKE '%k-_00%'")
def filter_like_live(spark: SparkSession, d: str) -> DataFrame:
    """EXIF search with live wildcards and a joined snippet."""
    return metadata(spark, d).filter(F.col("camera_model").ilike("%k-_00%")).select("image_id", F.concat_ws(" | ", "camera_make", "camera_model", "lens_model").alias("snippet"))


@query("filter_range", f"{_STAR} SELECT image_id FROM w WHERE iso BETWEEN 100 AND 800 AND perception_iaa >= 6 AND coalesce(face_count, 0) BETWEEN 1 AND 4")
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    """P5: numeric ranges over several tables."""
    m = metadata(spark, d).filter(F.col("iso").between(100, 800)).select("image_id")
    p = perception(spark, d).filter("perception_iaa >= 6").select("image_id")
    c = captions(spark, d).filter(F.col("face_count").between(1, 4)).select("image_id")
    return images(spark, d).select("image_id").join(m, "image_id", "left_semi").join(p, "image_id", "left_semi").join(c, "image_id", "left_semi")


@query("filter_date_range", f"WITH {SQL_META} SELECT image_id, taken FROM meta WHERE taken >= TIMESTAMP '2018-01-01' AND taken <= TIMESTAMP '2019-06-30 23:59:59'")
def filter_date_range(spark: SparkSession, d: str) -> DataFrame:
    """A closed range of days, whatever the spelling."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2018-01-01 00:00:00", "2019-06-30 23:59:59"))
    return metadata(spark, d).filter(F.col("taken").between(lo, hi)).select("image_id", "taken")


@query("filter_month_day", f"WITH {SQL_META} SELECT image_id FROM meta WHERE strftime(taken, '%m-%d') = '07-14'")
def filter_month_day(spark: SparkSession, d: str) -> DataFrame:
    """The same day of every year."""
    return metadata(spark, d).filter(F.date_format("taken", "MM-dd") == "07-14").select("image_id")


@query(
    "filter_time_of_day",
    f"WITH {SQL_META} SELECT CASE WHEN h BETWEEN 5 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS part, count(*) AS images FROM (SELECT hour(taken) AS h FROM meta WHERE taken IS NOT NULL) GROUP BY 1",
)
def filter_time_of_day(spark: SparkSession, d: str) -> DataFrame:
    """Images by part of the day."""
    return metadata(spark, d).filter("taken is not null").groupBy(day_part(F.col("taken")).alias("part")).agg(F.count(F.lit(1)).alias("images"))


@query("filter_tristate", f"{_STAR} SELECT image_id FROM w WHERE has_people = 0 OR has_people IS NULL")
def filter_tristate(spark: SparkSession, d: str) -> DataFrame:
    """Images without people, unknown ones included."""
    with_people = captions(spark, d).filter("has_people = 1 or has_people not in (0, 1)").select("image_id")
    return images(spark, d).select("image_id").join(with_people, "image_id", "left_anti")


@query("filter_prefix", f"WITH {SQL_IMG} SELECT image_id FROM img WHERE starts_with(replace(file_path, '\\', '/'), '/library/2019/')")
def filter_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Images below a folder, both kinds of slash."""
    return images(spark, d).filter(F.startswith(norm_path(F.col("file_path")), F.lit("/library/2019/"))).select("image_id")


@query("filter_prefix_flat", f"WITH {SQL_IMG} SELECT image_id FROM img WHERE starts_with(replace(file_path, '\\', '/'), '/library/') AND NOT contains(substr(replace(file_path, '\\', '/'), 10), '/')")
def filter_prefix_flat(spark: SparkSession, d: str) -> DataFrame:
    """Images in a folder itself, none deeper."""
    p = norm_path(F.col("file_path"))
    return images(spark, d).filter(F.startswith(p, F.lit("/library/")) & (F.instr(F.substring(p, 10, 1 << 20), "/") == 0)).select("image_id")


def norm_path(c: Column) -> Column:
    """Path with forward slashes."""
    return F.translate(c, "\\", "/")


@query("processed_any", f"{_WIDE} SELECT image_id FROM img WHERE EXISTS (SELECT 1 FROM meta m WHERE m.image_id = img.image_id) OR EXISTS (SELECT 1 FROM cap c WHERE c.image_id = img.image_id) OR EXISTS (SELECT 1 FROM per p WHERE p.image_id = img.image_id)")
def processed_any(spark: SparkSession, d: str) -> DataFrame:
    """Images with any analysis."""
    ids = [table(spark, d, t).select("image_id") for t in ("analysis_metadata", "analysis_caption", "analysis_perception")]
    return images(spark, d).select("image_id").join(ids[0].union(ids[1]).union(ids[2]).distinct(), "image_id", "left_semi")


@query("anti_unprocessed", f"{_WIDE} SELECT image_id FROM img WHERE image_id NOT IN (SELECT image_id FROM cap) AND image_id NOT IN (SELECT image_id FROM per)")
def anti_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    """Images with neither caption nor scores."""
    i = images(spark, d).select("image_id")
    return i.join(table(spark, d, "analysis_caption").select("image_id"), "image_id", "left_anti").join(table(spark, d, "analysis_perception").select("image_id"), "image_id", "left_anti")


@query("semi_candidates", f"WITH {SQL_IMG} SELECT image_id, file_path FROM img WHERE image_id IN (SELECT image_id FROM face_occurrences WHERE person_id = 3)")
def semi_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Images restricted to a candidate set."""
    return images(spark, d).join(table(spark, d, "face_occurrences").filter("person_id = 3").select("image_id"), "image_id", "left_semi").select("image_id", "file_path")


@query("filter_constant_false", f"WITH {SQL_IMG} SELECT image_id FROM img WHERE false")
def filter_constant_false(spark: SparkSession, d: str) -> DataFrame:
    """An empty candidate set gives no rows and no scan."""
    return table(spark, d, "images").filter(F.lit(False)).select("image_id")


_BEST = "12 * coalesce(perception_iaa, 0) + 0.25 * coalesce(perception_iqa, 0) * 10 - 120 * coalesce((10 - perception_ista) / 100, 0)"


@query("sort_best", f"{_STAR} SELECT image_id, round({_BEST}, 6) AS score FROM w ORDER BY round({_BEST}, 6) DESC, perception_iaa DESC NULLS LAST, perception_iqa DESC NULLS LAST, image_id DESC LIMIT 100")
def sort_best(spark: SparkSession, d: str) -> DataFrame:
    """The best images by the weighted score, ties by its parts and the id."""
    v = images(spark, d).join(perception(spark, d), "image_id", "left")
    score = F.round(F.expr(_BEST), 6)
    return v.select("image_id", "perception_iaa", "perception_iqa", score.alias("score")).orderBy(F.desc("score"), F.desc_nulls_last("perception_iaa"), F.desc_nulls_last("perception_iqa"), F.desc("image_id")).limit(100).select("image_id", "score")


@query("sort_cleanest_nulls", f"{_STAR} SELECT image_id FROM w ORDER BY perception_ista ASC NULLS FIRST, image_id DESC LIMIT 200")
def sort_cleanest_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Ascending scores, unmeasured images first."""
    return images(spark, d).join(perception(spark, d), "image_id", "left").orderBy(F.asc_nulls_first("perception_ista"), F.desc("image_id")).limit(200).select("image_id")


@query("sort_newest", f"{_STAR} SELECT image_id, taken FROM w ORDER BY taken DESC NULLS LAST, image_id DESC LIMIT 100")
def sort_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest images."""
    return images(spark, d).select("image_id").join(metadata(spark, d).select("image_id", "taken"), "image_id", "left").orderBy(F.desc_nulls_last("taken"), F.desc("image_id")).limit(100)


@query("page_offset", f"WITH {SQL_IMG} SELECT image_id, file_path FROM img ORDER BY file_path, image_id LIMIT 50 OFFSET 100")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    """A page by offset; offsets of 5,000 and more are empty by contract."""
    return offset_page(images(spark, d).select("image_id", "file_path").orderBy("file_path", "image_id"), 100, 50)


def offset_page(ordered: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows of a page; ``limit`` at most 500, nothing from offset 5,000 on."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset not negative")
    return ordered.filter(F.lit(False)) if offset >= 5000 else ordered.offset(offset).limit(limit)


def encode_cursor(path: str, image_id: int) -> str:
    """Opaque token of a position in (path, id) order."""
    return base64.urlsafe_b64encode(json.dumps([path, image_id]).encode()).decode().rstrip("=")


def decode_cursor(token: str) -> tuple[str, int]:
    """Position of a token; ValueError for a broken one."""
    try:
        path, image_id = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        return str(path), int(image_id)
    except Exception as e:
        raise ValueError("broken cursor") from e


def keyset_page(df: DataFrame, cursor: str | None, limit: int) -> DataFrame:
    """``limit`` + 1 rows after the cursor in (path, id) order; the extra one tells of a next page."""
    if cursor:
        path, image_id = decode_cursor(cursor)
        df = df.filter((F.col("file_path") > path) | ((F.col("file_path") == path) & (F.col("image_id") > image_id)))
    return df.orderBy("file_path", "image_id").limit(limit + 1)


@query("page_keyset", f"WITH {SQL_IMG} SELECT image_id, file_path FROM img WHERE (file_path, image_id) > ('/library/2019/', 0) ORDER BY file_path, image_id LIMIT 51")
def page_keyset(spark: SparkSession, d: str) -> DataFrame:
    """T4 B2: the next page by cursor."""
    return keyset_page(images(spark, d).select("image_id", "file_path"), encode_cursor("/library/2019/", 0), 50)


@query("bounded_count", f"WITH {SQL_META} SELECT CASE WHEN n > 1000 THEN NULL ELSE n END AS total FROM (SELECT count(*) AS n FROM (SELECT 1 FROM meta WHERE iso >= 100 LIMIT 1001))")
def bounded_count(spark: SparkSession, d: str) -> DataFrame:
    """G-A28: a count that gives up beyond a thousand."""
    n = metadata(spark, d).filter("iso >= 100").limit(1001).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.when(F.col("n") <= 1000, F.col("n")).alias("total"))


def folder_rollup_of(df: DataFrame, path: str = "file_path") -> DataFrame:
    """Every ancestor folder with the images at any depth below it, its own images and its child folders."""
    parts = F.filter(F.split(norm_path(F.col(path)), "/"), lambda x: x != "")
    lead = F.when(F.startswith(norm_path(F.col(path)), F.lit("/")), "/").otherwise("")
    d = df.select(parts.alias("parts"), lead.alias("lead")).filter(F.size("parts") > 1)
    up = d.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.struct(
            F.concat("lead", F.array_join(F.slice("parts", 1, i), "/")).alias("folder"),
            F.when(i > 1, F.concat("lead", F.array_join(F.slice("parts", 1, i - 1), "/"))).alias("parent"),
            (i == F.size("parts") - 1).alias("direct")))).alias("f")
    ).select("f.*")
    sizes = up.groupBy("folder", "parent").agg(F.count(F.lit(1)).alias("images"), F.count_if("direct").alias("own_images"))
    kids = sizes.filter("parent is not null").groupBy(F.col("parent").alias("folder")).agg(F.count(F.lit(1)).alias("children"))
    return sizes.join(kids, "folder", "left").select("folder", "parent", "images", "own_images", F.coalesce("children", F.lit(0)).alias("children"))


_ROLL = f"""WITH {SQL_IMG}, s AS (SELECT CASE WHEN starts_with(replace(file_path, '\\', '/'), '/') THEN '/' ELSE '' END AS lead,
   list_filter(string_split(replace(file_path, '\\', '/'), '/'), lambda x: x <> '') AS parts FROM img),
 u AS (SELECT lead, parts, unnest(range(1, len(parts))) AS i FROM s WHERE len(parts) > 1),
 f AS (SELECT lead || array_to_string(parts[1:i], '/') AS folder, CASE WHEN i > 1 THEN lead || array_to_string(parts[1:i-1], '/') END AS parent, i = len(parts) - 1 AS direct FROM u),
 g AS (SELECT folder, parent, count(*) AS images, count_if(direct) AS own_images FROM f GROUP BY 1, 2),
 k AS (SELECT parent AS folder, count(*) AS children FROM g WHERE parent IS NOT NULL GROUP BY 1)"""


@query("folder_rollup", f"{_ROLL} SELECT g.folder, parent, images, own_images, coalesce(children, 0) AS children FROM g LEFT JOIN k USING (folder)")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    """B1: cumulative counts of every folder."""
    return folder_rollup_of(images(spark, d))


@query("folder_children", f"{_ROLL} SELECT folder, images FROM g WHERE lower(parent) = '/library' ORDER BY lower(folder)")
def folder_children(spark: SparkSession, d: str) -> DataFrame:
    """The folders in a folder, names compared without case."""
    return folder_rollup_of(images(spark, d)).filter(F.lower("parent") == "/library").select("folder", "images")


#: File suffixes that a folder scan takes for images.
SUFFIXES = ("arw", "bmp", "cr2", "cr3", "dng", "gif", "heic", "heif", "jpeg", "jpg", "nef", "orf", "png", "raf", "rw2", "tif", "tiff", "webp")


@query("format_breakdown", f"WITH {SQL_IMG} SELECT lower(coalesce(nullif(trim(format), ''), regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))) AS format, count(*) AS images, sum(file_size)::BIGINT AS bytes FROM img GROUP BY 1")
def format_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Images by format, case ignored, from the suffix where it is missing."""
    suffix = F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)
    f = F.lower(F.coalesce(F.nullif(F.trim("format"), F.lit("")), suffix))
    return images(spark, d).groupBy(f.alias("format")).agg(F.count(F.lit(1)).alias("images"), F.sum("file_size").alias("bytes"))


@query("fingerprint", f"WITH {SQL_IMG} SELECT image_id, concat_ws('|', file_path, file_size, coalesce(width, 0) * coalesce(height, 0)) AS print, sha256(concat_ws('|', file_path, file_size)) AS digest FROM img")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """S3: cheap and hashed fingerprints of a file."""
    i = images(spark, d)
    area = (F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))).cast("string")
    return i.select("image_id", F.concat_ws("|", "file_path", F.col("file_size").cast("string"), area).alias("print"), F.sha2(F.concat_ws("|", "file_path", F.col("file_size").cast("string")), 256).alias("digest"))


@query(
    "registration_anti_join",
    f"""{_WIDE}, m(module) AS (VALUES ('metadata'), ('caption'), ('perception')),
      done AS (SELECT image_id, 'metadata' AS module FROM meta UNION ALL SELECT image_id, 'caption' FROM cap UNION ALL SELECT image_id, 'perception' FROM per)
      SELECT module, count(*) AS jobs FROM (SELECT image_id, module FROM img, m EXCEPT SELECT image_id, module FROM done) GROUP BY 1""",
)
def registration_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Analyses still to be queued, by module."""
    done = None
    for module, t in (("metadata", "analysis_metadata"), ("caption", "analysis_caption"), ("perception", "analysis_perception")):
        part = table(spark, d, t).select("image_id", F.lit(module).alias("module"))
        done = part if done is None else done.union(part)
    want = images(spark, d).select("image_id", F.explode(F.array(*[F.lit(m) for m in ("metadata", "caption", "perception")])).alias("module"))
    return want.join(done, ["image_id", "module"], "left_anti").groupBy("module").agg(F.count(F.lit(1)).alias("jobs"))


def latest_wins(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: of all rows of a key the one with the greatest ``version``."""
    cols = [c for c in base.columns if c not in (key, version)]
    return current_rows(base.unionByName(changes), key, cols, version)


@query("upsert_latest_wins", "SELECT image_id, perception_iaa_label AS label FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY analyzed_at DESC) AS rn FROM analysis_perception) WHERE rn = 1")
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Old and new rows merged, the latest of each image kept."""
    t = table(spark, d, "analysis_perception").select("image_id", F.col("perception_iaa_label").alias("label"), "analyzed_at")
    return latest_wins(t.filter("analyzed_at < '2024-01-05'"), t.filter("analyzed_at >= '2024-01-05'"), "image_id", "analyzed_at")


@query("upsert_ignore", "SELECT image_id, min(analyzed_at) AS first_seen FROM analysis_caption GROUP BY 1")
def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Insert-or-ignore keeps the first row of a key."""
    return table(spark, d, "analysis_caption").groupBy("image_id").agg(F.min("analyzed_at").alias("first_seen"))


@query("override_overlay", f"WITH {SQL_META}, o AS (SELECT DISTINCT image_id, 'Velmora' AS v FROM face_occurrences WHERE person_id = 5) SELECT meta.image_id, coalesce(o.v, location_city) AS location_city, o.v IS NOT NULL AS overridden FROM meta LEFT JOIN o USING (image_id)")
def override_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Overrides laid over the stored field on reading."""
    o = table(spark, d, "face_occurrences").filter("person_id = 5").select("image_id", F.lit("Velmora").alias("v")).distinct()
    return metadata(spark, d).join(o, "image_id", "left").select("image_id", F.coalesce("v", "location_city").alias("location_city"), F.col("v").isNotNull().alias("overridden"))


@query("cascade_delete", f"WITH {SQL_IMG}, {SQL_CAP}, gone AS (SELECT image_id FROM img WHERE lower(format) IN ('gif', 'png')) SELECT image_id FROM cap WHERE image_id NOT IN (SELECT image_id FROM gone)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Children left after their images are purged."""
    gone = table(spark, d, "images").filter(F.lower("format").isin("gif", "png")).select("image_id")
    return table(spark, d, "analysis_caption").select("image_id").distinct().join(gone, "image_id", "left_anti")


@query("path_mapping", f"WITH {SQL_IMG} SELECT image_id, CASE WHEN starts_with(p, '/library/2019/') THEN '/mnt/a/' || substr(p, 15) WHEN starts_with(p, '/library/') THEN '/mnt/b/' || substr(p, 10) ELSE p END AS path FROM (SELECT image_id, replace(file_path, '\\', '/') AS p FROM img)")
def path_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The first matching prefix rewrites a path, at a separator."""
    return images(spark, d).select("image_id", map_path(norm_path(F.col("file_path")), [("/library/2019", "/mnt/a"), ("/library", "/mnt/b")]).alias("path"))


def map_path(path: Column, rules: list[tuple[str, str]]) -> Column:
    """``path`` under the first rule (old prefix, new prefix) that matches."""
    out = path
    for old, new in reversed(rules):
        hit = (path == old) | F.startswith(path, F.lit(old + "/"))
        out = F.when(hit, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))).otherwise(out)
    return out


@query(
    "face_pass_gate",
    f"""WITH {SQL_CAP} SELECT image_id FROM cap WHERE contains(lower(coalesce(scene_type, '')), 'portrait') OR has_people = 1 OR face_count > 0
      OR regexp_matches(lower(coalesce(keywords, '')), '\\b(person|people|man|woman|child|face|portrait|crowd)\\b')""",
)
def face_pass_gate(spark: SparkSession, d: str) -> DataFrame:
    """Captions that suggest a person."""
    words = r"\b(person|people|man|woman|child|face|portrait|crowd)\b"
    gate = F.contains(F.lower(F.coalesce("scene_type", F.lit(""))), F.lit("portrait")) | (F.col("has_people") == 1) | (F.col("face_count") > 0) | F.lower(F.coalesce("keywords", F.lit(""))).rlike(words)
    return captions(spark, d).filter(gate).select("image_id")


_LAD = [(9, "Outstanding"), (8, "Excellent"), (7, "Very good"), (6, "Good"), (5, "Average"), (3, "Below average")]


@query("label_ladder", f"WITH {SQL_PER} SELECT image_id, CASE " + " ".join(f"WHEN perception_iaa >= {t} THEN '{v}'" for t, v in _LAD) + " WHEN perception_iaa IS NOT NULL THEN 'Poor' END AS label, CASE WHEN perception_iqa <= 3 THEN 'low' WHEN perception_iqa <= 7 THEN 'mid' WHEN perception_iqa IS NOT NULL THEN 'high' END AS level FROM per")
def label_ladder(spark: SparkSession, d: str) -> DataFrame:
    """M8 M9: labels by thresholds from above and from below."""
    up = F.when(F.lit(False), "")
    for t, v in _LAD:
        up = up.when(F.col("perception_iaa") >= t, v)
    up = up.when(F.col("perception_iaa").isNotNull(), "Poor")
    down = F.when(F.col("perception_iqa") <= 3, "low").when(F.col("perception_iqa") <= 7, "mid").when(F.col("perception_iqa").isNotNull(), "high")
    return perception(spark, d).select("image_id", up.alias("label"), down.alias("level"))


_LEN = "length(coalesce(description, ''))"


@query("desc_quality", f"WITH {SQL_CAP} SELECT image_id, CASE WHEN {_LEN} = 0 THEN 0.0 WHEN {_LEN} < 32 THEN 0.25 WHEN {_LEN} < 96 THEN 0.55 WHEN {_LEN} < 800 THEN 0.85 ELSE 0.7 END::DOUBLE AS desc_quality, substr(description, 1, 500) AS summary FROM cap")
def desc_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of a description by its length, and its summary."""
    n = F.length(F.coalesce("description", F.lit("")))
    q = F.when(n == 0, 0.0).when(n < 32, 0.25).when(n < 96, 0.55).when(n < 800, 0.85).otherwise(0.7)
    return captions(spark, d).select("image_id", q.alias("desc_quality"), F.substring("description", 1, 500).alias("summary"))


@query("length_histogram", f"WITH {SQL_CAP} SELECT {_LEN} // 20 AS bin, count(*) AS images, count_if({_LEN} >= 96) AS rich FROM cap GROUP BY 1")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    """G-A22: descriptions by length."""
    n = F.length(F.coalesce("description", F.lit("")))
    return captions(spark, d).groupBy(F.floor(n / 20).alias("bin")).agg(F.count(F.lit(1)).alias("images"), F.count_if(n >= 96).alias("rich"))


@query("json_unnest_count", f"WITH {SQL_CAP} SELECT name, count(DISTINCT image_id) AS images, count(*) AS faces FROM (SELECT image_id, unnest(from_json(face_identities, '[\"VARCHAR\"]')) AS name FROM cap WHERE json_valid(face_identities)) GROUP BY 1")
def json_unnest_count(spark: SparkSession, d: str) -> DataFrame:
    """Names in JSON arrays, by image and by face."""
    n = captions(spark, d).select("image_id", F.explode(F.from_json("face_identities", "array<string>")).alias("name"))
    return n.groupBy("name").agg(F.count_distinct("image_id").alias("images"), F.count(F.lit(1)).alias("faces"))


@query("json_contains", f"WITH {SQL_CAP} SELECT image_id FROM cap WHERE json_valid(face_identities) AND list_contains(from_json(face_identities, '[\"VARCHAR\"]'), 'Unknown')")
def json_contains(spark: SparkSession, d: str) -> DataFrame:
    """JSON arrays that hold a value."""
    return captions(spark, d).filter(F.array_contains(F.from_json("face_identities", "array<string>"), "Unknown")).select("image_id")


@query("keyword_extract", f"WITH {SQL_CAP} SELECT image_id, array_to_string(list_filter(string_split(regexp_replace(lower(description), '[,.]', '', 'g'), ' '), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'was', 'for', 'that', 'with')), ' ') AS words FROM cap WHERE description IS NOT NULL")
def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    """Words of a description without punctuation and stop words."""
    w = F.split(F.regexp_replace(F.lower("description"), "[,.]", ""), " ")
    w = F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin("the", "and", "was", "for", "that", "with"))
    return captions(spark, d).filter("description is not null").select("image_id", F.array_join(w, " ").alias("words"))


@query("exif_strings", f"WITH {SQL_META} SELECT image_id, round(CASE WHEN contains(exposure_time, '/') THEN TRY_CAST(split_part(exposure_time, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part(exposure_time, '/', 2) AS DOUBLE), 0) ELSE TRY_CAST(exposure_time AS DOUBLE) END, 6) AS seconds, round(log2(f_number * f_number), 6) AS av FROM meta WHERE exposure_time IS NOT NULL AND f_number > 0 AND NOT isnan(f_number)")
def exif_strings(spark: SparkSession, d: str) -> DataFrame:
    """Exposure in seconds and aperture value."""
    m = metadata(spark, d).filter("exposure_time is not null and f_number > 0 and not isnan(f_number)")
    parts = F.split("exposure_time", "/")
    sec = F.when(F.contains("exposure_time", F.lit("/")), F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))).otherwise(F.col("exposure_time").try_cast("double"))
    return m.select("image_id", F.round(sec, 6).alias("seconds"), F.round(F.log2(F.col("f_number") * F.col("f_number")), 6).alias("av"))


@query("set_intersect", f"{_WIDE} SELECT image_id FROM meta WHERE iso >= 800 INTERSECT SELECT image_id FROM cap WHERE scene_type = 'street' INTERSECT SELECT image_id FROM per WHERE perception_iaa >= 5")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Images in all of several sets."""
    return (
        metadata(spark, d).filter("iso >= 800").select("image_id")
        .intersect(captions(spark, d).filter("scene_type = 'street'").select("image_id"))
        .intersect(perception(spark, d).filter("perception_iaa >= 5").select("image_id"))
    )


@query("set_union", f"{_WIDE} SELECT image_id FROM meta WHERE iso >= 6400 UNION SELECT image_id FROM cap WHERE scene_type = 'macro'")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    """Images in any of several sets, once."""
    return metadata(spark, d).filter("iso >= 6400").select("image_id").union(captions(spark, d).filter("scene_type = 'macro'").select("image_id")).distinct()


@query("random_sample", None)
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of descriptions, the same on any layout of the data."""
    return captions(spark, d).filter("description is not null").orderBy(F.xxhash64(F.lit(3), "image_id"), "image_id").limit(50).select("image_id", "description")


@query("face_details", f"WITH {SQL_FACE} SELECT image_id, string_agg(identity_name || ':' || coalesce(CAST(age AS VARCHAR), '?') || ':' || coalesce(gender, '?'), ', ' ORDER BY face_idx) AS details FROM face WHERE identity_name IS NOT NULL GROUP BY 1")
def face_details(spark: SparkSession, d: str) -> DataFrame:
    """Faces of an image as text."""
    f = faces(spark, d).filter("identity_name is not null")
    label = F.concat_ws(":", "identity_name", F.coalesce(F.col("age").cast("string"), F.lit("?")), F.coalesce("gender", F.lit("?")))
    g = f.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("face_idx", label.alias("l")))).alias("x"))
    return g.select("image_id", F.array_join(F.transform("x", lambda v: v["l"]), ", ").alias("details"))
