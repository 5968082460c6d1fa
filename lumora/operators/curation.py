"""Identity edits, index upkeep, queue states and story output over the library."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.operators.fleet import _JOBS, jobs
from lumora.operators.search import _TOK, postings, tokens
from lumora.operators.story import _MOM, chapters, moment_table, timeline
from lumora.registry import query
from lumora.tables import table
from lumora.views import SQL_CAP, SQL_FACE, SQL_IMG, SQL_META, captions, faces, images, metadata


def first_present(df: DataFrame, field: str, sources: list[str]) -> Column:
    """Fallback merge: the first source's value of a field that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(F.col(f"{s}_{field}").cast("string")) != "", F.col(f"{s}_{field}")) for s in sources if f"{s}_{field}" in df.columns])


@query("metadata_fallback", f"WITH {SQL_META}, {SQL_CAP} SELECT image_id, coalesce(nullif(trim(lens_model), ''), nullif(trim(camera_model), ''), nullif(trim(camera_make), ''), 'unknown') AS gear FROM meta")
def metadata_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first of several fields that is there."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return metadata(spark, d).select("image_id", F.coalesce(full("lens_model"), full("camera_model"), full("camera_make"), F.lit("unknown")).alias("gear"))


@query("payload_round_trip", f"WITH {SQL_CAP} SELECT image_id, base64(encode(description)) AS payload, length(description) AS n FROM cap WHERE description IS NOT NULL")
def payload_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results packed for transport and unpacked again."""
    c = captions(spark, d).filter("description is not null").select("image_id", F.base64(F.encode("description", "UTF-8")).alias("p"))
    return c.select("image_id", F.regexp_replace("p", r"\s", "").alias("payload"), F.length(F.decode(F.unbase64("p"), "UTF-8")).alias("n"))


@query("index_delete", f"WITH {SQL_CAP}, t AS (SELECT image_id, unnest({_TOK.format(f='description')}) AS term FROM cap WHERE image_id % 7 <> 0 OR scene_type <> 'macro' OR scene_type IS NULL) SELECT count(*) AS occurrences, count(DISTINCT term) AS terms FROM t")
def index_delete(spark: SparkSession, d: str) -> DataFrame:
    """Postings after some documents left the index."""
    gone = captions(spark, d).filter("image_id % 7 = 0 and scene_type = 'macro'").select("image_id")
    p = postings(captions(spark, d), "image_id", ["description"]).join(gone, "image_id", "left_anti")
    return p.agg(F.sum("tf").alias("occurrences"), F.count_distinct("term").alias("terms"))


@query("fan_out", f"WITH {SQL_CAP} SELECT target, count(*) AS n FROM (SELECT unnest([CASE WHEN description IS NOT NULL THEN 'text' END, CASE WHEN detected_objects IS NOT NULL THEN 'objects' END, CASE WHEN ocr_text IS NOT NULL THEN 'ocr' END, CASE WHEN face_count > 0 THEN 'faces' END]) AS target FROM cap) WHERE target IS NOT NULL GROUP BY 1")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """One combined result split by target table."""
    parts = F.array(*[F.when(c, F.lit(t)) for t, c in (("text", F.col("description").isNotNull()), ("objects", F.col("detected_objects").isNotNull()), ("ocr", F.col("ocr_text").isNotNull()), ("faces", F.col("face_count") > 0))])
    return captions(spark, d).select(F.explode(parts).alias("target")).filter("target is not null").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def snippet(text: Column, term: str, width: int = 32) -> Column:
    """Up to ``width`` words around the first hit of a term, hits marked."""
    words = F.split(F.trim(text), r"\s+")
    plain = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_]", "")
    at = F.array_position(F.transform(words, plain), term).cast("int")
    start = F.greatest(at - width // 2, F.lit(1))
    return F.when(at > 0, F.array_join(F.transform(F.slice(words, start, F.lit(width)), lambda w: F.when(plain(w) == term, F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " "))


@query(
    "search_snippet",
    f"""WITH {SQL_CAP}, w AS (SELECT image_id, regexp_split_to_array(trim(description), '\\s+') AS words FROM cap WHERE description IS NOT NULL),
      p AS (SELECT *, list_position(list_transform(words, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_]', '', 'g')), 'market') AS pos FROM w)
      SELECT image_id, array_to_string(list_transform(words[greatest(pos - 16, 1):greatest(pos - 16, 1) + 31], lambda x: CASE WHEN regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_]', '', 'g') = 'market' THEN '<b>' || x || '</b>' ELSE x END), ' ') AS snippet FROM p WHERE pos > 0""",
)
def search_snippet(spark: SparkSession, d: str) -> DataFrame:
    """Text around a hit."""
    return captions(spark, d).filter("description is not null").select("image_id", snippet(F.col("description"), "market").alias("snippet")).filter("snippet is not null")


@query("queue_state_fold", f"{_JOBS} SELECT image_id, module, arg_max(status, {{'t': queued_at, 'j': job_id}}) AS status, count(*) AS transitions FROM jobs GROUP BY 1, 2")
def queue_state_fold(spark: SparkSession, d: str) -> DataFrame:
    """Q1 H7: the state of each job key, folded from its transitions."""
    return jobs(spark, d).groupBy("image_id", "module").agg(F.max_by("status", F.struct("queued_at", "job_id")).alias("status"), F.count(F.lit(1)).alias("transitions"))


@query("queue_eta", f"{_JOBS}, a AS (SELECT count_if(status IN ('pending', 'running')) AS remaining, count(DISTINCT CASE WHEN status = 'running' THEN node END) AS workers, avg(CASE WHEN status = 'done' THEN ms END) AS ms, count_if(status = 'done' AND queued_at > TIMESTAMP '2030-01-01') AS recent FROM jobs) SELECT remaining, workers, round(CASE WHEN recent > 0 THEN remaining / (recent / 10.0) WHEN ms > 0 AND workers > 0 THEN remaining * ms / 1000 / workers ELSE 0 END, 4)::DOUBLE AS eta_seconds FROM a")
def queue_eta(spark: SparkSession, d: str) -> DataFrame:
    """Q22: remaining time by recent rate, else by mean duration and workers, else none."""
    open_ = F.col("status").isin("pending", "running")
    recent = (F.col("status") == "done") & (F.col("queued_at") > F.lit("2030-01-01").cast("timestamp_ntz"))
    a = jobs(spark, d).agg(F.count_if(open_).alias("remaining"), F.count_distinct(F.when(F.col("status") == "running", F.col("node"))).alias("workers"), F.avg(F.when(F.col("status") == "done", F.col("ms"))).alias("ms"), F.count_if(recent).alias("recent"))
    eta = F.when(F.col("recent") > 0, F.try_divide("remaining", F.col("recent") / 10.0)).when((F.col("ms") > 0) & (F.col("workers") > 0), F.try_divide(F.col("remaining") * F.col("ms") / 1000, "workers")).otherwise(0.0)
    return a.select("remaining", "workers", F.round(eta, 4).alias("eta_seconds"))


@query("decode_order", f"WITH {SQL_IMG} SELECT image_id FROM img ORDER BY CASE WHEN image_id % 4 = 0 THEN 0 ELSE 1 END, CASE WHEN lower(format) IN ('cr3', 'nef', 'arw', 'dng') THEN 0 ELSE 1 END, file_path, image_id LIMIT 100")
def decode_order(spark: SparkSession, d: str) -> DataFrame:
    """Waiting images first, raw formats first, then by path."""
    raw = F.lower("format").isin("cr3", "nef", "arw", "dng")
    return images(spark, d).orderBy(F.when(F.col("image_id") % 4 == 0, 0).otherwise(1), F.when(raw, 0).otherwise(1), "file_path", "image_id").limit(100).select("image_id")


@query("person_relink", f"WITH {SQL_FACE} SELECT coalesce(CASE WHEN person_id = 2 THEN 1 ELSE person_id END, CASE WHEN cluster_id = 4 THEN 3 END) AS person_id, count(*) AS faces FROM face GROUP BY 1")
def person_relink(spark: SparkSession, d: str) -> DataFrame:
    """One person merged into another, a cluster linked to a third."""
    merged = F.when(F.col("person_id") == 2, F.lit(1).cast("long")).otherwise(F.col("person_id"))
    p = F.coalesce(merged, F.when(F.col("cluster_id") == 4, F.lit(3).cast("long")))
    return faces(spark, d, "person_id", "cluster_id").groupBy(p.alias("person_id")).agg(F.count(F.lit(1)).alias("faces"))


@query("identity_summary", f"WITH {SQL_FACE} SELECT lower(trim(identity_name)) AS identity, count(DISTINCT image_id) AS images, count(*) AS faces, round(avg(det_score), 10) AS score FROM face WHERE trim(identity_name) <> '' GROUP BY 1")
def identity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Names in any case with their images and faces."""
    f = faces(spark, d, "image_id", "identity_name", "det_score").filter("trim(identity_name) <> ''")
    return f.groupBy(F.lower(F.trim("identity_name")).alias("identity")).agg(F.count_distinct("image_id").alias("images"), F.count(F.lit(1)).alias("faces"), F.round(F.avg("det_score"), 10).alias("score"))


def spans(text: str, names: list[str]) -> tuple[list[str], str]:
    """Names found in a query, longest first from the left, and what is left of it."""
    left, found = text, []
    for n in sorted({x.strip() for x in names if x.strip()}, key=lambda x: (-len(x.split()), -len(x), x)):
        pat = re.compile(rf"(?<!\w){re.escape(n)}(?!\w)", re.IGNORECASE)
        if pat.search(left):
            found.append(n)
            left = pat.sub(" ", left)
    left = re.sub(r"(?i)(?<!\w)(photos?|pictures?|images?|of|with|and)(?!\w)", " ", left) if found else left
    return found, " ".join(left.split())


@query("story_tables", f"""{_MOM}, c AS (SELECT album, chapter, moment FROM ch) SELECT md5(album || '/' || chapter) AS chapter_key, md5(album || '/' || chapter || '/' || mo.moment) AS moment_key, image_id FROM mo JOIN c ON c.album = mo.album AND c.moment = mo.moment""".replace("JOIN c ON c.album = mo.album", "JOIN c ON c.album = mo.album").replace("md5(album || '/' || chapter)", "md5(mo.album || '/' || chapter)").replace("md5(album || '/' || chapter || '/'", "md5(mo.album || '/' || chapter || '/'"))
def story_tables(spark: SparkSession, d: str) -> DataFrame:
    """The three levels of a story with keys that every run repeats."""
    line = timeline(spark, d)
    c = chapters(moment_table(line)).select("album", "moment", "chapter")
    m = line.join(c, ["album", "moment"])
    return m.select(F.md5(F.concat_ws("/", "album", "chapter")).alias("chapter_key"), F.md5(F.concat_ws("/", "album", "chapter", "moment")).alias("moment_key"), "image_id")


@query("chapter_narrative", f"""{_MOM}, {SQL_CAP}, r AS (SELECT mo.album, chapter, description, row_number() OVER (PARTITION BY mo.album, chapter ORDER BY t, mo.image_id) AS rn FROM mo JOIN ch ON ch.album = mo.album AND ch.moment = mo.moment JOIN cap USING (image_id) WHERE description IS NOT NULL)
  SELECT album, chapter, string_agg(substr(description, 1, 60), ' ' ORDER BY rn) AS narrative FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def chapter_narrative(spark: SparkSession, d: str) -> DataFrame:
    """The first descriptions of a chapter put together."""
    line = timeline(spark, d)
    c = chapters(moment_table(line)).select("album", "moment", "chapter")
    m = line.join(c, ["album", "moment"])
    m = m.join(captions(spark, d).filter("description is not null").select("image_id", "description"), "image_id")
    first = F.slice(F.array_sort(F.collect_list(F.struct("t", "image_id", F.substring("description", 1, 60).alias("x")))), 1, 3)
    return m.groupBy("album", "chapter").agg(F.array_join(F.transform(first, lambda v: v["x"]), " ").alias("narrative"))


_LIST = "CASE WHEN json_valid(keywords) AND starts_with(trim(keywords), '[') THEN from_json(keywords, '[\"VARCHAR\"]') ELSE string_split(keywords, ',') END"


def keyword_list(text: Column) -> Column:
    """Entries of a JSON list, or of a list with commas, trimmed, without blanks, each once in order."""
    listed = F.when(F.startswith(F.trim(text), F.lit("[")), F.from_json(text, "array<string>", {"allowSingleQuotes": "false"}))
    parts = F.coalesce(listed, F.split(text, ","))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


@query("keyword_normalise", f"WITH {SQL_CAP} SELECT image_id, len(list_distinct(list_filter(list_transform({_LIST}, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> ''))) AS entries, list_filter(list_transform({_LIST}, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')[1] AS first FROM cap WHERE keywords IS NOT NULL")
def keyword_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Distinct entries of each keyword field, and the first."""
    k = captions(spark, d).filter("keywords is not null").select("image_id", keyword_list(F.col("keywords")).alias("k"))
    return k.select("image_id", F.size("k").alias("entries"), F.get("k", F.lit(0)).alias("first"))


@query("scan_ordered", "SELECT DISTINCT image_id FROM images ORDER BY image_id")
def scan_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Every image id, in order."""
    return table(spark, d, "images").select("image_id").distinct().orderBy("image_id")


@query("incomplete_metadata", f"WITH {SQL_META} SELECT count(*) AS images FROM meta WHERE camera_make IS NOT NULL AND date_time_original IS NULL AND lens_model IS NULL")
def incomplete_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Q24: metadata that names a camera and little else."""
    return metadata(spark, d).filter("camera_make is not null and date_time_original is null and lens_model is null").agg(F.count(F.lit(1)).alias("images"))


@query("missing_files", "SELECT count(DISTINCT image_id) AS images FROM face_occurrences WHERE image_id NOT IN (SELECT image_id FROM images)")
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    """Images that have faces and no hub row."""
    return table(spark, d, "face_occurrences").select("image_id").distinct().join(table(spark, d, "images").select("image_id"), "image_id", "left_anti").agg(F.count(F.lit(1)).alias("images"))
