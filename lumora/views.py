"""Views of a media library: one row per image or face, repeats and old versions removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.dates import taken_at, taken_sql
from lumora.operators.nearby import valid_position
from lumora.tables import current_columns, table


def images(spark: SparkSession, d: str) -> DataFrame:
    """Distinct images."""
    return table(spark, d, "images").dropDuplicates(["image_id"])


def _current(spark: SparkSession, d: str, name: str, together: tuple[str, ...] = ()) -> DataFrame:
    """Current rows of an analysis table; only columns that a query uses are read."""
    t = table(spark, d, name)
    alone = [(c,) for c in t.columns if c not in ("image_id", "analyzed_at", *together)]
    return current_columns(t, "image_id", [together, *alone] if together else alone)


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """Current metadata, with ``taken`` and ``has_position``."""
    cur = _current(spark, d, "analysis_metadata", ("gps_latitude", "gps_longitude"))
    return cur.withColumn("taken", taken_at(F.col("date_time_original"))).withColumn(
        "has_position", valid_position(F.col("gps_latitude"), F.col("gps_longitude"))
    )


def captions(spark: SparkSession, d: str) -> DataFrame:
    """Current captions."""
    return _current(spark, d, "analysis_caption")


def perception(spark: SparkSession, d: str) -> DataFrame:
    """Current perception scores; what is no number between 0 and 10 is null."""
    cur = _current(spark, d, "analysis_perception")
    for c in ("perception_iaa", "perception_iqa", "perception_ista"):
        cur = cur.withColumn(c, F.when(~F.isnan(c) & F.col(c).between(0, 10), F.col(c)))
    return cur


def faces(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct faces with the named columns (an id counts once)."""
    cols = columns or ("image_id", "face_idx", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "age", "gender", "identity_name", "cluster_id", "person_id", "det_score")
    return table(spark, d, "face_occurrences").select("id", *cols).dropDuplicates(["id"])


def wide(spark: SparkSession, d: str) -> DataFrame:
    """The star of one image: hub left-joined with its current analyses."""
    return (
        images(spark, d)
        .join(metadata(spark, d), "image_id", "left")
        .join(captions(spark, d), "image_id", "left")
        .join(perception(spark, d), "image_id", "left")
    )


# The same views as common table expressions, for the SQL twins.
_CUR = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY analyzed_at DESC) AS rn FROM {t}) WHERE rn = 1"
SQL_IMG = "img AS (SELECT DISTINCT * FROM images)"
SQL_META = (
    "meta AS (SELECT *, "
    + taken_sql("date_time_original")
    + " AS taken, coalesce(NOT isnan(gps_latitude) AND NOT isnan(gps_longitude) AND gps_latitude BETWEEN -90 AND 90 AND gps_longitude BETWEEN -180 AND 180"
    " AND NOT (gps_latitude = 0 AND gps_longitude = 0), false) AS has_position FROM ("
    + _CUR.format(t="analysis_metadata")
    + "))"
)
SQL_CAP = "cap AS (" + _CUR.format(t="analysis_caption") + ")"
_SCORE = "CASE WHEN NOT isnan({c}) AND {c} BETWEEN 0 AND 10 THEN {c} END AS {c}"
SQL_PER = (
    "per AS (SELECT image_id, "
    + ", ".join(_SCORE.format(c=c) for c in ("perception_iaa", "perception_iqa", "perception_ista"))
    + ", perception_iaa_label, perception_iqa_label, perception_ista_label FROM ("
    + _CUR.format(t="analysis_perception")
    + "))"
)
SQL_FACE = "face AS (SELECT DISTINCT id, image_id, face_idx, bbox_x1, bbox_y1, bbox_x2, bbox_y2, age, gender, identity_name, cluster_id, person_id, det_score FROM face_occurrences)"
