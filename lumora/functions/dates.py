"""Capture times in the two spellings that library views read: EXIF and ISO."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^\d{4}[:-]\d{2}[:-]\d{2}[T ]\d{2}:\d{2}:\d{2}"
_HEAD = r"^(\d{4})[:-](\d{2})[:-](\d{2})[T ]"


def taken_at(text: Column) -> Column:
    """Local wall-clock time of a text; null where it is in neither spelling or impossible."""
    iso = F.regexp_replace(F.substring(text, 1, 19), _HEAD, "$1-$2-$3 ")
    return F.when(text.rlike(_SHAPE), iso.try_cast("timestamp_ntz"))


def taken_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    iso = rf"regexp_replace(substr({text}, 1, 19), '{_HEAD}', '\1-\2-\3 ')"
    return f"CASE WHEN regexp_matches({text}, '{_SHAPE}') THEN TRY_CAST({iso} AS TIMESTAMP) END"


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock time, as if in UTC."""
    return F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), ts).cast("timestamp"))


def day_part(ts: Column) -> Column:
    """morning 5-11, afternoon 12-16, evening 17-20, night otherwise."""
    h = F.hour(ts)
    return F.when(h.between(5, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 20), "evening").when(h.isNotNull(), "night")
