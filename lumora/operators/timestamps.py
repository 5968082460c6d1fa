"""Mixed timestamp spellings and zones, normalised to one UTC instant.

Every text gets the set of interpretations under which it is a real date
(:func:`read_candidates`). Where more than one holds, an expectation
maximisation over the mixture of formats of each source decides
(:func:`format_mixture`): a value spreads its weight over its valid parses in
proportion to how common each format is in its source, and the posterior picks
the parse or marks the value as ambiguous (:func:`normalise_timestamps`).

Scale: parsing is one Arrow-batched pass over the distinct texts of each batch
(as JVM expressions the same grammar exceeds what one generated method may
hold and ran slower by orders of magnitude). The mixture needs only the counts of (source, set of valid parses),
which partial aggregation reduces map-side, however many values one source has.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.registry import query
from lumora.session import cut
from lumora.tables import current_rows, table

#: Interpretations, by bit. Only the first four can hold together.
FORMATS = ("ymd", "dmy", "mdy", "named_month", "compact", "epoch")
_ZONE = (
    r"\s*([Zz]|(?:UTC|GMT|UT)?[+-]\d{1,2}(?::?\d{2}(?::?\d{2})?)?|[A-Za-z]{2,5}(?![A-Za-z0-9_/+-]))?"
    r"\s*(?:\[?([A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)*)\]?)?"
)
_TIME = r"(?:(?:[Tt]|\s+|,\s*)(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?)?"
_TAIL = _TIME + _ZONE + r"$"
_NUMERIC = re.compile(r"^(\d{1,4})([:./-])(\d{1,2})\2(\d{1,4})" + _TAIL, re.ASCII)
_COMPACT = re.compile(
    r"^(\d{4})(\d{2})(\d{2})(?:[Tt ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?|(\d{2})(\d{2})(\d{2}))?" + _ZONE + r"$", re.ASCII
)
_NAMED = re.compile(
    r"^(?:[A-Za-z]{3,9},?\s+)?"
    r"(?:(\d{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})|([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}))"
    + _TAIL,
    re.ASCII,
)
_EPOCH = re.compile(r"^(\d{10}|\d{13}|\d{16})(?:\.(\d+))?$", re.ASCII)
_SIGNED = re.compile(r"([+-])(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?$", re.ASCII)
_EDGE = re.compile(r"^[\s\x00-\x1f\x7f-\x9f\ufeff\u200b]+|[\s\x00-\x1f\x7f-\x9f\ufeff\u200b]+$")
_UTC_WORDS = ("Z", "UTC", "GMT", "UT")
#: English month names by their first three letters.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_DAY_US = 86_400_000_000
_EPOCH_DAY = datetime.date(1970, 1, 1).toordinal()


def _midnight_us(y: str, m: str | int, d: str) -> int | None:
    try:
        return (datetime.date(int(y), int(m), int(d)).toordinal() - _EPOCH_DAY) * _DAY_US
    except ValueError:
        return None


def _clock_us(h: str | None, mi: str | None, s: str | None, frac: str | None, half: str | None) -> int | None:
    """Microseconds since midnight; null where the time is impossible; missing parts are zero."""
    hh, mm, ss = int(h or 0), int(mi or 0), int(s or 0)
    if half:
        if not 1 <= hh <= 12:
            return None
        hh = hh % 12 + (12 if half in "pP" else 0)
    if hh > 23 or mm > 59 or ss > 59:
        return None
    return ((hh * 60 + mm) * 60 + ss) * 1_000_000 + int((frac or "")[:6].ljust(6, "0"))


def _offset_and_zone(off: str | None, zone: str | None, known: frozenset[str]) -> tuple[int | None, str | None] | None:
    """Offset in microseconds and zone name of a text's end; None if it names an unknown zone."""
    off, zone = off or "", zone or None
    if off.upper() in _UTC_WORDS:
        return 0, None
    m = _SIGNED.search(off)
    if m:
        h, mi, s = (int(x or 0) for x in m.groups()[1:])
        if h > 18 or mi > 59 or s > 59:
            return None
        us = ((h * 60 + mi) * 60 + s) * 1_000_000
        return (-us if m[1] == "-" else us), None
    name = off or zone
    if name is None:
        return None, None
    if name.upper() in _UTC_WORDS:
        return 0, None
    for n in (name, name.upper()):
        if n in known:
            return None, n
    return None


def parse_text(text: str | None, conv: Mapping[str, str], known: frozenset[str]) -> tuple[int, list, int | None, str | None]:
    """Mask, values by format, offset and zone of one text; mask 0 if it is unreadable."""
    at: list[int | None] = [None] * len(FORMATS)
    nothing = (0, at, None, None)
    t = _EDGE.sub("", text) if text else ""
    if not t:
        return nothing
    e = _EPOCH.match(t)
    if e:
        digits, frac = e.groups()
        if len(digits) == 10:
            at[5] = int(digits) * 1_000_000 + int((frac or "")[:6].ljust(6, "0"))
        elif frac is None:
            at[5] = int(digits) * (1000 if len(digits) == 13 else 1)
        return (32 if at[5] is not None else 0), at, 0, None
    n = _NUMERIC.match(t)
    if n:
        first, sep, mid, last, *tail = n.groups()
        if len(first) == 4 and len(last) <= 2:
            at[0] = _midnight_us(first, mid, last)
        elif len(last) == 4 and len(first) <= 2:
            if conv.get(sep, "dmy") == "dmy":
                at[1] = _midnight_us(last, mid, first)
            if conv.get(sep, "mdy") == "mdy":
                at[2] = _midnight_us(last, first, mid)
    elif w := _NAMED.match(t):
        d1, m1, y1, m2, d2, y2, *tail = w.groups()
        month = _MONTHS.index(x) + 1 if (x := (m1 or m2)[:3].lower()) in _MONTHS else 0
        at[3] = _midnight_us(y1 or y2, month, d1 or d2)
    elif c := _COMPACT.match(t):
        y, m, d, h1, mi1, s1, frac, h2, mi2, s2, off, zone = c.groups()
        at[4] = _midnight_us(y, m, d)
        tail = [h1 or h2, mi1 or mi2, s1 or s2, frac, None, off, zone]
    else:
        return nothing
    clock = _clock_us(*tail[:5])
    ends = _offset_and_zone(tail[5], tail[6], known)
    if clock is None or ends is None:
        return 0, [None] * len(FORMATS), None, None
    at = [None if x is None else x + clock for x in at]
    mask = sum(1 << i for i, x in enumerate(at) if x is not None)
    return mask, at, *ends


def zone_ids(spark: SparkSession) -> list[str]:
    """Zone names that the JVM knows (a fixed list of some 600)."""
    try:
        found = spark._jvm.java.time.ZoneId.getAvailableZoneIds()  # noqa: SLF001
        return sorted(str(z) for z in found)
    except AttributeError:  # a client without a JVM
        import zoneinfo

        return sorted(zoneinfo.available_timezones())


def read_candidates(df: DataFrame, text: str, conventions: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with ``_ts``: the valid interpretations of column ``text``.

    ``conventions`` maps a separator to ``dmy`` or ``mdy`` and rules the other
    order out. The added struct has ``mask`` (bits of :data:`FORMATS`, 0 if
    unreadable), one local or absolute microsecond value per interpretation
    (``at``), ``offset_us`` (null without an offset) and ``zone`` (null without
    a zone name).

    Null, blank, partial (no day), placeholder (month or day zero) and
    impossible texts have mask 0. Control characters and blanks around the
    text are ignored. An impossible time makes the whole text unreadable.
    """
    known = frozenset(zone_ids(df.sparkSession))
    conv = dict(conventions or {})

    @F.pandas_udf("mask int, at array<long>, offset_us long, zone string")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            codes, distinct = pd.factorize(batch, use_na_sentinel=False)
            rows = [parse_text(None if x is None or x != x else x, conv, known) for x in distinct]
            own = pd.DataFrame(rows, columns=["mask", "at", "offset_us", "zone"])
            own["offset_us"] = own["offset_us"].astype("Int64")
            yield own.take(codes).reset_index(drop=True)

    return df.withColumn("_ts", read(F.col(text)))


def format_mixture(counts: DataFrame, iterations: int = 40, pseudo: float = 1.0) -> DataFrame:
    """EM over the format mixture of each source.

    ``counts`` has ``source``, ``mask`` and ``n``. Returns ``source`` and
    ``weights``, one share per entry of :data:`FORMATS`, each smoothed by
    ``pseudo`` values. A source sees at most one row per mask, so the arrays
    are bounded whatever the number of values.
    """
    k = len(FORMATS)

    @F.pandas_udf("array<double>")
    def fit(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            out = []
            for r in s:
                masks = np.array([x["mask"] for x in r], dtype=np.int64)
                n = np.array([x["n"] for x in r], dtype=float)
                valid = (masks[:, None] >> np.arange(k)) & 1
                pi = np.full(k, 1.0 / k)
                for _ in range(iterations):
                    p = valid * pi
                    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
                    m = (p * n[:, None]).sum(0) + pseudo / k
                    pi = m / m.sum()
                out.append(pi.tolist())
            yield pd.Series(out)

    per = counts.groupBy("source").agg(F.collect_list(F.struct("mask", "n")).alias("r"))
    return per.select("source", fit("r").alias("weights"))


def normalise_timestamps(
    df: DataFrame,
    text: str,
    local_zone: Column,
    source: Column,
    conventions: Mapping[str, str] | None = None,
    certain: float = 0.9,
) -> DataFrame:
    """``df`` with ``utc_us``, ``ts_format``, ``ts_posterior`` and ``ts_status``.

    ``ts_status`` is ``ok``, ``ambiguous`` (no interpretation reaches the
    posterior ``certain``; ``utc_us`` is null) or ``unreadable``. Interpretations
    that give the same instant (05.05.2020) are no ambiguity. A text without
    zone is local time in ``local_zone`` (null: UTC); a local time that occurs
    twice is the earlier instant, a skipped one moves on by the gap. A null
    ``source`` is a source of its own.
    """
    k = len(FORMATS)
    d = cut(read_candidates(df, text, conventions))  # read once: counts and results both start from it
    d = d.withColumn("_src", F.coalesce(source.cast("string"), F.lit("")))
    unclear = F.size(F.array_distinct(F.filter(F.col("_ts.at"), lambda x: x.isNotNull()))) > 1
    # the mixture matters only to values with more than one reading
    d = d.withColumn("_unclear", unclear & (F.col("_ts.mask") > 0))
    counts = (
        d.filter(F.col("_ts.mask") > 0)
        .groupBy(F.col("_src").alias("source"), F.col("_ts.mask").alias("mask"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    mixture = format_mixture(counts).withColumnRenamed("source", "_src")
    d = d.join(mixture, "_src", "left")
    bits = F.array(*[F.col("_ts.mask").bitwiseAND(1 << i) > 0 for i in range(k)])
    like = F.zip_with(bits, F.coalesce(F.col("weights"), F.array(*[F.lit(1.0 / k)] * k)), lambda b, p: F.when(b, p).otherwise(0.0))
    d = d.withColumn("_like", like)
    total = F.aggregate("_like", F.lit(0.0), lambda s, x: s + x)
    best = F.array_position(F.col("_like"), F.array_max("_like")).cast("int")
    d = d.withColumn("_best", best).withColumn("_post", F.when(total > 0, F.array_max("_like") / total))
    d = d.withColumn("_post", F.when(~F.col("_unclear") & (F.col("_ts.mask") > 0), 1.0).otherwise(F.col("_post")))
    readable = F.col("_ts.mask") > 0
    sure = readable & (F.col("_post") >= certain)
    at = F.when(sure, F.element_at(F.col("_ts.at"), F.col("_best")))
    fmt = F.when(sure, F.element_at(F.array(*[F.lit(f) for f in FORMATS]), F.col("_best")))
    zone = F.coalesce(F.col("_ts.zone"), local_zone, F.lit("UTC"))
    shifted = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(at), zone))
    utc = F.when(fmt == "epoch", at).when(F.col("_ts.offset_us").isNotNull(), at - F.col("_ts.offset_us")).otherwise(shifted)
    return (
        d.withColumn("utc_us", utc)
        .withColumn("ts_format", fmt)
        .withColumn("ts_posterior", F.col("_post"))
        .withColumn("ts_status", F.when(sure, "ok").when(readable, "ambiguous").otherwise("unreadable"))
        .drop("_ts", "_src", "_unclear", "weights", "_like", "_best", "_post")
    )


def library_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All current metadata rows of a library with their normalised instants."""
    meta = current_rows(
        table(spark, sf_dir, "analysis_metadata"), "image_id", ["date_time_original", "location_city", "camera_make"]
    )
    zones = (
        table(spark, sf_dir, "place_zones")
        .groupBy("location_city")
        .agg(F.min("zone_id").alias("zone_id"))
    )
    return normalise_timestamps(
        meta.join(zones, "location_city", "left"),
        "date_time_original",
        F.col("zone_id"),
        F.col("camera_make"),
        conventions={".": "dmy", "/": "mdy"},
    )


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose current date text is readable, with its instant in UTC.

    Null, blank, partial, placeholder and impossible texts give no row; repeated
    and outdated rows of an image count once, by the latest analysis.
    """
    return library_timestamps(spark, sf_dir).filter(F.col("ts_status") == "ok").select("image_id", "utc_us")


@query("p3_status")
def p3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by outcome and format: what was read, what stayed ambiguous."""
    return (
        library_timestamps(spark, sf_dir)
        .groupBy("ts_status", "ts_format")
        .agg(F.count(F.lit(1)).alias("images"))
    )
