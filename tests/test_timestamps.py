import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lumora.operators.timestamps import normalise_timestamps

UTC = dt.timezone.utc


def us(*a, tz=UTC, fold=0):
    t = dt.datetime(*a, tzinfo=tz, fold=fold).astimezone(UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)
    return (t.days * 86400 + t.seconds) * 1_000_000 + t.microseconds


B, NY = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
CASES = [
    ("2024:06:15 14:30:00", "Europe/Berlin", us(2024, 6, 15, 14, 30, tz=B)),
    ("2024-06-15T14:30:00.1234567Z", "Europe/Berlin", us(2024, 6, 15, 14, 30, 0, 123456)),
    ("2024-06-15t14:30:00z", None, us(2024, 6, 15, 14, 30)),
    (" \t2024/06/15 14:30:00\x00", None, us(2024, 6, 15, 14, 30)),
    ("03.04.2021 05:06", None, us(2021, 4, 3, 5, 6)),
    ("3/4/2021 5:06 PM", None, us(2021, 3, 4, 17, 6)),
    ("12/1/2021 12:06 AM", None, us(2021, 12, 1, 0, 6)),
    ("Wed, 25 May 2016 19:47:03 +0530", None, us(2016, 5, 25, 14, 17, 3)),
    ("Sep 22, 2021 9:42:51 am", "America/New_York", us(2021, 9, 22, 9, 42, 51, tz=NY)),
    ("2019-10-13T00:13:49-03:30", "Europe/Berlin", us(2019, 10, 13, 3, 43, 49)),
    ("2018-09-19T03:20:58+10:30[Australia/Lord_Howe]", None, us(2018, 9, 18, 16, 50, 58)),
    ("2018-03-03 10:00:00 America/New_York", "Europe/Berlin", us(2018, 3, 3, 10, tz=NY)),
    ("2018-02-01 00:37:40.092+02", None, us(2018, 1, 31, 22, 37, 40, 92000)),
    ("2014-03-19T08:27:03,2", None, us(2014, 3, 19, 8, 27, 3, 200000)),
    ("2021-03-28 02:30:00", "Europe/Berlin", us(2021, 3, 28, 1, 30)),
    ("2021-10-31 02:30:00", "Europe/Berlin", us(2021, 10, 31, 0, 30)),
    ("20140821T093524Z", "Europe/Berlin", us(2014, 8, 21, 9, 35, 24)),
    ("20151110113632", "Europe/Berlin", us(2015, 11, 10, 11, 36, 32, tz=B)),
    ("1520854922", "Europe/Berlin", 1520854922_000000),
    ("1636349202.13", None, 1636349202_130000),
    ("1403456756031", None, 1403456756031_000),
    ("1590707918357145", None, 1590707918357145),
    ("1954-11-17T00:46:16Z", None, us(1954, 11, 17, 0, 46, 16)),
    ("2019-07-10", "Europe/Berlin", us(2019, 7, 10, tz=B)),
]
BAD = ["", "   ", None, "N/A", "unknown", "0000:00:00 00:00:00", "2023:02:30 10:00:00", "2022:05:10 25:61:00", "2020:06", "2021:13:01 08:15:00",
       "31.04.2018 09:00", "13/32/2020 01:00 PM", "    :  :     :  :  ", "yesterday", "2020-01-01 10:00:00 Nowhere/Town", "2020-01-01 13:00 PM"]
CONV = {".": "dmy", "/": "mdy"}


def run(spark, rows, conv):
    df = spark.createDataFrame(rows, "k long, t string, z string, s string")
    return {r.k: r for r in normalise_timestamps(df, "t", F.col("z"), F.col("s"), conv).collect()}


def test_readable(spark):
    got = run(spark, [(i, t, z, "a") for i, (t, z, _) in enumerate(CASES)], CONV)
    for i, (t, _, want) in enumerate(CASES):
        assert got[i].utc_us == want, t


def test_unreadable(spark):
    got = run(spark, [(i, t, None, None) for i, t in enumerate(BAD)], CONV)
    assert len(got) == len(BAD)
    for i, t in enumerate(BAD):
        assert got[i].ts_status == "unreadable" and got[i].utc_us is None, t


def test_mixture_decides_and_marks_ambiguity(spark):
    rows = [(i, f"{20 + i % 8}-03-2021 10:00", None, "day first") for i in range(40)]
    rows += [(100 + i, f"03-{20 + i % 8}-2021 10:00", None, "month first") for i in range(40)]
    rows += [(200, "05-06-2021 10:00", None, "day first"), (201, "05-06-2021 10:00", None, "month first"), (202, "05-06-2021 10:00", None, "new"), (203, "05-05-2021 10:00", None, "new")]
    got = run(spark, rows, {})
    assert got[200].utc_us == us(2021, 6, 5, 10) and got[201].utc_us == us(2021, 5, 6, 10)
    assert got[202].ts_status == "ambiguous" and got[202].utc_us is None
    assert got[203].ts_status == "ok"


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "k long, t string, z string, s string")
    assert normalise_timestamps(df, "t", F.col("z"), F.col("s"), CONV).count() == 0
    df = spark.createDataFrame([(1, "2020-01-01", None, None, 5)], "k long, t string, z string, s string, mask int")
    r = normalise_timestamps(df, "t", F.col("z"), F.col("s"), CONV).first()
    assert r.mask == 5 and r.utc_us == us(2020, 1, 1)


@pytest.mark.parametrize("n", [3000])
def test_very_long_text(spark, n):
    assert run(spark, [(1, "9" * n, None, None), (2, " " * n + "2020-01-01" + " " * n, None, None)], CONV)[2].utc_us == us(2020, 1, 1)
