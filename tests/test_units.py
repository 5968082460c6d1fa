import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.functions.geo import geohash, zoom_precision
from lumora.operators import curation, fleet, geo, library, people, story
from lumora.plans.request import SearchRequest, has_cartesian
from lumora.sources import files
from lumora.tables import conform, current_rows, table_or_empty


def test_geohash_known(spark):
    df = spark.createDataFrame([(57.64911, 10.40744), (90.0, 180.0), (-90.0, -180.0)], "a double, o double")
    assert [r[0] for r in df.select(geohash(F.col("a"), F.col("o"), 8)).collect()] == ["u4pruydq", "zzzzzzzz", "00000000"]


def test_zoom_ladder():
    assert [zoom_precision(z) for z in (1, 5, 9, 13, 16, 18, 20)] == [1, 2, 3, 4, 5, 6, 7] and zoom_precision(20, 5) == 8


def test_rdp():
    assert geo.rdp([(0, 0), (1, 1), (2, 2), (3, 3)], 0.1) == [0, 3]
    assert len(geo.rdp([(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)], 0.5)) >= 3


def test_gap_fill(spark):
    rows = [(1, "a", "2024-01-01 10:00:00", True, 40.0, 10.0), (2, "a", "2024-01-01 10:15:00", False, None, None), (3, "a", "2024-01-01 10:30:00", True, 40.1, 10.1), (4, "a", "2024-01-02 10:00:00", False, None, None)]
    df = spark.createDataFrame(rows, "image_id long, g string, t string, has_position boolean, gps_latitude double, gps_longitude double").withColumn("taken", F.col("t").cast("timestamp_ntz")).drop("t")
    got = geo.gap_fill(df, ["g"], 60).collect()
    assert [r.image_id for r in got] == [2] and got[0].lat == pytest.approx(40.05) and got[0].confidence == pytest.approx(0.5)


def test_trip_and_stay(spark):
    go = [(i, "a", f"2024-01-01 {8 + 2 * i:02d}:00:00", 40.0 - i * 2, 116.0 + i) for i in range(5)]
    stay = [(10 + i, "b", f"2024-01-01 {8 + i:02d}:00:00", 40.0, 116.0) for i in range(5)]
    df = spark.createDataFrame(go + stay, "image_id long, g string, t string, lat double, lng double").withColumn("taken", F.col("t").cast("timestamp_ntz"))
    got = geo.trips(df.drop("t"), ["g"]).collect()
    assert [(r.g, r.images) for r in got] == [("a", 5)] and got[0].path > 100


def test_keyset_cursor():
    assert library.decode_cursor(library.encode_cursor("/a%_b", 7)) == ("/a%_b", 7)
    with pytest.raises(ValueError):
        library.decode_cursor("???")


def test_offset_page(spark):
    df = spark.range(10)
    assert library.offset_page(df.orderBy("id"), 5000, 10).count() == 0 and library.offset_page(df.orderBy("id"), 8, 10).count() == 2
    with pytest.raises(ValueError):
        library.offset_page(df, 0, 501)


def test_latest_wins_ties_nulls(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, None, "x"), (2, 1, "y"), (None, 1, "z")], "k long, v int, s string")
    assert {r.k: r.s for r in current_rows(df, "k", ["s"], "v").collect()} == {1: "b", 2: "y"}


def test_conform_and_missing_table(spark, tmp_path):
    schema = spark.range(1).select(F.col("id"), F.lit("x").alias("name")).schema
    assert conform(spark.range(2).withColumn("extra", F.lit(1)), schema).columns == ["id", "name"]
    assert table_or_empty(spark, str(tmp_path), "nothing", schema).count() == 0


def test_moment_boundaries(spark):
    rows = [(1, "2024-01-01 10:00:00", 1.0, 1.0), (2, "2024-01-01 10:30:00", 1.0, 1.0), (3, "2024-01-01 11:00:01", 1.0, 1.0), (4, "2024-01-01 11:00:02", 50.0, 1.0), (5, "2024-01-01 11:00:03", None, None), (6, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image_id long, t string, lat double, lng double").select(F.lit("a").alias("album"), "image_id", F.col("t").cast("timestamp_ntz").alias("taken"), "lat", "lng")
    assert {r.image_id: r.moment for r in story.moments(df).collect()} == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3, 6: 0}


def test_lease_expiry(spark):
    df = spark.createDataFrame([(1, "running", 0, "2024-01-01 00:00:00"), (2, "running", 3, "2024-01-01 00:00:00"), (3, "running", 0, "2024-01-01 00:59:00")], "job_id long, status string, attempts int, q string").withColumn("queued_at", F.col("q").cast("timestamp_ntz"))
    got = {r.job_id: (r.new_status, r.new_attempts) for r in fleet.expire_leases(df, F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"), 600, 3).collect()}
    assert got == {1: ("pending", 1), 2: ("failed", 3), 3: ("running", 0)}


def test_farthest_points():
    x = np.array([[1.0, 0], [0.9, 0.1], [0, 1.0], [-1.0, 0]])
    assert people.farthest_points(x, 3) == [0, 3, 2]


def test_request():
    r = SearchRequest.parse({"query": " a ", "must": ["X", "x", ""], "month_day": "13-40", "time_of_day": "noon"})
    assert r.query == "a" and r.must == ("x",) and r.month_day is None and r.time_of_day is None
    for bad in ({"mode": "?"}, {"limit": 0}, {"limit": 501}, {"offset": -1}, {"semantic_weight": 2}):
        with pytest.raises(ValueError):
            SearchRequest.parse(bad)


def test_no_cartesian(spark, small):
    assert not has_cartesian(library.wide_star(spark, small))


def test_sources(spark, tmp_path):
    for n in ("a.JPG", "b.png", "c.txt", "sub/d.cr2"):
        os.makedirs(tmp_path / "sub", exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    got = files.scan_folder(spark, str(tmp_path), content=True)
    assert got.count() == 3 and got.select("digest").distinct().count() == 3
    db = str(tmp_path / "faces.json")
    files.save_face_db([("Ann", [1.0, 2.0]), ("Ann", [3.0, 4.0])], db)
    assert sorted(r.embedding for r in files.load_face_db(spark, db).collect()) == [[1.0, 2.0], [3.0, 4.0]]


def test_writers(spark, tmp_path):
    x = files.xmp_sidecar({"description": "a<b", "keywords": ["k&l"], "lat": -1.5, "lng": 2.25})
    assert "a&lt;b" in x and "k&amp;l" in x and "1,30.000000S" in x and "2,15.000000E" in x
    page = files.story_page("<T>", [{"title": "c", "heroes": list(range(9))}])
    assert "&lt;T&gt;" in page and page.count("<li>") == 6
    files.write_results(spark.range(3), str(tmp_path / "o"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 3


def test_name_spans():
    assert curation.spans("photos of Anna Bell and Tom in rain", ["Anna", "Anna Bell", "Tom"]) == (["Anna Bell", "Tom"], "in rain")
    assert curation.spans("a tomato", ["Tom"]) == ([], "a tomato")


def test_query_terms():
    from lumora.operators import pipeline as p

    assert p.quoted_phrases("a \"Stone  bridge\" 'stone bridge' 'x' \"\"") == ["Stone bridge", "x"]
    assert p.safe_match('old* OR (near: "x-y")') == '"old" AND "or" AND "near" AND "x" AND "y"'
    c = p.channels_of('the old "stone bridge"')
    assert c["strict"] == [["the"], ["old"], ["stone"], ["bridge"]] and c["phrase"] == [["stone", "bridge"]]
    assert c["trigram"] == [["the", "old", "stone"], ["old", "stone", "bridge"]] and c["soft"] == [["stone"], ["bridge"]]
    assert list(p.channels_of("market")) == ["strict"] and p.channels_of(" - ") == {}
    r = SearchRequest.parse({"query": "b", "must": ["A"], "should": ["c"], "expanded": ["B", "d"], "faces": ["X", "X"]})
    assert r.terms() == ["a", "b", "c", "d"] and r.faces == ("X",)
    with pytest.raises(ValueError):
        SearchRequest.parse({"similar_to": "7"})


def test_search_pages_and_stored_index(spark, small, tmp_path):
    from lumora.operators import pipeline as p

    docs = p.store_index(spark, small, str(tmp_path / "index"))
    whole = p.search(spark, small, SearchRequest.parse({"query": "the picture", "mode": "text", "limit": 20}), docs=docs).collect()
    second = p.search(spark, small, SearchRequest.parse({"query": "the picture", "mode": "text", "limit": 10, "offset": 10}), docs=docs).collect()
    by = {r.position: r.image_id for r in whole}
    assert len(by) == len(whole) > 10 and all(by[r.position] == r.image_id for r in second) and min(r.position for r in second) == 11
    assert p.search(spark, small, SearchRequest.parse({"query": "zzzqqq", "mode": "text"}), docs=docs).count() == 0
    with pytest.raises(ValueError):
        p.search(spark, small, SearchRequest.parse({"mode": "browse", "ranges": {"nothing": (1, 2)}}), docs=docs)
