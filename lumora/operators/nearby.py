"""Points near other points, and the region that holds a point.

Positions become unit vectors in three dimensions, where a great-circle radius
is a chord and neither the date line nor the poles need special cases. Space is
cut by k-d splits fitted on a bounded sample of positions; every position goes
to its own leaf, and as a halo copy to each leaf within one radius of it. Each
task then queries local k-d trees for its leaves. Leaves that hold more rows
than expected, in regions the sample missed, are no hazard: the local tree goes
on splitting, and equal positions are merged before the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.registry import query
from lumora.session import cut
from lumora.tables import current_rows, table, usable_number

EARTH_RADIUS_M = 6_371_000.0


#: Keys of one position that a block holds when pairs of keys are formed.
PLACE_KEYS = 2000


def valid_position(lat: Column, lng: Column) -> Column:
    """Both numbers there, in range, and not both zero."""
    ok = usable_number(lat) & usable_number(lng) & lat.between(-90, 90) & lng.between(-180, 180)
    return F.coalesce(ok & ~((lat == 0) & (lng == 0)), F.lit(False))


def unit_vectors(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Unit vectors, n by 3, of positions in degrees."""
    a, o = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=1)


def chord(radius_m: float) -> float:
    """Chord on the unit sphere of a great-circle distance."""
    return 2 * math.sin(min(radius_m / EARTH_RADIUS_M, math.pi) / 2)


def fit_splits(sample: np.ndarray, leaf: int) -> list[tuple[int, float, int, int]]:
    """k-d splits (axis, value, left, right) over sampled vectors; a leaf is -(number + 1).

    A node of equal vectors is a leaf whatever its size.
    """
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def build(rows: np.ndarray) -> int:
        nonlocal leaves
        spread = np.ptp(sample[rows], axis=0) if len(rows) else np.zeros(3)
        axis = int(np.argmax(spread))
        if len(rows) <= leaf or spread[axis] <= 0:
            leaves += 1
            return -leaves
        v = float(np.median(sample[rows, axis]))
        below = sample[rows, axis] < v
        if not below.any():
            v = float(np.nextafter(v, 2))
            below = sample[rows, axis] < v
        here = len(nodes)
        nodes.append((0, 0.0, 0, 0))
        left, right = build(rows[below]), build(rows[~below])
        nodes[here] = (axis, v, left, right)
        return here

    build(np.arange(len(sample)))
    return nodes


def route(nodes: list[tuple[int, float, int, int]], x: np.ndarray, halo: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, leaf and whether it is the row's own leaf, for every leaf within ``halo`` of a row."""
    rows_out, leaf_out, own_out = [], [], []
    stack = [(0 if nodes else -1, np.arange(len(x)), np.ones(len(x), bool))]
    while stack:
        node, rows, own = stack.pop()
        if not len(rows):
            continue
        if node < 0:
            rows_out.append(rows)
            leaf_out.append(np.full(len(rows), -node - 1, np.int64))
            own_out.append(own)
            continue
        axis, v, left, right = nodes[node]
        d = x[rows, axis] - v
        lo, hi = d < halo, d >= -halo
        stack.append((left, rows[lo], own[lo] & (d[lo] < 0)))
        stack.append((right, rows[hi], own[hi] & (d[hi] >= 0)))
    empty = np.empty(0, np.int64)
    if not rows_out:
        return empty, empty, empty.astype(bool)
    return np.concatenate(rows_out), np.concatenate(leaf_out), np.concatenate(own_out)


def pairs_within(x: np.ndarray, y: np.ndarray | None, r: float, leaf: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most ``r`` apart, by a k-d descent: within ``x`` (i < j) or between ``x`` and ``y``."""
    stack = [(np.arange(len(x)), None if y is None else np.arange(len(y)))]
    other = x if y is None else y
    while stack:
        a, b = stack.pop()
        if len(a) == 0 or (b is not None and len(b) == 0):
            continue
        both = x[a] if b is None else np.concatenate([x[a], other[b]])
        spread = np.ptp(both, axis=0)
        axis = int(np.argmax(spread))
        if len(both) <= leaf or spread[axis] <= 2 * r:
            for s in range(0, len(a), 2048):
                p = a[s : s + 2048]
                q = a[s:] if b is None else b
                d2 = ((x[p][:, None, :] - other[q][None, :, :]) ** 2).sum(-1)
                i, j = np.nonzero(d2 <= r * r)
                i, j = p[i], q[j]
                if b is None:
                    keep = i < j
                    i, j = i[keep], j[keep]
                if len(i):
                    yield i, j
            continue
        v = float(np.median(both[:, axis]))
        if v <= both[:, axis].min():
            v = float((both[:, axis].min() + both[:, axis].max()) / 2)
        da = x[a, axis] - v
        if b is None:
            stack.append((a[da < 0], None))
            stack.append((a[da >= 0], None))
            stack.append((a[(da < 0) & (da >= -r)], a[(da >= 0) & (da <= r)]))
        else:
            db = other[b, axis] - v
            stack.append((a[da < 0], b[db <= r]))  # b right of the plane only within r of it
            stack.append((a[da >= 0], b[db >= -r]))


def _sample_positions(points: DataFrame, bound: int) -> np.ndarray:
    """At most ``bound`` positions, the same ones on every run, for fitting splits only."""
    rows = points.orderBy(F.xxhash64("_lat", "_lng")).limit(bound).select("_lat", "_lng").toPandas()
    return unit_vectors(rows["_lat"].to_numpy(), rows["_lng"].to_numpy())


def near_pairs(
    df: DataFrame, key: str, lat: str, lng: str, radius_m: float, leaf_rows: int = 4000, sample_bound: int = 20_000
) -> DataFrame:
    """Pairs (``a`` < ``b``) of keys whose positions are at most ``radius_m`` apart.

    ``df`` has one row per key; other columns are ignored, so clashing names do
    no harm. Rows with a null key or without a valid position take no part; an
    empty table gives no pairs. Equal positions are searched once and their keys
    joined back at the end, so a place photographed from one spot is one point.

    The split planes are fitted on at most ``sample_bound`` positions; every
    position is indexed. The distance is checked exactly along the great circle.
    """
    spark = df.sparkSession
    pts = df.filter(F.col(key).isNotNull() & valid_position(F.col(lat), F.col(lng))).select(
        F.col(key).alias("_key"),
        (F.col(lat).cast("double") + F.lit(0.0)).alias("_lat"),
        (F.col(lng).cast("double") + F.lit(0.0)).alias("_lng"),
    )
    # one read of the input; both halves below start from it
    pts = cut(pts)
    places = cut(pts.groupBy("_lat", "_lng").agg(F.min("_key").alias("_place"), F.count(F.lit(1)).alias("_n")))
    n_places = places.count()
    sample = _sample_positions(places, sample_bound)
    per_leaf = max(1, int(leaf_rows * len(sample) / max(n_places, 1)))
    nodes = fit_splits(sample, per_leaf)
    c = chord(radius_m) * (1 + 1e-9) + 1e-12
    n_leaves = len(nodes) + 1

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            la, lo = b["_lat"].to_numpy(), b["_lng"].to_numpy()
            rows, leaf, own = route(nodes, unit_vectors(la, lo), c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf), pa.array(own), b["_place"].take(pa.array(rows)), pa.array(la[rows]), pa.array(lo[rows])],
                names=["leaf", "own", "_place", "_lat", "_lng"],
            )

    key_type = dict(pts.dtypes)["_key"]
    copies = places.mapInArrow(to_leaves, f"leaf long, own boolean, _place {key_type}, _lat double, _lng double")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        leaf, own = t["leaf"].to_numpy(), t["own"].to_numpy()
        place = t["_place"].combine_chunks()
        la, lo = t["_lat"].to_numpy(), t["_lng"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        for rows in np.split(order, cuts):
            x = unit_vectors(la[rows], lo[rows])
            for i, j in pairs_within(x, None, c):
                i, j = rows[i], rows[j]
                # a pair belongs to the leaf that owns its smaller position
                first = (la[i] < la[j]) | ((la[i] == la[j]) & (lo[i] < lo[j]))
                keep = np.where(first, own[i], own[j])
                i, j = i[keep], j[keep]
                d = great_circle_m(la[i], lo[i], la[j], lo[j])
                ok = d <= radius_m
                if ok.any():
                    yield pa.RecordBatch.from_arrays(
                        [place.take(pa.array(i[ok])), place.take(pa.array(j[ok]))], names=["_pa", "_pb"]
                    )

    tasks = max(1, min(n_leaves, 4 * max(spark.sparkContext.defaultParallelism, n_leaves // 8)))
    place_pairs = copies.repartition(tasks, "leaf").mapInArrow(search, f"_pa {key_type}, _pb {key_type}")
    members = pts.join(places.select("_lat", "_lng", "_place", "_n"), ["_lat", "_lng"])
    # the keys of a crowded place go out in blocks, so that no task holds all of them
    blocks = F.ceil(F.col("_n") / PLACE_KEYS).cast("int")
    members = members.withColumn("_block", F.pmod(F.xxhash64("_key"), blocks).cast("int"))
    large = cut(places.filter(F.col("_n") > PLACE_KEYS).select("_place", blocks.alias("_blocks")))
    crowds = bool(large.head(1))

    def expand(pairs: DataFrame, place: str, name: str) -> DataFrame:
        """Pairs of places with the keys of one side in place of ``place``."""
        own = members.select(F.col("_key").alias(name), F.col("_place").alias(place), "_block")
        if not crowds:
            return pairs.join(own.drop("_block"), place).drop(place)
        sized = pairs.join(large.withColumnRenamed("_place", place), place, "left")
        every = sized.withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
        return every.join(own, [place, "_block"]).drop(place, "_block")

    ab = expand(expand(place_pairs, "_pa", "_a"), "_pb", "_b")
    # the keys of one place: each meets the blocks of all
    shared = members.filter("_n > 1")
    left = shared.select(F.col("_key").alias("_a"), "_place", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"))
    same = left.join(shared.select(F.col("_key").alias("_b"), "_place", "_block"), ["_place", "_block"]).filter("_a < _b")
    return ab.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).unionByName(
        same.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    )


def great_circle_m(la1: np.ndarray, lo1: np.ndarray, la2: np.ndarray, lo2: np.ndarray) -> np.ndarray:
    """Haversine distance in metres."""
    a1, a2 = np.radians(la1), np.radians(la2)
    s = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(np.radians(lo2 - lo1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(s, 0, 1)))


def sweep_regions(px: np.ndarray, py: np.ndarray, rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (point, ring) of the rings that hold each point, by a plane sweep.

    A sweep line runs along x over edge starts, edge ends and points. The edges
    it crosses are active; at a point, the rings with an odd number of active
    edges above it hold the point. A point on the lower or left border is inside.
    """
    ex1, ey1, ex2, ey2, owner = [], [], [], [], []
    for k, ring in enumerate(rings):
        r = np.asarray(ring, float)
        if len(r) < 3:
            continue
        nxt = np.roll(r, -1, axis=0)
        for (x1, y1), (x2, y2) in zip(r, nxt):
            if x1 == x2:
                continue
            if x1 > x2:
                x1, y1, x2, y2 = x2, y2, x1, y1
            ex1.append(x1), ey1.append(y1), ex2.append(x2), ey2.append(y2), owner.append(k)
    a, b, c, d = (np.array(v, float) for v in (ex1, ey1, ex2, ey2))
    own = np.array(owner, int)
    starts, order = np.argsort(a, kind="stable"), np.argsort(px, kind="stable")
    active = np.empty(0, int)
    points, regions, nxt_edge = [], [], 0
    i = 0
    while i < len(order):
        x = px[order[i]]
        j = i
        while j < len(order) and px[order[j]] == x:
            j += 1
        added = nxt_edge
        while added < len(starts) and a[starts[added]] <= x:
            added += 1
        active = np.concatenate([active, starts[nxt_edge:added]])
        nxt_edge = added
        active = active[c[active] > x]
        if len(active):
            at = b[active] + (d[active] - b[active]) * ((x - a[active]) / (c[active] - a[active]))
            here = order[i:j]
            above = at[None, :] > py[here][:, None]
            count = np.zeros((len(here), len(rings)), np.int64)
            for col, k in enumerate(own[active]):
                count[:, k] += above[:, col]
            p, r = np.nonzero(count % 2 == 1)
            points.append(here[p])
            regions.append(r)
        i = j
    if not points:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(points), np.concatenate(regions)


def containing_regions(
    df: DataFrame, key: str, lat: str, lng: str, regions: dict[str, list[tuple[float, float]]], max_edges: int = 200_000
) -> DataFrame:
    """(``key``, ``region``) for every region that holds a point.

    ``regions`` are polygons as (lat, lng) corners with edges straight in
    degrees; split them at the date line. They travel to every task, so their
    total number of corners may be at most ``max_edges``. Points without valid
    position or key give no row. Each batch is swept on its own.
    """
    if sum(len(r) for r in regions.values()) > max_edges:
        raise ValueError(f"the regions have more than {max_edges} corners")
    names = sorted(regions)
    rings = [np.array([(o, a) for a, o in regions[n]], float) for n in names]
    pts = df.filter(F.col(key).isNotNull() & valid_position(F.col(lat), F.col(lng))).select(
        F.col(key).alias("_key"), F.col(lat).cast("double").alias("_lat"), F.col(lng).cast("double").alias("_lng")
    )

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p, r = sweep_regions(b["_lng"].to_numpy(), b["_lat"].to_numpy(), rings)
            yield pd.DataFrame({"key": b["_key"].to_numpy()[p], "region": [names[k] for k in r]})

    return pts.mapInPandas(hold, f"key {dict(pts.dtypes)['_key']}, region string")


def current_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each image in its current metadata row."""
    return current_rows(table(spark, sf_dir, "analysis_metadata"), "image_id", ["gps_latitude", "gps_longitude"])


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of images at most 25 m apart."""
    pairs = near_pairs(current_positions(spark, sf_dir), "image_id", "gps_latitude", "gps_longitude", 25.0)
    return pairs.select(F.col("a").alias("image_id_a"), F.col("b").alias("image_id_b"))


#: Rectangles and a triangle in degrees, as examples of regions.
SAMPLE_REGIONS = {
    "north_west": [(0.0, -180.0), (0.0, 0.0), (90.0, 0.0), (90.0, -180.0)],
    "tropics": [(-23.5, -180.0), (-23.5, 180.0), (23.5, 180.0), (23.5, -180.0)],
    "wedge": [(60.0, -30.0), (60.0, 60.0), (10.0, 15.0)],
}


@query(
    "p6_regions",
    """
    WITH r AS (
      SELECT image_id, gps_latitude AS la, gps_longitude AS lo,
             row_number() OVER (PARTITION BY image_id ORDER BY analyzed_at DESC, gps_latitude DESC NULLS LAST, gps_longitude DESC NULLS LAST) AS rn
      FROM analysis_metadata),
    p AS (
      SELECT * FROM r WHERE rn = 1 AND la IS NOT NULL AND lo IS NOT NULL AND NOT isnan(la) AND NOT isnan(lo)
        AND la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AND NOT (la = 0 AND lo = 0)),
    h AS (
      SELECT image_id, 'north_west' AS region FROM p WHERE la >= 0 AND la < 90 AND lo < 0
      UNION ALL SELECT image_id, 'tropics' FROM p WHERE la >= -23.5 AND la < 23.5 AND lo < 180
      UNION ALL SELECT image_id, 'wedge' FROM p WHERE la < 60 AND lo >= -30 AND lo < 60
        AND la >= CASE WHEN lo < 15 THEN 60 - (lo + 30) * 50 / 45 ELSE 10 + (lo - 15) * 50 / 45 END)
    SELECT region, count(*) AS images FROM h GROUP BY region
    """,
)
def p6_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by the region that holds them."""
    held = containing_regions(current_positions(spark, sf_dir), "image_id", "gps_latitude", "gps_longitude", SAMPLE_REGIONS)
    return held.groupBy("region").agg(F.count(F.lit(1)).alias("images"))
