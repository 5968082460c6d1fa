import numpy as np
import pytest

from lumora.operators import nearby as nb


def brute(rows, r):
    ok = [(k, a, o) for k, a, o in rows if k is not None and a is not None and o is not None and abs(a) <= 90 and abs(o) <= 180 and not (a == 0 and o == 0)]
    out = set()
    for i, x in enumerate(ok):
        for y in ok[i + 1 :]:
            d = nb.great_circle_m(*(np.array([v]) for v in (x[1], x[2], y[1], y[2])))[0]
            if d <= r:
                out.add((min(x[0], y[0]), max(x[0], y[0])))
    return out


@pytest.mark.parametrize("leaf, keys", [(5, 2000), (4000, 7)])
def test_pairs_against_brute_force(spark, monkeypatch, leaf, keys):
    monkeypatch.setattr(nb, "PLACE_KEYS", keys)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        c = [(51.0, 8.9), (0.00001, 179.9999), (0.0, -179.9999), (89.99995, 10.0), (-40.0, 3.0)][i % 5]
        rows.append((i, float(np.clip(c[0] + rng.normal(0, 0.0002), -90, 90)), float(np.clip(c[1] + rng.normal(0, 0.0002), -180, 180))))
    rows += [(300 + i, 10.0, 20.0) for i in range(40)]  # one hot spot
    rows += [(400, 89.99999, -170.0), (401, 0.0, 0.0), (402, None, 3.0), (403, 95.0, 3.0), (None, 10.0, 20.0), (405, float("nan"), 1.0)]
    want = brute([r for r in rows if r[1] is None or r[1] == r[1]], 25.0)
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, lat double, lng double, leaf string")
    got = [(r.a, r.b) for r in nb.near_pairs(df, "id", "lat", "lng", 25.0, leaf_rows=leaf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    df = spark.createDataFrame([], "id long, lat double, lng double")
    assert nb.near_pairs(df, "id", "lat", "lng", 25.0).count() == 0


def inside(x, y, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def test_sweep_against_ray_casting():
    rng = np.random.default_rng(1)
    rings = [[(float(np.cos(t) * r), float(np.sin(t) * r)) for t, r in zip(np.linspace(0, 6.2, 9), rng.uniform(0.3, 1, 9))] for _ in range(4)]
    p = rng.uniform(-1, 1, (400, 2))
    i, k = nb.sweep_regions(p[:, 0], p[:, 1], [np.array(r) for r in rings])
    want = {(a, b) for a in range(400) for b in range(4) if inside(p[a, 0], p[a, 1], rings[b])}
    assert set(zip(i.tolist(), k.tolist())) == want


def test_region_limit(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0)], "id long, lat double, lng double")
    with pytest.raises(ValueError):
        nb.containing_regions(df, "id", "lat", "lng", {"a": [(0.0, 0.0)] * 10}, max_edges=5)
