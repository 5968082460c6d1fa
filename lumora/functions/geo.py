"""Geographic column functions: geohash, haversine, zoom ladders, bounding boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_KM = 6371.0


def geohash(lat: Column, lng: Column, precision: int = 8) -> Column:
    """Geohash of a position, by interleaving the bits of both scaled numbers; null for nulls."""
    bits = 5 * precision
    n_lng, n_lat = (bits + 1) // 2, bits // 2

    def scaled(v: Column, low: float, span: float, n: int) -> Column:
        return F.least(F.greatest(F.floor((v - low) / span * float(1 << n)), F.lit(0)), F.lit((1 << n) - 1)).cast("long")

    x, y = scaled(lng, -180.0, 360.0, n_lng), scaled(lat, -90.0, 180.0, n_lat)
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for k in range(5):
            j = 5 * c + k
            src, at = (x, n_lng - 1 - j // 2) if j % 2 == 0 else (y, n_lat - 1 - j // 2)
            value = value + F.shiftleft(F.shiftright(src, at).bitwiseAND(1), 4 - k)
        chars.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash_sql(lat: str, lng: str, precision: int = 8) -> str:
    """The same as DuckDB SQL, for the twins."""
    bits = 5 * precision
    n_lng, n_lat = (bits + 1) // 2, bits // 2
    x = f"least(greatest(CAST(floor(({lng} + 180.0::DOUBLE) / 360.0::DOUBLE * {1 << n_lng}) AS BIGINT), 0), {(1 << n_lng) - 1})"
    y = f"least(greatest(CAST(floor(({lat} + 90.0::DOUBLE) / 180.0::DOUBLE * {1 << n_lat}) AS BIGINT), 0), {(1 << n_lat) - 1})"
    out = []
    for c in range(precision):
        parts = []
        for k in range(5):
            j = 5 * c + k
            src, at = (x, n_lng - 1 - j // 2) if j % 2 == 0 else (y, n_lat - 1 - j // 2)
            parts.append(f"((({src}) >> {at}) & 1) * {1 << (4 - k)}")
        out.append(f"substr('{BASE32}', CAST({' + '.join(parts)} + 1 AS INTEGER), 1)")
    return " || ".join(out)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """The same as DuckDB SQL."""
    a = (
        f"(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin(radians({lng2} - {lng1}) / 2), 2))"
    )
    return f"(2 * 6371.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


def zoom_precision(zoom: int, detail: int = 0) -> int:
    """Geohash length of a map zoom level, finer by ``detail``, between 1 and 8."""
    for top, p in ((2, 1), (5, 2), (9, 3), (13, 4), (16, 5), (18, 6)):
        if zoom <= top:
            return max(1, min(8, p + detail))
    return max(1, min(8, 7 + detail))


def radius_box(lat: float, lng: float, radius_km: float) -> tuple[float, float, float, float]:
    """South, north, west and east of the box around a circle."""
    dlat = radius_km / 111.0
    dlng = radius_km / (111.0 * max(abs(math.cos(math.radians(lat))), 0.01))
    return lat - dlat, lat + dlat, lng - dlng, lng + dlng
