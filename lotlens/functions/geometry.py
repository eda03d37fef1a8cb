"""Planar geometry on rings of [lon, lat], as higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres a degree.
LON_METRES, LAT_METRES = 111320.0, 110540.0


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres, on a plane at the middle latitude."""
    kx = LON_METRES * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot((lon2 - lon1) * kx, (lat2 - lat1) * LAT_METRES)


def segment_distance(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    kx = LON_METRES * F.cos(F.radians(lat))
    dx, dy = (b[0] - a[0]) * kx, (b[1] - a[1]) * LAT_METRES
    ux, uy = (lon - a[0]) * kx, (lat - a[1]) * LAT_METRES
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(ux * dx + uy * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(ux - t * dx, uy - t * dy)


def _edges(ring: Column) -> Column:
    """Pairs of a ring's or line's neighbours."""
    return F.when(F.size(ring) > 1, F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.expr("array()"))


def line_distance(lat: Column, lon: Column, line: Column) -> Column:
    return F.array_min(F.transform(_edges(line), lambda e: segment_distance(lat, lon, e["a"], e["b"])))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule. The ring is closed: its last point is its first."""

    def crosses(e: Column) -> Column:
        (xa, ya), (xb, yb) = (e["a"][0], e["a"][1]), (e["b"][0], e["b"][1])
        return ((ya > lat) != (yb > lat)) & (lon < F.coalesce(F.try_divide((xb - xa) * (lat - ya), yb - ya), F.lit(0.0)) + xa)

    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def in_polygon(lat: Column, lon: Column, rings: Column) -> Column:
    """In the first ring, and in none of the others, its holes."""
    return in_ring(lat, lon, rings[0]) & ~F.exists(F.slice(rings, F.lit(2), F.size(rings)), lambda r: in_ring(lat, lon, r))


def centroid(ring: Column) -> Column:
    """struct(lon, lat), weighted by area; the mean of its points where the ring has no area."""

    def add(acc: Column, e: Column) -> Column:
        f = e["a"][0] * e["b"][1] - e["b"][0] * e["a"][1]
        return F.struct((acc["s"] + f).alias("s"), (acc["x"] + (e["a"][0] + e["b"][0]) * f).alias("x"), (acc["y"] + (e["a"][1] + e["b"][1]) * f).alias("y"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = F.aggregate(_edges(ring), zero, add)
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[i]) / F.size(ring)
    flat = F.abs(sums["s"]) < 1e-18
    return F.when(
        F.size(ring) >= 3,
        F.struct(
            F.when(flat, mean(0)).otherwise(F.try_divide(sums["x"], 3 * sums["s"])).alias("lon"),
            F.when(flat, mean(1)).otherwise(F.try_divide(sums["y"], 3 * sums["s"])).alias("lat"),
        ),
    )


def bounds(points: Column) -> Column:
    """struct(minx, miny, maxx, maxy) of [lon, lat] points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def cell(coordinate: Column, size: float) -> Column:
    return F.floor(coordinate / size).cast("long")
