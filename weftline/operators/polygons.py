"""Polygons over longitude and latitude in degrees.

A polygon is an array of rings, a ring an array of points struct(lon, lat) that is closed by itself; what lies inside an
odd number of rings is inside. Rings are plane in degrees, so one that crosses the date line is to be cut there first.
Everything but ``intersection`` and ``generalize`` is made of built-in expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import ordered as O
from weftline.operators.spatial import EARTH_KM, haversine
from weftline.session import ship

RING = "array<struct<lon: double, lat: double>>"
POLYGON = f"array<{RING}>"
#: Levels of cells: the widest has the width of the earth, each other half of the one above.
LEVELS = 24


def _next(ring: Column) -> Column:
    """Pairs of neighbouring points, the last one with the first."""
    return F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("b"))


def _edges(polygon: Column) -> Column:
    return F.flatten(F.transform(polygon, _next))


def _total(items: Column, value) -> Column:  # noqa: ANN001
    return F.aggregate(items, F.lit(0.0), lambda total, x: total + value(x))


def circle(point: Column, km: Column, corners: int = 36) -> Column:
    """A ring of so many points at a distance from a point, counter-clockwise from the north."""
    lat, lon, r = F.radians(point["lat"]), F.radians(point["lon"]), km / EARTH_KM

    def corner(i: Column) -> Column:
        turn = -2 * math.pi * i / corners
        to_lat = F.asin(F.sin(lat) * F.cos(r) + F.cos(lat) * F.sin(r) * F.cos(turn))
        to_lon = lon + F.atan2(F.sin(turn) * F.sin(r) * F.cos(lat), F.cos(r) - F.sin(lat) * F.sin(to_lat))
        return F.struct(F.degrees(to_lon).alias("lon"), F.degrees(to_lat).alias("lat"))

    return F.when(point.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), corner))


def buffer(df: DataFrame, point: str, km: float, out: str = "Buffer", corners: int = 36) -> DataFrame:
    """The surroundings of a point as a polygon; null for a null."""
    ring = circle(C.name(point), F.lit(float(km)), corners)
    return df.withColumn(out, F.when(ring.isNotNull(), F.array(ring)))


def trade_area(df: DataFrame, point: str, radii: Sequence[float], out: str = "TradeArea", corners: int = 36) -> DataFrame:
    """A row for each radius, with the area between the next smaller radius, or the point, and it."""
    steps = sorted(set(map(float, radii)))
    areas = []
    for inner, outer in zip([None, *steps], steps, strict=False):
        rings = [circle(C.name(point), F.lit(r), corners) for r in (outer, inner) if r]
        areas.append(F.struct(F.lit(outer).alias("Radius"), F.array(*rings).alias(out)))
    made = df.withColumn("__a", F.explode(F.array(*areas)))
    return made.select(*[C.name(c) for c in df.columns], "__a.Radius", F.when(C.name(point).isNotNull(), F.col(f"__a.{out}")).alias(out))


def poly_build(df: DataFrame, point: str, group: Sequence[str], order: O.Order, out: str = "Polygon") -> DataFrame:
    """A polygon of one ring for every group, of its points in their order; null points are left out. Fewer than three make none."""
    rows = df.where(C.name(point).isNotNull()).withColumn("__at", F.monotonically_increasing_id())
    by = O.sort_key(rows, order, F.col("__at"))
    ring = F.transform(F.sort_array(F.collect_list(F.struct(by.alias("by"), C.name(point).alias("p")))), lambda x: x["p"])
    made = rows.groupBy(*[C.name(g) for g in group]).agg(ring.alias("__ring"))
    return made.select(*[C.name(g) for g in group], F.when(F.size("__ring") > 2, F.array("__ring")).alias(out))


def poly_split(df: DataFrame, polygon: str, out: str = "Point") -> DataFrame:
    """A row for every point, with the numbers of its ring and of itself from 1."""
    rings = df.select("*", F.posexplode(C.name(polygon)).alias("__i", "__ring"))
    points = rings.select(*[C.name(c) for c in df.columns if c != polygon], (F.col("__i") + 1).alias("Ring"), F.posexplode("__ring").alias("__j", out))
    return points.select(*[C.name(c) for c in points.columns if c not in ("__j", out)], (F.col("__j") + 1).alias("Place"), C.name(out))


def area(polygon: Column) -> Column:
    """Square kilometres on the sphere: the first ring less the others."""
    part = lambda e: F.radians(e["b"]["lon"] - e["a"]["lon"]) * (2 + F.sin(F.radians(e["a"]["lat"])) + F.sin(F.radians(e["b"]["lat"])))
    rings = F.transform(polygon, lambda ring: F.abs(_total(_next(ring), part)) * (EARTH_KM**2 / 2))
    return F.aggregate(rings, F.lit(0.0), lambda total, x: total - x) + 2 * rings[0]


def perimeter(polygon: Column) -> Column:
    return _total(_edges(polygon), lambda e: haversine(e["a"], e["b"]))


def spatial_info(df: DataFrame, polygon: str) -> DataFrame:
    """Add area, perimeter, bounds, the centroid of the first ring in the plane, and numbers of rings and points."""
    p = C.name(polygon)
    lon, lat = F.flatten(p)["lon"], F.flatten(p)["lat"]
    cross = lambda e: e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]
    first = _next(p[0])
    twice = _total(first, cross)
    centre = lambda k: _total(first, lambda e: (e["a"][k] + e["b"][k]) * cross(e)) / (3 * twice)
    return df.withColumns({
        "AreaKm2": area(p), "PerimeterKm": perimeter(p), "MinLon": F.array_min(lon), "MinLat": F.array_min(lat), "MaxLon": F.array_max(lon), "MaxLat": F.array_max(lat),
        "Center": F.when(twice != 0, F.struct(centre("lon").alias("lon"), centre("lat").alias("lat"))), "Rings": F.size(p), "Points": F.size(F.flatten(p)),
    })


def inside(point: Column, polygon: Column) -> Column:
    """Whether a ray to the east crosses an odd number of edges."""
    x, y = point["lon"], point["lat"]

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["lat"] > y) != (b["lat"] > y)) & (x < (b["lon"] - a["lon"]) * (y - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

    return F.size(F.filter(_edges(polygon), crosses)) % 2 == 1


def spatial_match(targets: DataFrame, universe: DataFrame, point: str, polygon: str) -> dict[str, DataFrame]:
    """``Matched``: every target point with every polygon that it lies in; ``Unmatched``: targets in none.

    A polygon has the cells of one level that its bounds touch, at most four, as the cells of its level are no smaller than it.
    Points meet polygons by the cells of the levels that occur, so rows do not grow with the size of the polygons. Names
    that clash get ``_right``."""
    p, g = C.name(point), C.name(polygon)
    lon, lat = F.flatten(g)["lon"], F.flatten(g)["lat"]
    names = {c: c + "_right" if c in targets.columns else c for c in universe.columns}
    boxes = universe.where(g.isNotNull() & (F.size(F.flatten(g)) > 2)).withColumns({"__x0": F.array_min(lon), "__x1": F.array_max(lon), "__y0": F.array_min(lat), "__y1": F.array_max(lat)})
    size = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"), F.lit(360.0 / 2**LEVELS))
    boxes = boxes.withColumn("__level", F.greatest(F.lit(0), F.floor(F.log2(F.lit(360.0) / size) - 1e-9)).cast("int"))
    width = F.lit(360.0) / F.pow(F.lit(2.0), F.col("__level"))
    at = lambda c: F.floor(c / width)
    boxes = boxes.withColumn("__cx", F.explode(F.sequence(at(F.col("__x0")), at(F.col("__x1"))))).withColumn("__cy", F.explode(F.sequence(at(F.col("__y0")), at(F.col("__y1")))))
    boxes = boxes.select("__level", "__cx", "__cy", "__x0", "__x1", "__y0", "__y1", *[C.name(c).alias(n) for c, n in names.items()])
    levels = sorted(r[0] for r in boxes.select("__level").distinct().collect())  # at most LEVELS + 1
    points = targets.where(p.isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    points = points.withColumn("__cx", at(p["lon"])).withColumn("__cy", at(p["lat"]))
    within = p["lon"].between(F.col("__x0"), F.col("__x1")) & p["lat"].between(F.col("__y0"), F.col("__y1"))
    found = points.join(boxes, ["__level", "__cx", "__cy"]).where(within).where(inside(p, C.name(names[polygon])))
    matched = found.select(*[C.name(c) for c in targets.columns], *[C.name(n) for n in names.values()])
    # whether a target lies in any is up to its point alone
    places = found.select(p.alias("__p")).distinct()
    lost = targets.join(places, p == F.col("__p"), "left_anti")
    return {"Matched": matched, "Unmatched": lost}


def smooth(df: DataFrame, polygon: str, rounds: int = 2) -> DataFrame:
    """Every corner cut off at a quarter of its edges, so many times."""
    between = lambda e, t: F.struct(*[(e["a"][k] * (1 - t) + e["b"][k] * t).alias(k) for k in ("lon", "lat")])
    c = C.name(polygon)
    for _ in range(rounds):
        c = F.transform(c, lambda ring: F.flatten(F.transform(_next(ring), lambda e: F.array(between(e, 0.25), between(e, 0.75)))))
    return df.withColumn(polygon, c)


def _simpler(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Points farther than ``tolerance`` from the lines between the kept ones (Douglas and Peucker), in a closed ring."""
    n = len(ring)
    if n < 4:
        return ring
    far = max(range(n), key=lambda i: math.dist(ring[i], ring[0]))
    closed, kept, stack = [*ring, ring[0]], {0, far}, [(0, far), (far, n)]
    while stack:
        a, b = stack.pop()
        (x0, y0), (x1, y1) = closed[a], closed[b]
        length = math.hypot(x1 - x0, y1 - y0)
        worst, at = tolerance, -1
        for i in range(a + 1, b):
            x, y = closed[i]
            d = abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / length if length else math.hypot(x - x0, y - y0)
            if d > worst:
                worst, at = d, i
        if at >= 0:
            kept.add(at)
            stack += [(a, at), (at, b)]
    return [ring[i] for i in sorted(kept)] if len(kept) > 2 else ring


def _clipped(ring: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a ring within a convex one (Sutherland and Hodgman)."""
    turn = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(clip, [*clip[1:], clip[0]], strict=True))
    clip = clip if turn > 0 else clip[::-1]
    for (cx, cy), (dx, dy) in zip(clip, [*clip[1:], clip[0]], strict=True):
        side = lambda p, cx=cx, cy=cy, dx=dx, dy=dy: (dx - cx) * (p[1] - cy) - (dy - cy) * (p[0] - cx)
        out = []
        for p, q in zip(ring, [*ring[1:], *ring[:1]], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
    return ring


def _plain(ring) -> list[tuple[float, float]]:  # noqa: ANN001
    return [(p["lon"], p["lat"]) for p in ring]


def _as_points(ring: list[tuple[float, float]]) -> list[dict[str, float]]:
    return [{"lon": x, "lat": y} for x, y in ring]


def generalize(df: DataFrame, polygon: str, tolerance: float) -> DataFrame:
    """Fewer points: none that is left out lies farther than ``tolerance`` degrees from the new outline."""
    ship(df.sparkSession)

    @F.pandas_udf(POLYGON)
    def simpler(polygons: pd.Series) -> pd.Series:
        return polygons.map(lambda rings: None if rings is None else [_as_points(_simpler(_plain(r), tolerance)) for r in rings])

    return df.withColumn(polygon, simpler(C.name(polygon)))


def spatial_process(df: DataFrame, a: str, b: str, action: str = "combine", out: str = "Processed") -> DataFrame:
    """``combine``: the rings of both, for polygons that don't overlap. ``intersect``: the part of the first within the second,
    whose first ring must be convex; null where nothing is common."""
    if action == "combine":
        return df.withColumn(out, F.concat(F.coalesce(C.name(a), F.array().cast(POLYGON)), F.coalesce(C.name(b), F.array().cast(POLYGON))))
    if action != "intersect":
        raise ValueError(f"{action} is not known")
    ship(df.sparkSession)

    def common(rings, clip):  # noqa: ANN001, ANN202
        if rings is None or clip is None or not len(clip):
            return None
        made = [_clipped(_plain(r), _plain(clip[0])) for r in rings]
        made = [_as_points(r) for r in made if len(r) > 2]
        return made or None

    @F.pandas_udf(POLYGON)
    def intersection(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([common(x, y) for x, y in zip(first, second, strict=True)], dtype=object)

    return df.withColumn(out, intersection(C.name(a), C.name(b)))
