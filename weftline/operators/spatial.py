"""Points, distances and grids over longitude and latitude in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import columns as C

EARTH_KM = 6371.0088


def create_points(df: DataFrame, x: str, y: str, out: str = "Centroid") -> DataFrame:
    """struct(lon, lat); null where a part is missing."""
    lon, lat = C.name(x).cast("double"), C.name(y).cast("double")
    return df.withColumn(out, F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat"))))


def haversine(a: Column, b: Column) -> Column:
    """Kilometres between two points."""
    la, lb = F.radians(a["lat"]), F.radians(b["lat"])
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(F.radians(b["lon"] - a["lon"]) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_KM)


def distance(df: DataFrame, a: str, b: str, out: str = "Distance") -> DataFrame:
    return df.withColumn(out, haversine(C.name(a), C.name(b)))


def make_grid(df: DataFrame, point: str, size: float) -> DataFrame:
    """Cells of ``size`` degrees that cover all points: (cell_x, cell_y, lon, lat) of the lower left corners. The result is as
    large as the extent, made by all tasks."""
    ends = df.agg(*[f(C.name(point)[k]).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in ("lon", "lat")]).first()
    if ends["min_lon"] is None:
        return df.sparkSession.createDataFrame([], "cell_x bigint, cell_y bigint, lon double, lat double")
    x0, y0 = math.floor(ends["min_lon"] / size), math.floor(ends["min_lat"] / size)
    x1, y1 = math.floor(ends["max_lon"] / size), math.floor(ends["max_lat"] / size)
    xs = df.sparkSession.range(x0, x1 + 1).select(F.col("id").alias("cell_x"))
    cells = xs.withColumn("cell_y", F.explode(F.sequence(F.lit(y0).cast("bigint"), F.lit(y1).cast("bigint"))))
    return cells.withColumns({"lon": F.col("cell_x") * F.lit(size), "lat": F.col("cell_y") * F.lit(size)})


def heat_map(df: DataFrame, point: str, size: float) -> DataFrame:
    """(cell_x, cell_y, n): points per cell of ``size`` degrees."""
    p = C.name(point)
    return df.where(p.isNotNull()).groupBy(F.floor(p["lon"] / size).alias("cell_x"), F.floor(p["lat"] / size).alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))


def find_nearest(targets: DataFrame, universe: DataFrame, key: str, point: str, other_key: str, other_point: str, km: float) -> dict[str, DataFrame]:
    """``Matched``: every target with the nearest point of the universe within ``km`` and its distance, of equally near ones the
    least key; ``Unmatched``: targets without one. Points meet by grid cells as wide as ``km``, each in its own and the
    neighbouring cells, so no target meets all points."""
    size = km / 111.0
    # a degree of longitude shrinks towards the poles: cells follow bands of latitude. As many cells as are at least as wide as
    # km at the band's end nearer to a pole; one where km reaches over the pole
    band = lambda p: F.floor(p["lat"] / size)
    edge = lambda b: F.greatest(F.abs(b), F.abs(b + 1)) * F.lit(size)
    width = lambda b: F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(size))) / F.cos(F.radians(edge(b))), F.lit(1.0))))
    cells = lambda b: F.when(edge(b) + F.lit(size) < 90, F.greatest(F.floor(360 / (width(b) * (1 + 1e-9))), F.lit(1))).otherwise(F.lit(1)).cast("bigint")
    cell = lambda p: F.pmod(F.floor((p["lon"] + 180) / 360 * F.col("__cells")), F.col("__cells"))
    t = targets.where(C.name(point).isNotNull()).withColumn("__band", F.explode(F.array(*[band(C.name(point)) + d for d in (-1, 0, 1)])))
    t = t.withColumn("__cells", cells(F.col("__band"))).withColumn("__at", cell(C.name(point)))
    # the last cell's neighbour is the first: the same cell more than once where a band has few
    t = t.withColumn("__cell", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("__at") + d, F.col("__cells")) for d in (-1, 0, 1)])))).drop("__cells", "__at")
    u = universe.where(C.name(other_point).isNotNull()).select(C.name(other_key).alias("__k"), C.name(other_point).alias("__p"))
    u = u.withColumn("__band", band(F.col("__p"))).withColumn("__cells", cells(F.col("__band"))).withColumn("__cell", cell(F.col("__p"))).drop("__cells")
    near = t.join(u, ["__band", "__cell"]).withColumn("__d", haversine(C.name(point), F.col("__p"))).where(F.col("__d") <= km)
    best = near.groupBy(C.name(key)).agg(F.min(F.struct("__d", "__k")).alias("__best"))
    best = best.select(C.name(key).alias("__t"), F.col("__best.__k").alias(f"nearest_{other_key}"), F.col("__best.__d").alias("DistanceKm"))
    return {
        "Matched": targets.join(best, C.name(key) == F.col("__t")).drop("__t"),
        "Unmatched": targets.join(best.select("__t"), C.name(key) == F.col("__t"), "left_anti"),
    }
