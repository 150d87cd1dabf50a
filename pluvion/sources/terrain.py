"""Terrain from grids of heights: projection, slope and aspect, point samples, relief by window and landform classes.

A grid is a table (row, col, x, y, z), as ``tables.raster_xyz`` reads it. Neighbours of a cell meet by equal joins on
tiles with a margin; no cell is set against all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import ship

TILE = 256
GROUPS = {"elevation": ("elevation",), "slope": ("slope",), "aspect": ("aspect_sin", "aspect_cos")}


def columns_of(groups: list[str]) -> list[str]:
    return [c for g in groups for c in GROUPS[g]]


def transverse_mercator(lon: np.ndarray, lat: np.ndarray, zone: int = 49) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing in metres on the WGS 84 ellipsoid (Krueger's series, sixth order)."""
    a, f, k0, lon0 = 6378137.0, 1 / 298.257223563, 0.9996, 6 * zone - 183
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440, 49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600, 34729 * n**5 / 80640 - 3418889 * n**6 / 1995840, 212378941 * n**6 / 319334400,
    )
    phi, dl = np.radians(lat), np.radians(np.asarray(lon, float) - lon0)
    e = np.sqrt(f * (2 - f))
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(dl)), np.arcsinh(np.sin(dl) / np.hypot(t, np.cos(dl)))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east, north = east + c * np.cos(2 * j * xi) * np.sinh(2 * j * eta), north + c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return 500_000 + k0 * radius * east, k0 * radius * north + np.where(np.asarray(lat) < 0, 1e7, 0.0)


def slope_aspect(z: np.ndarray, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray]:
    """(slope in degrees, aspect in degrees clockwise from north) of a grid, north up, by Horn's weights; NaN at edges and beside voids."""
    slope, aspect = np.full(z.shape, np.nan), np.full(z.shape, np.nan)
    if min(z.shape) < 3:
        return slope, aspect
    at = lambda i, j: z[1 + i : z.shape[0] - 1 + i, 1 + j : z.shape[1] - 1 + j]
    gx = ((at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1))) / (8 * dx)
    gy = ((at(-1, -1) + 2 * at(-1, 0) + at(-1, 1)) - (at(1, -1) + 2 * at(1, 0) + at(1, 1))) / (8 * dy)
    slope[1:-1, 1:-1] = np.degrees(np.arctan(np.hypot(gx, gy)))
    aspect[1:-1, 1:-1] = np.degrees(np.arctan2(-gx, -gy)) % 360
    return slope, aspect


def _tiled(grid: DataFrame, margin: int) -> DataFrame:
    """Cells with the tiles that they belong to or border on (i, j), and whether they are a tile's own."""
    near = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - margin) / TILE), F.floor(F.col(c) / TILE), F.floor((F.col(c) + margin) / TILE)))
    x = grid.withColumn("i", F.explode(near("row"))).withColumn("j", F.explode(near("col")))
    return x.withColumn("own", (F.col("i") == F.floor(F.col("row") / TILE)) & (F.col("j") == F.floor(F.col("col") / TILE)))


def derivatives(grid: DataFrame, dx: float, dy: float) -> DataFrame:
    """(row, col, x, y, z, slope, aspect): a tile and its margin are one group."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = rows["row"].min(), rows["col"].min()
        z = np.full((rows["row"].max() - r0 + 1, rows["col"].max() - c0 + 1), np.nan)
        z[rows["row"] - r0, rows["col"] - c0] = rows["z"]
        slope, aspect = slope_aspect(z, dx, dy)
        own = rows[rows["own"]].copy()
        own["slope"], own["aspect"] = slope[own["row"] - r0, own["col"] - c0], aspect[own["row"] - r0, own["col"] - c0]
        return own[["row", "col", "x", "y", "z", "slope", "aspect"]]

    ship(grid.sparkSession)
    out = _tiled(grid, 1).groupBy("i", "j").applyInPandas(one, "row int, col int, x double, y double, z double, slope double, aspect double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("z", "slope", "aspect")})


def mosaic(tiles: list[DataFrame]) -> DataFrame:
    """One grid of tiles (x, y, z): of cells that several hold, the first known value in their order; rows and columns counted anew."""
    from functools import reduce

    tall = reduce(DataFrame.unionByName, [t.select("x", "y", "z").withColumn("order", F.lit(i)) for i, t in enumerate(tiles)])
    known = tall.groupBy("x", "y").agg(F.min_by("z", F.when(F.col("z").isNotNull(), F.col("order")).otherwise(1 << 30)).alias("z"))
    return known.withColumns({"col": F.dense_rank().over(Window.orderBy("x")).cast("int"), "row": F.dense_rank().over(Window.orderBy(F.desc("y"))).cast("int")})


def sample(grid: DataFrame, points: DataFrame, step: float, columns: list[str], bilinear: bool = True) -> DataFrame:
    """Points (station_id, x, y) with the grid's columns at them: of the nearest cell, or of the four around by weight.

    Cell centres lie on multiples of ``step`` from the grid's west and north edges; weights are shared out among known cells.
    """
    edge = grid.agg(F.min("x").alias("west"), F.max("y").alias("north"), F.min("col").alias("c0"), F.min("row").alias("r0")).first()
    if edge["west"] is None:
        return points.withColumns({c: F.lit(None).cast("double") for c in columns})
    px, py = (F.col("px") - edge["west"]) / step, (edge["north"] - F.col("py")) / step
    at = points.select("station_id", F.col("x").alias("px"), F.col("y").alias("py")).withColumns({"u": px, "v": py})
    if bilinear:
        at = at.withColumn("k", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))))
        place = {"cc": F.floor("u") + F.col("k.i"), "rr": F.floor("v") + F.col("k.j")}
        w = F.abs(1 - F.col("k.i") - (F.col("u") - F.floor("u"))) * F.abs(1 - F.col("k.j") - (F.col("v") - F.floor("v")))
    else:
        place, w = {"cc": F.rint("u"), "rr": F.rint("v")}, F.lit(1.0)
    at = at.withColumns({n: (e + edge[k]).cast("int") for (n, e), k in zip(place.items(), ("c0", "r0"), strict=True)}).withColumn("w", w)
    met = at.join(grid.select(F.col("col").alias("cc"), F.col("row").alias("rr"), *columns), ["cc", "rr"], "left")
    return met.groupBy("station_id").agg(*(F.try_divide(F.sum(F.when(F.col(c).isNotNull(), F.col("w") * F.col(c))), F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c) for c in columns))


def station_terrain(stations: DataFrame, sampled: DataFrame) -> DataFrame:
    """Elevation, slope and the aspect's sine and cosine (0 where flat) of each station; an unknown one stops the job."""
    x = stations.join(sampled, "station_id", "left")
    sure = F.when(F.col("z").isNull() | F.col("slope").isNull(), F.raise_error(F.concat(F.lit("no terrain at station "), F.col("station_id").cast("string"))).cast("double")).otherwise(F.col("z"))
    parts = {f"aspect_{t}": F.expr(S.aspect_component(t, "aspect", "slope")) for t in ("sin", "cos")}
    return x.withColumns({"elevation": sure, **parts}).select(*stations.columns, "elevation", "slope", "aspect_sin", "aspect_cos")


def window_relief(grid: DataFrame, stations: DataFrame, sides: list[int], step: float) -> DataFrame:
    """(station_id, side, relief, mean_slope): highest less lowest cell of the square window about each station; NULL where a cell is void.

    Cells and stations meet on blocks of half a window; a cell joins the blocks around its own only.
    """
    out = None
    for side in sides:
        reach = side / 2 * step
        block = lambda c: F.floor(F.col(c) / reach)
        s = stations.select("station_id", F.col("x").alias("sx"), F.col("y").alias("sy")).withColumns({"bx": F.explode(F.sequence(F.floor(F.col("sx") / reach) - 1, F.floor(F.col("sx") / reach) + 1))})
        s = s.withColumn("by", F.explode(F.sequence(F.floor(F.col("sy") / reach) - 1, F.floor(F.col("sy") / reach) + 1)))
        cells = grid.withColumns({"bx": block("x"), "by": block("y")})
        met = s.join(cells, ["bx", "by"]).filter((F.abs(F.col("x") - F.col("sx")) <= reach) & (F.abs(F.col("y") - F.col("sy")) <= reach))
        one = met.groupBy("station_id").agg(F.when(F.count("z") == F.count(F.lit(1)), F.max("z") - F.min("z")).alias("relief"), F.avg("slope").alias("mean_slope")).withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return out.select("station_id", "side", "relief", "mean_slope")


def change_point(values: np.ndarray) -> int:
    """Index (from 1) after which the mean changes most: largest gain of two means over one, the earliest on ties."""
    n = len(values)
    i = np.arange(1, n)
    sums = np.cumsum(values)[:-1]
    gain = i * (n - i) / n * (sums / i - (np.sum(values) - sums) / (n - i)) ** 2
    return int(np.argmax(gain.round(12))) + 1


def best_side(sides: list[float], relief: list[float]) -> float:
    """Window side where the mean of log(relief / area) changes."""
    x = np.log(np.asarray(relief, float) / np.square(np.asarray(sides, float)))
    return sides[change_point(x) - 1]


def landform(stations: DataFrame, relief: DataFrame, side: int) -> DataFrame:
    """Relief class and altitude class of each station at one window side."""
    x = stations.join(relief.filter(F.col("side") == side), "station_id")
    checked = F.when(F.col("relief") < 0, F.raise_error(F.lit("relief below 0")).cast("double")).otherwise(F.col("relief"))
    altitude = F.when(F.col("elevation") < 500, "low").when(F.col("elevation") < 1000, "middle").otherwise("high")
    return x.withColumn("relief", checked).withColumns({"relief_class": F.expr(S.relief_class("relief")), "altitude_class": altitude, "relief_text": F.format_string("%.3f", "relief")})
