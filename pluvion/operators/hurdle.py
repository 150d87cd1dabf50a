"""Hurdle model: the chance of rain times the amount given rain, both varying over space.

The fit is DataFrame work: for each station, sums of products of the amount features over its wet cells, and counts of
cells and wet cells by month and class of the product. A target's sums are its neighbours' with kernel weights; what has
too little behind it falls back (month, all months, the whole network). The solve for each target is a grouped map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import regression as G
from ..session import ship


@dataclass(frozen=True)
class FixedBandwidth:
    """Kilometres."""

    km: float

    def __post_init__(self):
        if not (np.isfinite(self.km) and self.km > 0):
            raise ValueError("a fixed bandwidth is finite and above 0")


@dataclass(frozen=True)
class AdaptiveBandwidth:
    """Number of neighbours."""

    neighbours: int

    def __post_init__(self):
        if self.neighbours < 1:
            raise ValueError("an adaptive bandwidth is 1 or more")


@dataclass(frozen=True)
class Hurdle:
    bandwidth: FixedBandwidth | AdaptiveBandwidth = AdaptiveBandwidth(50)
    kernel: str = "bisquare"
    wet: float = 0.1
    breaks: tuple[float, ...] = (0.1, 2.5, 8.0, 16.0)
    ridge: float = 1e-4
    annual: bool = True
    diurnal: bool = True
    by_month: bool = True
    smearing: bool = True
    prior: float = 20.0
    least_stations: float = 8.0
    least_samples: float = 100.0
    most: float = float("inf")
    covariates: tuple[str, ...] = ()

    def __post_init__(self):
        if self.wet <= 0 or self.ridge < 0 or self.prior <= 0 or self.most <= self.wet:
            raise ValueError("wet, prior and the limit are above 0, the ridge isn't below it")
        if list(self.breaks) != sorted(set(self.breaks)):
            raise ValueError("breaks rise")
        if self.kernel not in ("gaussian", "exponential", "bisquare", "tricube", "boxcar"):
            raise ValueError(f"unknown kernel {self.kernel}")

    @property
    def features(self) -> list[str]:
        return ["intercept", "log1p_product", *(["annual_sin", "annual_cos"] if self.annual else []), *(["diurnal_sin", "diurnal_cos"] if self.diurnal else []), *self.covariates]

    def feature_columns(self) -> list[Column]:
        """Of rows with product, ts (hour) and the covariates. The year's angle counts its own days."""
        year = 2 * np.pi * (F.dayofyear("ts") - 1) / F.when((F.year("ts") % 4 == 0) & ((F.year("ts") % 100 != 0) | (F.year("ts") % 400 == 0)), 366).otherwise(365)
        day = 2 * np.pi * F.hour("ts") / 24
        return [F.lit(1.0), F.log1p("product"), *([F.sin(year), F.cos(year)] if self.annual else []), *([F.sin(day), F.cos(day)] if self.diurnal else []), *(F.col(c).cast("double") for c in self.covariates)]

    def category(self, product: Column) -> Column:
        out = F.lit(0)
        for edge in self.breaks:
            out = out + (product >= edge).cast("int")
        return out


def valid(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x >= 0)


def check_places(cells: DataFrame) -> DataFrame:
    """The rows; a place off the globe raises an error."""
    inside = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    return cells.withColumn("lon", F.when(inside, F.col("lon")).otherwise(F.raise_error(F.lit("lon or lat off the globe")).cast("double")))


@dataclass
class Fitted:
    model: Hurdle
    stations: DataFrame  # (station_id, lon, lat, gram, rhs, yy, wet_cells)
    counts: DataFrame  # (station_id, month, category, n, wet)
    centre: np.ndarray
    scale: np.ndarray


def fit(cells: DataFrame, model: Hurdle) -> Fitted:
    """cells: (station_id, lon, lat, ts, obs, product, covariates); history only."""
    names = model.features
    rows = check_places(cells).filter(valid(F.col("obs")) & valid(F.col("product"))).withColumns(dict(zip([f"f{i}" for i in range(len(names))], model.feature_columns(), strict=True)))
    wet = rows.filter(F.col("obs") >= model.wet)
    moments = wet.agg(*(x for i in range(len(names)) for x in (F.avg(f"f{i}").alias(f"m{i}"), F.stddev_pop(f"f{i}").alias(f"s{i}")))).first()
    centre, scale = np.zeros(len(names)), np.ones(len(names))
    for i in range(1, len(names)):  # the intercept stays
        centre[i] = moments[f"m{i}"] or 0.0
        scale[i] = moments[f"s{i}"] if (moments[f"s{i}"] or 0) > G.COINCIDENT_KM else 1.0
    z = [(F.col(f"f{i}") - centre[i]) / scale[i] for i in range(len(names))]
    y = F.log1p("obs")
    sums = wet.groupBy("station_id").agg(F.array(*(F.sum(a * b) for a in z for b in z)).alias("gram"), F.array(*(F.sum(a * y) for a in z)).alias("rhs"), F.sum(y * y).alias("yy"), F.count(F.lit(1)).cast("double").alias("wet_cells"))
    places = rows.groupBy("station_id").agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"))
    month = F.month("ts") if model.by_month else F.lit(1)
    counts = rows.groupBy("station_id", month.alias("month"), model.category(F.col("product")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("obs") >= model.wet).cast("int")).alias("wet"))
    return Fitted(model, places.join(sums, "station_id", "left"), counts, centre, scale)


def _counted(w: np.ndarray, n: np.ndarray, wet: np.ndarray) -> tuple[float, float, float]:
    """(weighted wet, weighted cells, effective stations) of stations that have any."""
    use = (w > 0) & (n > 0)
    w = w[use]
    return float((w * wet[use]).sum()), float((w * n[use]).sum()), float(w.sum() ** 2 / (w * w).sum()) if len(w) else 0.0


def wet_chance(model: Hurdle, w: np.ndarray, n: np.ndarray, wet: np.ndarray, month: int, category: int) -> tuple[float, int]:
    """(chance, code) from counts (station, month, category): 0 the month's, 1 all months', 2 the whole network's."""
    total, rain = n.sum(axis=(0, 1))[category], wet.sum(axis=(0, 1))[category]
    rate = (rain / total) if total else (wet.sum() / n.sum() if n.sum() else 0.5)
    rate = float(np.clip(rate, 1e-6, 1 - 1e-6))
    if model.by_month:
        a, b, stations = _counted(w, n[:, month - 1, category], wet[:, month - 1, category])
        if b >= model.least_samples and stations >= model.least_stations:
            return min((a + model.prior * rate) / (b + model.prior), 1.0), 0
    a, b, stations = _counted(w, n[:, :, category].sum(axis=1), wet[:, :, category].sum(axis=1))
    if b >= model.least_samples and stations >= model.least_stations:
        return min((a + model.prior * rate) / (b + model.prior), 1.0), 1
    return min((rain + model.prior * rate) / (total + model.prior), 1.0), 2


def amount_model(model: Hurdle, w: np.ndarray, gram: np.ndarray, rhs: np.ndarray, yy: np.ndarray, cells: np.ndarray):
    """(coefficients, variance, effective stations, whole network?) from stations' sums; local where the sample is large and well conditioned."""
    use = (w > 0) & (cells > 0)
    sample, stations = float((w * cells)[use].sum()), float(w[use].sum() ** 2 / (w[use] ** 2).sum()) if use.any() else 0.0
    if sample >= model.least_samples and stations >= model.least_stations:
        found = L.hurdle_amount((w[:, None, None] * gram).sum(axis=0), (w[:, None] * rhs).sum(axis=0), float((w * yy).sum()), sample, model.ridge)
        if found is not None:
            return *found, stations, False
    found = L.hurdle_amount(gram.sum(axis=0), rhs.sum(axis=0), float(yy.sum()), float(cells.sum()), model.ridge, np.inf)
    return (*found, stations, True) if found is not None else (None, None, stations, True)


PREDICTION = "target bigint, ts timestamp, corrected double, wet_chance double, amount double, effective_stations double, whole_network boolean, code int"


def predict(fitted: Fitted, cells: DataFrame, leave_out: bool = False) -> DataFrame:
    """PREDICTION rows of cells (station_id, lon, lat, ts, product, covariates); code 3 and NULLs where the product is missing.

    The network's sums (a row a station) go to every task; ``leave_out``: a station is not its own neighbour.
    """
    model, p = fitted.model, len(fitted.model.features)
    network = fitted.stations.orderBy("station_id").toPandas()  # a row a station of the network
    counted = fitted.counts.toPandas()
    at = {s: i for i, s in enumerate(network["station_id"])}
    n, wet = (np.zeros((len(network), 12, len(model.breaks) + 1)) for _ in range(2))
    for s, m, c, x, y in counted[["station_id", "month", "category", "n", "wet"]].itertuples(index=False):
        n[at[s], m - 1, c], wet[at[s], m - 1, c] = x, y
    have = network["gram"].notna().to_numpy()
    gram, rhs, yy, size = np.zeros((len(network), p, p)), np.zeros((len(network), p)), np.zeros(len(network)), np.zeros(len(network))
    for i in np.flatnonzero(have):
        gram[i], rhs[i] = np.asarray(network["gram"][i], float).reshape(p, p), network["rhs"][i]
        yy[i], size[i] = network["yy"][i], network["wet_cells"][i]
    place, ids = network[["lon", "lat"]].to_numpy(float), network["station_id"].to_numpy()
    centre, scale = fitted.centre, fitted.scale

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        d = L.haversine_km(rows[["lon", "lat"]].to_numpy(float)[:1], place)[0]
        own = at.get(rows["target"].iloc[0]) if leave_out else None
        adaptive = isinstance(model.bandwidth, AdaptiveBandwidth)
        w = G.weights_hurdle(d, model.bandwidth.neighbours if adaptive else model.bandwidth.km, adaptive, model.kernel, own)
        if own is not None:
            w[own] = 0.0
        beta, variance, stations, whole = amount_model(model, w, gram, rhs, yy, size)
        chances = {}
        chance, amount, code = np.full(len(rows), np.nan), np.full(len(rows), np.nan), np.full(len(rows), 3)
        good = rows["product"].notna().to_numpy() & (rows["product"].fillna(-1) >= 0).to_numpy()
        for i in np.flatnonzero(good):
            key = int(rows["month"].iloc[i]), int(rows["category"].iloc[i])
            if key not in chances:
                chances[key] = wet_chance(model, w, n, wet, *key)
            chance[i], code[i] = chances[key]
        if beta is not None and good.any():
            x = (np.stack(rows.loc[good, "features"]).astype(float) - centre) / scale
            amount[good] = L.expected_amount(x, beta, variance if model.smearing else 0.0, model.wet, model.most)
        out = rows[["target", "ts"]].copy()
        out["corrected"], out["wet_chance"], out["amount"] = chance * amount, chance, amount
        out["effective_stations"], out["whole_network"], out["code"] = stations, whole, code.astype(np.int32)
        return out

    ship(cells.sparkSession)
    month = F.month("ts") if model.by_month else F.lit(1)
    features = F.array(*model.feature_columns())
    rows = check_places(cells).select(F.col("station_id").cast("bigint").alias("target"), "lon", "lat", "ts", "product", month.alias("month"), model.category(F.col("product")).alias("category"), features.alias("features"))
    out = rows.groupBy("target").applyInPandas(one, PREDICTION)
    return out.select("target", "ts", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("corrected", "wet_chance", "amount")), "effective_stations", "whole_network", "code")


def scan(cells: DataFrame, models: list[Hurdle]) -> DataFrame:
    """(candidate, n, rmse, mae, coverage) of each model, every station left out of its own neighbours; cells as in ``fit``."""
    from functools import reduce

    truth = cells.select(F.col("station_id").cast("bigint").alias("target"), "ts", "obs", "product").filter("obs IS NOT NULL AND product IS NOT NULL")
    parts = [predict(fit(cells, m), cells, leave_out=True).select("target", "ts", "corrected").withColumn("candidate", F.lit(i)) for i, m in enumerate(models)]
    e = F.col("corrected") - F.col("obs")
    return reduce(DataFrame.unionByName, parts).join(truth, ["target", "ts"]).groupBy("candidate").agg(F.count("corrected").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.count("corrected") / F.count(F.lit(1))).alias("coverage"))
