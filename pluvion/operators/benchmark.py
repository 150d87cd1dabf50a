"""Nested spatial benchmark: folds, grids of candidates, tuning on inner folds, held-out predictions, choice, blend and status.

Every candidate of every method is tried in one grouped map a method (a group is one held fold's time), so tuning is a
pass over the panel and not a loop of jobs; scores and choices are aggregates and windows over its rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import near
from ..functions import regression as G
from ..session import ship
from ..storage import materialise

#: Methods reported, tested against, that define the common cells, and fitted by mode.
REPORTED = ("raw", "zero", "train_clim", "hour_field_mean", "idw", "adw", "tps", "gwr", "residual_gwr", "mixed_gwr", "mgwr", "auto")
BASELINES = ("idw", "adw", "tps")
MASKING = ("raw", "idw", "adw", "tps", "gwr", "residual_gwr", "mixed_gwr", "mgwr")
DIRECT, RESIDUAL = ("idw", "adw", "tps", "gwr"), ("gwr", "mixed_gwr", "mgwr")
BLEND_STEPS = tuple(round(0.1 * i, 1) for i in range(11))
STACK_LEAST = 500


@dataclass(frozen=True)
class Config:
    """What a run covers. Products beside the raw ones come from fusion variants; blends and stacks add methods."""

    products: tuple[str, ...] = ("a",)
    fusions: tuple[str, ...] = ()
    folds: int = 5
    repeats: int = 1
    seed: int = 0
    scheme: str = "hilbert"
    powers: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5, 3.0)
    neighbours: tuple[int | None, ...] = (8, 16, 32, 64, None)
    smooths: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
    kernels: tuple[str, ...] = ("bisquare",)
    adaptive: tuple[float, ...] = (12, 20, 40)
    fixed: tuple[float, ...] = (50.0,)
    least_coverage: float = 0.95
    least_selection_stations: int = 10
    wet: float = 0.1
    terrain: tuple[str, ...] = ()
    joint: bool = False
    blend_axes: tuple[str, ...] = ("constant",)
    stack: bool = False

    def __post_init__(self):
        if self.folds < 2 or self.repeats < 1 or not 0 <= self.least_coverage <= 1:
            raise ValueError("two folds, one repeat and a coverage of 0 to 1 at least")
        if self.scheme not in SCHEMES:
            raise ValueError(f"unknown scheme {self.scheme}")

    @property
    def terrain_enabled(self) -> bool:
        return bool(self.terrain)

    @property
    def joint_enabled(self) -> bool:
        return self.joint

    def methods(self) -> list[str]:
        return [*REPORTED, *(blend_method(a) for a in self.blend_axes), *(["stack"] if self.stack else [])]

    def all_products(self) -> list[str]:
        return [*self.products, *(fused_product(v) for v in self.fusions)]

    def seeds(self) -> list[int]:
        return [self.seed + i for i in range(self.repeats)]

    def families(self) -> tuple[list[float], list[float]]:
        """(neighbour counts, km with infinity: the global fit)."""
        return list(self.adaptive), [*self.fixed, math.inf]

    def usable(self, groups: list[int]) -> list[float]:
        """Neighbour counts that the smallest training set of ``groups`` (fold sizes) has."""
        least = sum(groups) - max(groups) if groups else 0
        return [k for k in self.adaptive if k <= least]


def blend_bands(axis: str) -> int:
    return {"constant": 1, "agreement_envelope": 9}[axis]


def blend_tag(axis: str) -> str:
    return {"constant": "", "agreement_envelope": "_ae"}[axis]


def blend_method(axis: str) -> str:
    return f"blend{blend_tag(axis)}"


def stack_bands() -> int:
    return 30


def fused_product(variant: str) -> str:
    return f"MERGED_{variant.upper()}"


def output_method(mode: str, method: str) -> str:
    return f"residual_{method}" if mode == "residual" and method == "gwr" else method


def repeat_dir(out: str, repeat: int, repeats: int) -> str:
    return out if repeats == 1 else f"{out}/repeat={repeat}"


# --- folds

SCHEMES: dict[str, Callable] = {
    "hilbert": lambda ids, place, k, seed, turn: L.hilbert_folds(ids, place, k, turn),
    "balanced": lambda ids, place, k, seed, turn: G.balanced_folds(place, k, seed),
    "farthest": lambda ids, place, k, seed, turn: G.balanced_folds(place, k, seed, True),
    "random": lambda ids, place, k, seed, turn: np.random.default_rng(seed).permutation(np.arange(len(ids)) % k) + 1,
}


def folds(stations: pd.DataFrame, config: Config, repeat: int = 1) -> np.ndarray:
    """Outer fold of each station; a repeat turns the curve (or seeds the draw) anew."""
    return SCHEMES[config.scheme](stations["station_id"].tolist(), stations[["lon", "lat"]].to_numpy(float), config.folds, config.seed + repeat - 1, repeat - 1)


def inner_folds(stations: pd.DataFrame, config: Config, repeat: int, fold: int) -> np.ndarray | None:
    """Inner fold of the training stations of an outer one; None where too few would be left to fit on."""
    n = len(stations)
    if n - -(-n // config.folds) < config.least_selection_stations:
        return None
    return SCHEMES[config.scheme](stations["station_id"].tolist(), stations[["lon", "lat"]].to_numpy(float), config.folds, config.seed + repeat - 1, 100 * repeat + fold)


def split(stations: DataFrame, config: Config, repeat: int = 1) -> DataFrame:
    """(station_id, lon, lat, held, fold, inner): a row for each station and held fold; inner is NULL for the held ones.

    The network (hundreds to thousands of rows) is one group. ``inner`` 0: each station left out alone, as too few would be left.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("station_id", ignore_index=True)
        rows["fold"] = folds(rows, config, repeat)
        out = []
        for held in range(1, config.folds + 1):
            part = rows[["station_id", "lon", "lat", "fold"]].copy()
            train = (part["fold"] != held).to_numpy()
            found = inner_folds(part[train], config, repeat, held)
            part["held"], part["inner"] = held, pd.array([pd.NA] * len(part), "Int64")
            part.loc[train, "inner"] = 0 if found is None else found
            out.append(part)
        return pd.concat(out, ignore_index=True)[["station_id", "lon", "lat", "held", "fold", "inner"]]

    ship(stations.sparkSession)
    return stations.select("station_id", "lon", "lat").withColumn("network", F.lit(0)).groupBy("network").applyInPandas(one, "station_id bigint, lon double, lat double, held bigint, fold bigint, inner bigint")


# --- candidates


def grid(config: Config, method: str) -> list[dict]:
    if method in ("idw", "adw"):
        return [{"power": p, "k": k} for p in config.powers for k in config.neighbours]
    if method == "tps":
        return [{"smooth": s} for s in config.smooths]
    near, km = config.families()
    return [{"kernel": kernel, "adaptive": adaptive, "bw": b} for kernel in config.kernels for adaptive, widths in ((True, near), (False, km)) for b in widths]


def predict(method: str, train: np.ndarray, y: np.ndarray, target: np.ndarray, options: dict) -> np.ndarray:
    """Values at the targets of one time; methods by name."""
    if method == "idw":
        return G.idw(train, y, target, options["power"], options["k"])
    if method == "adw":
        return G.adw(train, y, target, options["power"], options["k"])
    if method == "tps":
        return L.tps_predict(train, y, target, options["smooth"])
    bw = min(options["bw"], len(train) - 1) if options["adaptive"] else options["bw"]
    if method == "gwr":
        return G.gwr(train, y, target, options["kernel"], options["adaptive"], bw)
    x, at = mixed_design(train, train), mixed_design(train, target)
    width = bw if math.isfinite(bw) else 1e9
    common = {"kernel": options["kernel"], "adaptive": options["adaptive"]}
    if len(train) <= 5:
        return np.full(len(target), np.nan)
    if method == "mixed_gwr":
        return G.mixed(y, train, x[:, :1], x[:, 1:], target, at[:, :1], at[:, 1:], width, **common)
    if method == "mgwr":
        return G.damped(y, train, [x[:, [i]] for i in range(3)], np.zeros((len(x), 0)), target, [at[:, [i]] for i in range(3)], np.zeros((len(at), 0)), [width] * 3, **common)
    raise ValueError(f"unknown method {method}")


def mixed_design(train: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[1, lon, lat] scaled by the training stations."""
    scale = train.std(axis=0, ddof=1) if len(train) > 1 else np.ones(2)
    return np.column_stack([np.ones(len(at)), (at - train.mean(axis=0)) / np.where(scale > 0, scale, 1)])


TRIED = "held bigint, candidate int, station_id bigint, t bigint, obs double, product double, pred double, failed string"


#: Methods whose prediction at a target (and whether it fails) does not depend on the other targets.
APART = ("idw", "adw", "gwr")


def tried(cells: DataFrame, method: str, options: list[dict], residual: bool, inner: bool, scored: bool = False, only: dict[int, int] | None = None) -> DataFrame:
    """TRIED: every candidate's prediction of held stations (or of training stations on the inner folds).

    cells: (held, fold, inner, station_id, lon, lat, t, obs, product). A candidate that fails gives its error and NULLs.
    scored: only rows that scores take, with observation and product, need be given. only: the candidate of each held fold
    to try; no other, and no other fold, is given.
    """
    if only is not None:
        cells = cells.filter(F.col("held").isin(*only))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("station_id", ignore_index=True)
        place = rows[["lon", "lat"]].to_numpy(float)
        value = (rows["obs"] - rows["product"] if residual else rows["obs"]).to_numpy(float)
        train = (rows["fold"] != rows["held"]).to_numpy()
        known = train & np.isfinite(value)
        if inner:
            part = rows["inner"].fillna(-1).to_numpy()
            splits = [(known & (part != f), train & (part == f)) for f in np.unique(part[train]) if f > 0]
            if not splits:  # each station by all others
                splits = [(known & (np.arange(len(rows)) != i), np.arange(len(rows)) == i) for i in np.flatnonzero(train)]
        else:
            splits = [(known, ~train)]
        out = []
        shared = {}
        wanted = np.ones(len(rows), bool)
        if scored and method in APART:
            wanted = (rows["obs"].notna() & rows["product"].notna()).to_numpy()
            splits = [(a, b & wanted) for a, b in splits]
        which = (train if inner else ~train) & wanted
        chosen = [(i, o) for i, o in enumerate(options) if only is None or i == only[int(rows["held"].iloc[0])]]
        if method in ("idw", "adw") and max((int(a.sum()) * int(b.sum()) for a, b in splits), default=0) > near.WHOLE:
            pairs = [(o["power"], o["k"]) for _, o in chosen]
            shared = {j: G.idw_options(place[a], value[a], place[b], pairs, angular=method == "adw") for j, (a, b) in enumerate(splits) if a.any() and b.any()}
        for at, (i, o) in enumerate(chosen):
            pred, failed = np.full(len(rows), np.nan), None
            for j, (a, b) in enumerate(splits):
                if not a.any() or not b.any():
                    continue
                try:
                    pred[b] = shared[j][at] if shared else predict(method, place[a], value[a], place[b], o)
                except (np.linalg.LinAlgError, ValueError) as error:
                    failed = str(error)
            if residual:
                pred = pred + rows["product"].to_numpy(float)
            found = rows.loc[which, ["held", "station_id", "t", "obs", "product"]].copy()
            found["candidate"], found["pred"], found["failed"] = i, np.maximum(pred[which], 0), failed
            out.append(found)
        return pd.concat(out, ignore_index=True)[["held", "candidate", "station_id", "t", "obs", "product", "pred", "failed"]]

    ship(cells.sparkSession)
    out = cells.groupBy("held", "t").applyInPandas(one, TRIED)
    return out.withColumn("pred", F.when(~F.isnan("pred"), F.col("pred")))


def scores(rows: DataFrame, *by: str) -> DataFrame:
    """n, rmse, mae and coverage on cells with observation and product; failures' text. No cell: NULLs and coverage 0."""
    e = F.col("pred") - F.col("obs")
    return rows.filter("obs IS NOT NULL AND product IS NOT NULL").groupBy(*by).agg(
        F.count("pred").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.count("pred") / F.count(F.lit(1))).alias("coverage"), F.max("failed").alias("failed") if "failed" in rows.columns else F.lit(None).cast("string").alias("failed"),
    )


def chosen(scan: DataFrame, least_coverage: float, *by: str) -> DataFrame:
    """The best candidate of each group: rmse, mae, coverage, number."""
    order = Window.partitionBy(*by).orderBy("rmse", "mae", F.col("coverage").desc(), "candidate")
    return scan.filter((F.col("n") > 0) & (F.col("coverage") >= least_coverage)).withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def coordinate_descent(score: Callable[[list[tuple]], dict], grid_: list[float], groups: int, sweeps: int = 5) -> tuple[tuple, bool]:
    """(widths, settled) of several groups: from the widest, one group at a time; ``score`` gives an order for each combination, each asked for once."""
    now, known = tuple([max(grid_)] * groups), {}
    for _ in range(sweeps):
        before = now
        for g in range(groups):
            tries = [(*now[:g], b, *now[g + 1 :]) for b in grid_]
            new = [c for c in tries if c not in known]
            if new:
                known |= score(new)
            now = min(tries, key=lambda c: (known[c], c))
        if now == before:
            return now, True
    return now, False


@dataclass
class Run:
    """Tables of a run; each is written once and read by what follows."""

    predictions: DataFrame  # (method, station_id, t, obs, product, pred)
    scans: DataFrame  # (method, held, candidate, n, rmse, mae, coverage, failed)
    selected: DataFrame  # (method, held, candidate, ...)
    status: DataFrame  # (method, held, status, coverage)
    split: DataFrame
    parts: dict = field(default_factory=dict)


def run(panel: DataFrame, stations: DataFrame, config: Config, methods: tuple[str, ...] = ("idw", "adw", "tps", "gwr", "residual_gwr", "mixed_gwr", "mgwr"), repeat: int = 1) -> Run:
    """Nested benchmark of a product. panel: (station_id, t, obs, product).

    Each method is tuned on the inner folds of every held fold, predicts the held stations with what was chosen there, and
    the best method of each held fold is "auto". A method without a candidate of enough coverage has the status "unavailable".
    """
    places = materialise(split(stations, config, repeat), "bench-split")
    cells = panel.join(places, "station_id").select("held", "fold", "inner", "station_id", "lon", "lat", "t", "obs", "product")
    scans, picks, found = [], [], []
    for method in methods:
        residual = method in ("residual_gwr", "mixed_gwr", "mgwr")
        name = "gwr" if method == "residual_gwr" else method
        options = grid(config, name)
        scan = materialise(scores(tried(cells, name, options, residual, True, scored=True), "held", "candidate").withColumn("method", F.lit(method)), "bench-scan")
        pick = materialise(chosen(scan, config.least_coverage, "method", "held"), "bench-pick")
        only = {r["held"]: r["candidate"] for r in pick.select("held", "candidate").collect()}  # a row a held fold
        outer = tried(cells, name, options, residual, False, only=only).withColumn("method", F.lit(method))
        scans.append(scan)
        picks.append(pick)
        found.append(outer.select("method", "held", "station_id", "t", "obs", "product", "pred"))
    tall = lambda parts: reduce(DataFrame.unionByName, parts)
    scan, pick = tall(scans), tall(picks)
    predictions = materialise(tall(found).unionByName(nulls(cells)), "bench-predictions")
    auto = auto_choice(pick)
    named = predictions.join(auto.select("held", "method"), ["held", "method"]).withColumn("method", F.lit("auto"))
    predictions = materialise(predictions.unionByName(named.select(predictions.columns)), "bench-all")
    done = scores(predictions, "method", "held").select("method", "held", "n", "coverage")
    wanted = pick.sparkSession.createDataFrame([(m, h) for m in methods for h in range(1, config.folds + 1)], "method string, held bigint")
    status = wanted.join(pick.select("method", "held", F.col("candidate").alias("picked")), ["method", "held"], "left").join(done, ["method", "held"], "left").join(auto.select("held", F.col("method").alias("auto")), "held", "left")
    status = status.select("method", "held", F.when(F.col("picked").isNull(), "unavailable").when(F.col("coverage") < config.least_coverage, "low_coverage").otherwise("ok").alias("status"), "coverage", (F.col("auto") == F.col("method")).alias("is_auto"))
    return Run(predictions, scan, pick, status, places)


def nulls(cells: DataFrame) -> DataFrame:
    """The raw product, zero, the training mean and the time's training mean, for each held fold."""
    train = F.col("fold") != F.col("held")
    rows = cells.withColumns({"clim": F.avg(F.when(train, F.col("obs"))).over(Window.partitionBy("held")), "field": F.avg(F.when(train, F.col("obs"))).over(Window.partitionBy("held", "t"))}).filter(~train)
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), v.cast("double").alias("pred")) for n, v in (("raw", F.col("product")), ("zero", F.lit(0.0)), ("train_clim", F.col("clim")), ("hour_field_mean", F.col("field")))))).alias("x")
    return rows.select("held", "station_id", "t", "obs", "product", named).select("x.method", "held", "station_id", "t", "obs", "product", "x.pred")


def auto_choice(picks: DataFrame, contenders: tuple[str, ...] = ("gwr", "residual_gwr", "mixed_gwr", "mgwr"), twins: DataFrame | None = None) -> DataFrame:
    """(held, method): the best contender on the inner folds by rmse, mae and name; of ``twins`` (held) only residual_gwr contends, as mixed_gwr is the same fit."""
    rows = picks.filter(F.col("method").isin(*contenders))
    if twins is not None:
        rows = rows.join(twins.select("held").withColumn("method", F.lit("mixed_gwr")), ["held", "method"], "left_anti")
    order = Window.partitionBy("held").orderBy("rmse", "mae", "method")
    return rows.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").select("held", "method", "rmse", "mae")


def common_cells(predictions: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(station_id, t) that every one of the methods predicts and that are observed."""
    return predictions.filter(F.col("method").isin(*methods) & F.col("pred").isNotNull() & F.col("obs").isNotNull()).groupBy("station_id", "t").agg(F.count_distinct("method").alias("n")).filter(F.col("n") == len(methods)).select("station_id", "t")


def method_scores(run_: Run, methods: tuple[str, ...]) -> DataFrame:
    """Scores of every method on the cells common to ``methods``."""
    rows = run_.predictions.join(common_cells(run_.predictions, methods), ["station_id", "t"])
    return scores(rows, "method").drop("failed").withColumns({c: F.round(c, 8) for c in ("rmse", "mae", "coverage")})


def blend_weight(inner: DataFrame, source: str, fallback: str, wet: float = 0.1, band: str | None = None) -> DataFrame:
    """(held, band, lam): weight of the fallback on wet cells with the least squared error; the smaller on ties. inner: (held, band, obs, product, <source>, <fallback>)."""
    rows = inner.withColumn("band", F.col(band) if band else F.lit(0)).withColumn("lam", F.explode(F.array(*map(F.lit, BLEND_STEPS))))
    wet_cell = (F.col("product") >= wet) & F.col(fallback).isNotNull()
    pred = F.when(wet_cell, (1 - F.col("lam")) * F.col(source) + F.col("lam") * F.col(fallback)).otherwise(F.col(source))
    sse = rows.filter(F.col(source).isNotNull() & F.col("obs").isNotNull()).groupBy("held", "band", "lam").agg(F.sum((pred - F.col("obs")) ** 2).alias("sse"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("held", "band").orderBy(F.round("sse", 9), "lam")
    return sse.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").select("held", "band", "lam", "n")


def stack_weights(inner: DataFrame, features: list[str], least: int = STACK_LEAST) -> dict:
    """{(held, band): weights}: non-negative least squares of complete cells by band; of all bands together (key None) where a band has fewer than ``least``."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*features, "obs"]])
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features)] + [F.sum(F.col(a) * F.col("obs")).alias(f"r{i}") for i, a in enumerate(features)]
    out, p = {}, len(features)
    rows = inner.filter(known).groupBy("held", "band").agg(*sums, F.sum(F.col("obs") ** 2).alias("yy"), F.count(F.lit(1)).alias("n")).collect()  # a row a band
    solve = lambda g, r, yy: L.nnls(g, r, yy)
    for held in {r["held"] for r in rows}:
        of = [r for r in rows if r["held"] == held]
        gram = {r["band"]: np.array([[r[f"g{i}_{j}"] for j in range(p)] for i in range(p)]) for r in of}
        rhs = {r["band"]: np.array([r[f"r{i}"] for i in range(p)]) for r in of}
        pooled = solve(sum(gram.values()), sum(rhs.values()), sum(r["yy"] for r in of))
        out[held, None] = pooled
        out |= {(held, r["band"]): solve(gram[r["band"]], rhs[r["band"]], r["yy"]) if r["n"] >= least else pooled for r in of}
    return out


def stacked(rows: DataFrame, features: list[str], weights: dict, source: str) -> DataFrame:
    """Adds pred: the weighted sum, or the source where a feature is missing; not cut at 0. Bands that were not met take the pooled weights."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(h, b, [float(x) for x in w]) for (h, b), w in weights.items() if b is not None], "held bigint, band bigint, w array<double>")
    pooled = spark.createDataFrame([(h, [float(x) for x in w]) for (h, b), w in weights.items() if b is None], "held bigint, pooled array<double>")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    joined = rows.join(table, ["held", "band"], "left").join(pooled, "held", "left").withColumn("w", F.coalesce("w", "pooled"))
    total = reduce(lambda a, b: a + b, [F.col("w")[i] * F.col(c) for i, c in enumerate(features)])
    return joined.withColumn("pred", F.when(known & F.col("w").isNotNull(), total).otherwise(F.col(source))).drop("w", "pooled")


def banded_coefficients(rows: DataFrame, features: list[str], least: int = 2000) -> dict:
    """{(fold, band): coefficients} of least squares with an intercept on the other folds' complete cells; of all bands (None) where a band has fewer than ``least`` or is singular. rows: (fold, band, obs, features)."""
    x = [F.lit(1.0), *(F.col(c) for c in features)]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*features, "obs"]])
    p = len(x)
    sums = [F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)] + [F.sum(a * F.col("obs")).alias(f"r{i}") for i, a in enumerate(x)]
    met = rows.filter(known).groupBy("fold", "band").agg(*sums, F.count(F.lit(1)).alias("n")).collect()  # a row a fold and band
    gram = {(r["fold"], r["band"]): (np.array([[r[f"g{i}_{j}"] for j in range(p)] for i in range(p)]), np.array([r[f"r{i}"] for i in range(p)]), r["n"]) for r in met}
    out = {}
    for fold in {f for f, _ in gram}:
        rest = {k: v for k, v in gram.items() if k[0] != fold}
        pooled = _solve(sum(v[0] for v in rest.values()), sum(v[1] for v in rest.values())) if rest else None
        if pooled is None:
            raise ValueError(f"the cells outside fold {fold} don't determine the coefficients")
        out[fold, None] = pooled
        for band in {b for _, b in gram}:
            own = [v for (_, b), v in rest.items() if b == band]
            found = _solve(sum(v[0] for v in own), sum(v[1] for v in own)) if sum(v[2] for v in own) >= least else None
            out[fold, band] = pooled if found is None else found
    return out


def _solve(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray | None:
    """Least squares from sums of products, with a ridge relative to their trace; None where singular."""
    even = gram + 1e-9 * np.trace(gram) / len(gram) * np.eye(len(gram))
    try:
        return np.linalg.solve(even, rhs) if np.linalg.cond(gram) < 1e12 else None
    except np.linalg.LinAlgError:
        return None


def equal_weights(sources: int) -> np.ndarray:
    """Intercept 0 and the mean of the sources."""
    return np.array([0.0] + [1.0 / sources] * sources)


def quantile_mapped(rows: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Adds mapped: the observation at the same quantile of the other folds, between ``bins`` quantiles. rows: (fold, obs, <value>)."""
    known = rows.filter(F.col("obs").isNotNull() & F.col(value).isNotNull())
    at = [i / bins for i in range(bins + 1)]
    folds_ = [r["fold"] for r in known.select("fold").distinct().collect()]  # a handful
    table = reduce(DataFrame.unionByName, [known.filter(F.col("fold") != f).agg(F.percentile_approx(value, at, 100_000).alias("q_value"), F.percentile_approx("obs", at, 100_000).alias("q_obs")).withColumn("fold", F.lit(f)) for f in folds_]) if folds_ else None
    if table is None:
        return rows.withColumn("mapped", F.lit(None).cast("double")).limit(0)
    joined = rows.join(table, "fold")
    # the first quantile not below the value, and the one before it
    first = F.array_position(F.transform("q_value", lambda q: q >= F.col(value)), True)  # 0: above all
    place = F.when(first == 0, bins).otherwise(F.greatest(first - 1, F.lit(1))).cast("int")
    out = joined.withColumn("__k", place)
    low, high = F.col("q_value")[F.col("__k") - 1], F.col("q_value")[F.col("__k")]
    share = F.when(high > low, F.least(F.greatest((F.col(value) - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0))
    mapped = F.col("q_obs")[F.col("__k") - 1] + share * (F.col("q_obs")[F.col("__k")] - F.col("q_obs")[F.col("__k") - 1])
    return out.withColumn("mapped", F.when(F.col(value).isNotNull(), mapped)).drop("__k", "q_value", "q_obs")


def kernel_runs(panel: DataFrame, stations: DataFrame, config: Config, kernels: tuple[str, ...], method: str = "residual_gwr") -> DataFrame:
    """(kernel, held, n, rmse, mae, coverage): held-out scores of one method under each kernel, tuned by itself, and under "nested", the kernel that the inner folds choose."""
    from dataclasses import replace

    name, residual = ("gwr", True) if method == "residual_gwr" else (method, method in RESIDUAL and method != "gwr")
    places = materialise(split(stations, config), "kernel-split")
    cells = panel.join(places, "station_id").select("held", "fold", "inner", "station_id", "lon", "lat", "t", "obs", "product")
    out = []
    for label, some in (*((k, (k,)) for k in kernels), ("nested", kernels)):
        options = grid(replace(config, kernels=some), name)
        pick = chosen(scores(tried(cells, name, options, residual, True), "held", "candidate"), config.least_coverage, "held").select("held", "candidate")
        held = tried(cells, name, options, residual, False).join(pick, ["held", "candidate"])
        out.append(scores(held, "held").drop("failed").withColumn("kernel", F.lit(label)))
    return reduce(DataFrame.unionByName, out)


def terrain_by_fold(stations: pd.DataFrame, response: str, groups: dict[str, list[str]], rules) -> pd.DataFrame:
    """Terrain screen of all stations (fold 0) and without each fold's: what a fold's model may use. stations: (fold, ...)."""
    from . import selection as N

    parts = [N.stamped(N.terrain_screen(stations, response, groups, rules), fold=0)]
    parts += [N.stamped(N.terrain_screen(stations[stations["fold"] != f], response, groups, rules), fold=int(f)) for f in sorted(stations["fold"].unique())]
    return pd.concat(parts, ignore_index=True)


def terrain_widths(place: np.ndarray, y: np.ndarray, groups: list[np.ndarray], fixed: np.ndarray, grid_: list[int], sweeps: int = 5) -> tuple[tuple, bool]:
    """Neighbour counts of a mixed (one group) or multiscale model by the self-excluding fit's error."""

    def score(new):
        found = {}
        for c in new:
            fit = G.damped(y, place, groups, fixed, place, groups, fixed, [min(b, len(y) - 1) for b in c], loo=True)
            found[c] = float(np.sqrt(np.mean((y - fit) ** 2))) if np.isfinite(fit).all() else math.inf
        return found

    return coordinate_descent(score, grid_, len(groups), sweeps)
