"""Residual models on several covariate groups with roles: contexts of held-out folds, designs, predictions and their tuning.

Rows come as (held, station_id, t, fold, lon, lat, obs, product, covariates). What is fitted knows rows whose fold is
not the held one only; the held fold's rows are predicted. A context is DataFrame work; a prediction is a grouped map
whose group is one held fold's time, that is one network.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regression as G
from ..session import ship

METHODS = ("residual_gwr", "mixed_gwr", "mgwr")
SPATIAL = ("intercept", "longitude", "latitude")


@dataclass(frozen=True)
class Groups:
    """Covariate groups (name -> columns), their roles (local or global) and how mgwr groups the spatial columns."""

    columns: dict[str, tuple[str, ...]]
    roles: dict[str, str]
    spatial: str = "intercept_only"
    ridge: float = 1e-6
    tol: float = 1e-5
    most: int = 1000

    def __post_init__(self):
        wrong = [g for g in self.columns if self.roles.get(g) not in ("local", "global")]
        if wrong:
            raise ValueError(f"groups without a role: {wrong}")
        if self.spatial not in ("intercept_only", "shared", "split"):
            raise ValueError(f"spatial grouping: {self.spatial}")

    @property
    def all_columns(self) -> list[str]:
        return [c for g in self.columns.values() for c in g]

    def effective(self, method: str) -> dict[str, str]:
        """Roles under a method: residual_gwr takes all as local."""
        if method not in METHODS:
            raise ValueError(f"unknown method {method}")
        return {g: "local" if method == "residual_gwr" else self.roles[g] for g in self.columns}

    def coincide(self, one: str, two: str) -> bool:
        """Are two methods the same fit? Never mgwr and another."""
        return one == two or "mgwr" not in (one, two) and self.effective(one) == self.effective(two)

    def names(self, method: str) -> list[str]:
        """Names of the local groups, in the order of their bandwidths."""
        if method != "mgwr":
            return ["shared_all_local" if method == "residual_gwr" else "shared_local"]
        spatial = {"split": list(SPATIAL), "shared": ["shared_spatial"], "intercept_only": ["intercept"]}[self.spatial]
        return spatial + [g for g, r in self.roles.items() if g in self.columns and r == "local"]

    def design(self, rows: pd.DataFrame, method: str) -> tuple[list[np.ndarray], np.ndarray]:
        """(local groups, global terms) of rows with columns sx, sy and z_<column>."""
        roles = self.effective(method)
        spatial = np.column_stack([np.ones(len(rows)), rows["sx"], rows["sy"]])
        block = lambda g: rows[[f"z_{c}" for c in self.columns[g]]].to_numpy(float)
        local = [block(g) for g, r in roles.items() if r == "local"]
        fixed = [block(g) for g, r in roles.items() if r == "global"]
        fixed = np.hstack(fixed) if fixed else np.zeros((len(rows), 0))
        if method != "mgwr":
            return [np.hstack([spatial, *local])], fixed
        first = {"split": [spatial[:, [i]] for i in range(3)], "shared": [spatial], "intercept_only": [spatial[:, :1]]}[self.spatial]
        return first + local, fixed


def context(cells: DataFrame, groups: Groups, wet: float = 0.1, period: str | None = None) -> DataFrame:
    """Adds held (one copy of the rows a fold), sx, sy and z_<column> of each covariate, all from the training rows alone.

    A covariate is centred on its mean over the time's training stations, then scaled by the weighted mean and deviation
    over wet training cells with every covariate known; a station weighs 1 in all, and its periods alike where
    ``period`` names their column. Coordinates are scaled by the training stations' mean and deviation. No variation raises an error.
    """
    columns = groups.all_columns
    folds = [r["fold"] for r in cells.select("fold").distinct().collect()]  # a handful
    rows = cells.withColumn("held", F.explode(F.array(*(F.lit(f).cast("bigint") for f in sorted(folds))))) if folds else cells.withColumn("held", F.lit(None).cast("bigint")).limit(0)
    train = F.col("fold") != F.col("held")
    centred = rows.withColumns({f"d_{c}": F.col(c) - F.avg(F.when(train, F.col(c))).over(Window.partitionBy("held", "t")) for c in columns})
    known = F.lit(True)
    for c in columns:
        known &= F.col(c).isNotNull()
    used = centred.filter(train & (F.col("obs") >= wet) & F.col("product").isNotNull() & known)
    by = ["held", "station_id"]
    if period:
        periods = used.groupBy(*by).agg(F.count_distinct(period).alias("periods"))
        weighed = used.join(periods, by).withColumn("w", 1 / (F.col("periods") * F.count(F.lit(1)).over(Window.partitionBy(*by, period))))
    else:
        weighed = used.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy(*by)))
    total = F.sum("w")
    scale = weighed.groupBy("held").agg(*(x for c in columns for x in ((F.sum(F.col("w") * F.col(f"d_{c}")) / total).alias(f"m_{c}"), (F.sum(F.col("w") * F.col(f"d_{c}") * F.col(f"d_{c}")) / total).alias(f"s_{c}"))))
    place = rows.filter(train).select("held", "station_id", "lon", "lat").distinct().groupBy("held").agg(*(x for c in ("lon", "lat") for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))))
    sure = lambda v, name: F.when(v > 0, v).otherwise(F.raise_error(F.lit(f"no variation in the training rows: {name}")).cast("double"))
    out = centred.join(scale, "held").join(place, "held")
    out = out.withColumns({
        **{f"z_{c}": (F.col(f"d_{c}") - F.col(f"m_{c}")) / sure(F.sqrt(F.col(f"s_{c}") - F.col(f"m_{c}") * F.col(f"m_{c}")), c) for c in columns},
        "sx": (F.col("lon") - F.col("m_lon")) / sure(F.col("s_lon"), "lon"), "sy": (F.col("lat") - F.col("m_lat")) / sure(F.col("s_lat"), "lat"),
    })
    return out.select("held", *cells.columns, "sx", "sy", *(f"z_{c}" for c in columns))


@dataclass(frozen=True)
class Candidate:
    """A kernel, a family (adaptive or fixed km) and a bandwidth for each local group."""

    widths: tuple[float, ...]
    kernel: str = "bisquare"
    adaptive: bool = True


def predict_time(rows: pd.DataFrame, groups: Groups, method: str, candidate: Candidate, loo: bool = False) -> np.ndarray:
    """Residual at the held fold's rows of one time (or at its training rows, each left out); NaN where it can't be fitted.

    rows: one held fold's time, with ``train``. Training rows need the residual and all terms; more of them than terms and two.
    """
    local, fixed = groups.design(rows, method)
    train = rows["train"].to_numpy(bool)
    y = (rows["obs"] - rows["product"]).to_numpy(float)
    ok = np.isfinite(fixed).all(axis=1)
    for g in local:
        ok &= np.isfinite(g).all(axis=1)
    use = train & ok & np.isfinite(y)
    at = use if loo else ~train & ok
    out = np.full(len(rows), np.nan)
    if use.sum() <= sum(g.shape[1] for g in local) + fixed.shape[1] + 2 or not at.any():
        return out
    place = rows[["lon", "lat"]].to_numpy(float)
    widths = [min(b, use.sum() - 1) if candidate.adaptive else b for b in candidate.widths]
    value, base, terms = y[use], 0.0, fixed
    if loo and fixed.shape[1]:
        # the left-out station is out of the global terms exactly, and out of the smoothers by their own rule
        base = G.global_ridge(fixed[use], value, fixed[use], groups.ridge, True)
        value, terms = value - base, np.zeros((len(rows), 0))
    options = {"kernel": candidate.kernel, "adaptive": candidate.adaptive, "loo": loo, "ridge": groups.ridge, "tol": groups.tol, "most": groups.most}
    if method == "mgwr":
        found = G.damped(value, place[use], [g[use] for g in local], terms[use], place[at], [g[at] for g in local], terms[at], widths, **options)
    else:
        found = G.mixed(value, place[use], local[0][use], terms[use], place[at], local[0][at], terms[at], widths[0], **options)
    out[at] = found + base
    return out


def predict(rows: DataFrame, groups: Groups, method: str, candidates: list[Candidate], loo: bool = False) -> DataFrame:
    """(held, candidate, station_id, t, obs, product, residual): every candidate on every held fold's time in one pass; rows from ``context``."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("station_id", ignore_index=True)
        part["train"] = part["fold"] != part["held"]
        kept = part["train"] if loo else ~part["train"]
        out = []
        for i, c in enumerate(candidates):
            found = part.loc[kept, ["held", "station_id", "t", "obs", "product"]].copy()
            found["candidate"], found["residual"] = i, predict_time(part, groups, method, c, loo)[kept.to_numpy()]
            out.append(found)
        return pd.concat(out, ignore_index=True)[["held", "candidate", "station_id", "t", "obs", "product", "residual"]]

    ship(rows.sparkSession)
    out = rows.groupBy("held", "t").applyInPandas(one, "held bigint, candidate int, station_id bigint, t bigint, obs double, product double, residual double")
    return out.withColumn("residual", F.when(~F.isnan("residual"), F.col("residual")))


def known(rows: DataFrame) -> DataFrame:
    """What a scan of left-out training rows reads: those with an observation and a product; the others take no part in a fit or a score."""
    return rows.filter("fold <> held AND obs IS NOT NULL AND product IS NOT NULL")


SHRINKS = (0.1, 0.25, 0.5, 0.75, 1.0)


def scan(predicted: DataFrame, shrinks: tuple[float, ...] = SHRINKS) -> DataFrame:
    """(held, candidate, shrink, n, rmse, mae, coverage) of max(product + shrink * residual, 0) on cells with observation and product."""
    tries = predicted.withColumn("shrink", F.explode(F.array(*map(F.lit, shrinks)))).filter("obs IS NOT NULL AND product IS NOT NULL")
    e = F.greatest(F.col("product") + F.col("shrink") * F.col("residual"), F.lit(0.0)) - F.col("obs")
    return tries.groupBy("held", "candidate", "shrink").agg(F.count("residual").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.count("residual") / F.count(F.lit(1))).alias("coverage"))


def best(scanned: DataFrame, least_coverage: float = 0.95, by: tuple[str, ...] = ("held",)) -> DataFrame:
    """The first row of each group by rmse, mae and coverage among those that cover enough."""
    order = Window.partitionBy(*by).orderBy("rmse", "mae", F.col("coverage").desc(), "candidate", *(["shrink"] if "shrink" in scanned.columns else []))
    return scanned.filter(F.col("n") > 0).filter(F.col("coverage") >= least_coverage).withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


@dataclass
class Descent:
    """Coordinate descent over the widths of mgwr's groups: one group at a time, known combinations are not run again."""

    rows: DataFrame
    groups: Groups
    grid: list[float]
    kernel: str = "bisquare"
    adaptive: bool = True
    least_coverage: float = 0.95
    sweeps: int = 5
    known: dict = field(default_factory=dict)

    def scores(self, combinations: list[tuple[float, ...]]) -> None:
        new = [c for c in dict.fromkeys(combinations) if c not in self.known]
        if not new:
            return
        found = scan(predict(known(self.rows), self.groups, "mgwr", [Candidate(c, self.kernel, self.adaptive) for c in new], loo=True), (1.0,))
        total = found.groupBy("candidate").agg(F.sqrt(F.try_divide(F.sum(F.col("n") * F.col("rmse") * F.col("rmse")), F.sum("n"))).alias("rmse"), F.try_divide(F.sum(F.col("n") * F.col("mae")), F.sum("n")).alias("mae"), F.avg("coverage").alias("coverage"))
        got = {r["candidate"]: (r["rmse"], r["mae"], r["coverage"]) for r in total.collect()}  # a row a combination
        for i, c in enumerate(new):
            rmse, mae, coverage = got.get(i, (None, None, 0.0))
            self.known[c] = (rmse, mae) if rmse is not None and coverage >= self.least_coverage else (np.inf, np.inf)

    def run(self) -> tuple[tuple[float, ...], bool]:
        """(widths, settled): starts at the widest; a sweep that changes nothing ends it, ``sweeps`` at most."""
        now = tuple([max(self.grid)] * len(self.groups.names("mgwr")))
        for _ in range(self.sweeps):
            before = now
            for g in range(len(now)):
                tries = [(*now[:g], b, *now[g + 1 :]) for b in self.grid]
                self.scores(tries)
                now = min(tries, key=lambda c: (*self.known[c], c))
            if now == before:
                return now, True
        return now, False


def corrected(rows: DataFrame, groups: Groups, method: str, chosen: DataFrame, candidates: list[Candidate]) -> DataFrame:
    """(station_id, t, y, pred) of the held folds under each one's chosen (held, candidate, shrink)."""
    found = predict(rows, groups, method, candidates).join(chosen.select("held", "candidate", "shrink"), ["held", "candidate"])
    return found.select("station_id", "t", F.col("obs").alias("y"), F.greatest(F.col("product") + F.col("shrink") * F.col("residual"), F.lit(0.0)).alias("pred"))
