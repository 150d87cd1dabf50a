"""Covariate selection on panels: eligible cells, balanced weights, screens with shuffled station blocks, inflation, roles, runs.

Panels are long (station_id, t, lon, lat, period, y, covariates). Sums by pairs of stations are DataFrame work and have a
row a pair of a network; what is shuffled is whole stations, so a shuffle only gathers those sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import regression as G
from ..session import ship
from ..storage import materialise


@dataclass(frozen=True)
class Rules:
    least_hours: int = 5
    least_stations: int = 4
    least_periods: int = 1
    least_hours_a_period: int = 1
    shuffles: int = 999
    level: float = 0.05
    most_vif: float = 5.0
    neighbours: int = 20
    seed: int = 0


def settled(cells: DataFrame, rules: Rules) -> DataFrame:
    """Cells (station_id, t, period, ...) that stay when periods with too few cells, stations with too few cells or periods, and times with too few stations go, until no cell goes."""
    now = materialise(cells, "panel-cells")
    left = now.count()
    while True:
        x = now.withColumn("__p", F.count(F.lit(1)).over(Window.partitionBy("station_id", "period"))).filter(F.col("__p") >= rules.least_hours_a_period).drop("__p")
        enough = x.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("period").alias("k")).filter((F.col("n") >= rules.least_hours) & (F.col("k") >= rules.least_periods)).select("station_id")
        x = x.join(enough, "station_id", "left_semi")
        full = x.groupBy("t").count().filter(F.col("count") >= rules.least_stations).select("t")
        now = materialise(x.join(full, "t", "left_semi").select(cells.columns), "panel-cells")
        before, left = left, now.count()
        if left == before:
            return now


def panel(cells: DataFrame, columns: list[str], rules: Rules, periods: bool = True) -> DataFrame:
    """Settled cells with y and the columns centred on the time's mean, weights w that are equal by period within a station and by station, and the columns scaled by their weighted deviation."""
    x = settled(cells.filter(" AND ".join(f"{c} IS NOT NULL" for c in ["y", *columns])), rules)
    at = Window.partitionBy("t")
    x = x.withColumns({c: F.col(c) - F.avg(c).over(at) for c in ["y", *columns]})
    own = Window.partitionBy("station_id", "period") if periods else Window.partitionBy("station_id")
    share = F.lit(1.0) / F.count(F.lit(1)).over(own)
    if periods:
        held = x.groupBy("station_id").agg(F.count_distinct("period").alias("__k"))
        x = x.join(held, "station_id").withColumn("w", share / F.col("__k")).drop("__k")
    else:
        x = x.withColumn("w", share)
    scale = x.agg(*(v for c in columns for v in ((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m_{c}"), (F.sum(F.col("w") * F.col(c) * F.col(c)) / F.sum("w")).alias(f"q_{c}")))).first()
    for c in columns:
        m, q = scale[f"m_{c}"] or 0.0, scale[f"q_{c}"] or 0.0
        s = np.sqrt(max(q - m * m, 0.0))
        x = x.withColumn(c, (F.col(c) - m) / s if s > 1e-12 else F.lit(None).cast("double"))
    return x


def panel_quality(x: DataFrame, columns: list[str], rules: Rules) -> DataFrame:
    """Counts of a panel and its status."""
    have = [F.count(c).alias(f"known_{c}") for c in columns]
    out = x.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("station_id").alias("stations"), F.count_distinct("t").alias("times"), F.count_distinct("period").alias("periods"), *have)
    ok = F.col("stations") >= rules.least_stations
    for c in columns:
        ok &= F.col(f"known_{c}") > 0
    return out.withColumn("status", F.when(ok, "ok").otherwise("insufficient_stations_or_variation"))


def pair_moments(x: DataFrame, column: str) -> np.ndarray:
    """(stations, stations, 6): n, xy, sx, sy, sxx, syy of station i's y with station j's covariate over their common times, by station id.

    A row a pair of the network comes to the driver.
    """
    a = x.select(F.col("station_id").alias("a"), "t", F.col("y").alias("ya"))
    b = x.select(F.col("station_id").alias("b"), "t", F.col(column).alias("xb")).filter("xb IS NOT NULL")
    sums = a.join(b, "t").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ya") * F.col("xb")).alias("xy"), F.sum("xb").alias("sx"), F.sum("ya").alias("sy"), F.sum(F.col("xb") ** 2).alias("sxx"), F.sum(F.col("ya") ** 2).alias("syy")).toPandas()
    ids = np.unique(np.concatenate([sums["a"], sums["b"]])) if len(sums) else np.zeros(0)
    out = np.zeros((len(ids), len(ids), 6))
    if len(sums):
        out[np.searchsorted(ids, sums["a"]), np.searchsorted(ids, sums["b"])] = sums[["n", "xy", "sx", "sy", "sxx", "syy"]].to_numpy(float)
    return out


def ranked(x: DataFrame, column: str) -> DataFrame:
    """y and the covariate replaced by their ranks (mean of ties) within a time, which its own centring then ends."""
    rank = lambda c: F.rank().over(Window.partitionBy("t").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("t", c)) - 1) / 2
    out = x.filter(F.col(column).isNotNull()).withColumns({"ry": rank("y"), "rx": rank(column)})
    at = Window.partitionBy("t")
    return out.withColumns({"y": F.col("ry") - F.avg("ry").over(at), column: F.col("rx") - F.avg("rx").over(at)})


def adjusted(p: np.ndarray) -> np.ndarray:
    """Benjamini and Hochberg's q."""
    order = np.argsort(p, kind="stable")
    q = np.empty(len(p))
    q[order] = np.minimum(np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1) if len(p) else []
    return q


def screen(x: DataFrame, columns: list[str], rules: Rules) -> pd.DataFrame:
    """candidate, r, rho, p, q, direction, selected: station blocks are shuffled; selected where q is below the level and r and rho have one sign."""
    rows = []
    for i, c in enumerate(columns):
        r, p = G.block_pvalue(pair_moments(x, c), rules.shuffles, rules.seed + i)
        moments = pair_moments(ranked(x, c), c)
        rho = G.shuffled_moments(moments, np.arange(len(moments))) if len(moments) else 0.0
        rows.append((c, r, rho, p))
    out = pd.DataFrame(rows, columns=["candidate", "r", "rho", "p"])
    out["q"] = adjusted(out["p"].to_numpy())
    out["direction"] = np.where(out["r"] > 0, "positive", np.where(out["r"] < 0, "negative", "none"))
    out["selected"] = (out["q"] < rules.level) & (out["r"] * out["rho"] > 0)
    return out


def weighted_vifs(x: DataFrame, columns: list[str]) -> np.ndarray:
    """Inflation of each column from one aggregate of weighted products."""
    n = len(columns)
    sums = [F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)] + [F.sum(F.col("w") * F.col(a)).alias(f"m{i}") for i, a in enumerate(columns)]
    row = x.filter(" AND ".join(f"{c} IS NOT NULL" for c in columns)).agg(F.sum("w").alias("w"), *sums).first()
    if not row["w"]:
        return np.full(n, np.nan)
    m = np.array([row[f"m{i}"] for i in range(n)]) / row["w"]
    cov = np.array([[row[f"c{i}_{j}"] for j in range(n)] for i in range(n)]) / row["w"] - np.outer(m, m)
    s = np.sqrt(np.maximum(np.diag(cov), 1e-30))
    return np.diag(np.linalg.pinv(cov / np.outer(s, s)))


def pruned(x: DataFrame, groups: dict[str, list[str]], q: dict[str, float], rules: Rules) -> tuple[list[str], list[dict]]:
    """(groups left, steps): the group with the largest inflation goes (ties: the larger q, then the later one) until all are below the limit."""
    left, steps = list(groups), []
    while left:
        columns = [c for g in left for c in groups[g]]
        v = dict(zip(columns, weighted_vifs(x, columns), strict=True))
        worst = {g: max(v[c] for c in groups[g]) for g in left}
        steps.append({"groups": list(left), "vif": worst})
        if len(left) == 1 or max(worst.values()) < rules.most_vif:
            return left, steps
        left.remove(max(left, key=lambda g: (round(worst[g], 9), q.get(g, 1.0), left.index(g))))
    return left, steps


def sufficient(x: DataFrame, column: str) -> pd.DataFrame:
    """(station_id, lon, lat, sw, sx, sy, sxx, sxy): weighted sums by station; all that local slopes need."""
    w = F.col("w")
    return x.filter(F.col(column).isNotNull()).groupBy("station_id").agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"), F.sum(w).alias("sw"), F.sum(w * F.col(column)).alias("sx"), F.sum(w * F.col("y")).alias("sy"), F.sum(w * F.col(column) ** 2).alias("sxx"), F.sum(w * F.col(column) * F.col("y")).alias("sxy"), F.sum(w * F.col("y") ** 2).alias("syy")).orderBy("station_id").toPandas()


def local_slopes(w: np.ndarray, sums: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """(intercept, slope) at each station from its neighbours' sums (sw, sx, sy, sxx, sxy)."""
    sw, sx, sy, sxx, sxy = (w @ sums[:, i] for i in range(5))
    det = (sw + ridge) * (sxx + ridge) - sx * sx
    return np.column_stack([(sy * (sxx + ridge) - sx * sxy) / det, ((sw + ridge) * sxy - sx * sy) / det])


def panel_loocv(sums: np.ndarray, syy: np.ndarray, d: np.ndarray, k: int) -> float:
    """Weighted error of each station by the fit of its neighbours without it."""
    b = local_slopes(G.weights_panel(d, k, True), sums)
    sw, sx, sy, sxx, sxy = sums.T
    sse = syy - 2 * (b[:, 0] * sy + b[:, 1] * sxy) + b[:, 0] ** 2 * sw + 2 * b[:, 0] * b[:, 1] * sx + b[:, 1] ** 2 * sxx
    return float(np.sqrt(max(sse.sum(), 0) / sw.sum()))


ROLE = "candidate string, neighbours int, variance double, p double"


def variability(x: DataFrame, columns: list[str], rules: Rules, widths: tuple[int, ...] = (8, 12, 20)) -> pd.DataFrame:
    """candidate, neighbours, variance, p, q, role: do local slopes vary more than with stations' places shuffled? Role local where q is below the level.

    The neighbour count is the one with the least left-out error. Candidates are groups of their own and run side by side.
    """
    parts = [sufficient(x, c).assign(candidate=c) for c in columns]
    if not parts or not len(pd.concat(parts)):
        return pd.DataFrame(columns=["candidate", "neighbours", "variance", "p", "q", "role"])
    spark = x.sparkSession
    seeds = {c: rules.seed + i for i, c in enumerate(columns)}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("station_id", ignore_index=True)
        place = rows[["lon", "lat"]].to_numpy(float)
        sums = rows[["sw", "sx", "sy", "sxx", "sxy"]].to_numpy(float)
        d = L.haversine_km(place, place, 6371.0088)
        usable = [k for k in widths if k < len(rows)] or [max(len(rows) - 1, 1)]
        k = min(usable, key=lambda v: (panel_loocv(sums, rows["syy"].to_numpy(float), d, v), v))
        w = G.weights_panel(d, k)
        observed = float(np.var(local_slopes(w, sums)[:, 1]))
        rng = np.random.default_rng(seeds[rows["candidate"].iloc[0]])
        above = sum(np.var(local_slopes(w, sums[rng.permutation(len(sums))])[:, 1]) >= observed for _ in range(rules.shuffles))
        return pd.DataFrame({"candidate": [rows["candidate"].iloc[0]], "neighbours": [k], "variance": [observed], "p": [(above + 1) / (rules.shuffles + 1)]})

    ship(spark)
    out = spark.createDataFrame(pd.concat(parts, ignore_index=True)).groupBy("candidate").applyInPandas(one, ROLE).toPandas()  # a row a candidate
    out["q"] = adjusted(out["p"].to_numpy())
    out["role"] = np.where(out["q"] < rules.level, "local", "global")
    return out


def select(cells: DataFrame, groups: dict[str, list[str]], rules: Rules = Rules(), periods: bool = True) -> pd.DataFrame:
    """One row a group: screen, inflation among the selected, role of what is left, and whether it is included.

    A group of several columns is screened by its best one. An insufficient panel gives rows with its status and nothing selected.
    """
    columns = [c for g in groups.values() for c in g]
    x = materialise(panel(cells, columns, rules, periods), "panel")
    status = panel_quality(x, columns, rules).first()["status"]
    blank = pd.DataFrame({"group": list(groups), "status": status, "selected": False, "vif_retained": False, "role": None, "included": False})
    if status != "ok":
        return blank
    found = screen(x, columns, rules).set_index("candidate")
    q = {g: float(found.loc[list(cs), "q"].min()) for g, cs in groups.items()}
    chosen = {g: cs for g, cs in groups.items() if found.loc[list(cs), "selected"].any()}
    left, _ = pruned(x, chosen, q, rules) if chosen else ([], [])
    roles = variability(x, [c for g in left for c in chosen[g]], rules).set_index("candidate")["role"] if left else {}
    out = blank.copy()
    out["q"] = [q[g] for g in groups]
    out["r"] = [float(found.loc[list(cs), "r"].iloc[int(np.argmin(found.loc[list(cs), "q"]))]) for cs in groups.values()]
    out["selected"] = [g in chosen for g in groups]
    out["vif_retained"] = [g in left for g in groups]
    out["role"] = ["local" if g in left and any(roles.get(c) == "local" for c in groups[g]) else "global" if g in left else None for g in groups]
    out["included"] = out["vif_retained"]
    return out


def stamped(rows: pd.DataFrame, **values) -> pd.DataFrame:
    """The rows with tags in front, in their order."""
    out = rows.copy()
    for i, (name, value) in enumerate(values.items()):
        out.insert(i, name, value)
    return out


def run(cells: DataFrame, groups: dict[str, list[str]], products: list[str], folds: int = 0, rules: Rules = Rules(), periods: bool = True) -> pd.DataFrame:
    """Selection of every product with all stations and, for each of ``folds`` folds, without its stations. cells: (product, fold, ...) panels."""
    out = []
    for product in products:
        own = cells.filter(F.col("product_name") == product)
        out.append(stamped(select(own, groups, rules, periods), product=product, scheme="full", fold=0))
        for f in range(1, folds + 1):
            out.append(stamped(select(own.filter(F.col("fold") != f), groups, rules, periods), product=product, scheme="fold_out", fold=f))
    return pd.concat(out, ignore_index=True)


def terrain_screen(stations: pd.DataFrame, response: str, groups: dict[str, list[str]], rules: Rules = Rules()) -> pd.DataFrame:
    """Screen of station values: Pearson and rank correlation for a single column, a joint F for a group of several; q over groups, inflation by group.

    A single column needs r and rho whose product is not below 0; constant columns fail with their reason.
    """
    y, rows = stations[response].to_numpy(float), []
    corr = lambda a, b: float(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else np.nan
    rank = lambda v: pd.Series(v).rank().to_numpy()
    for i, (g, columns) in enumerate(groups.items()):
        x = stations[columns].to_numpy(float)
        if not np.isfinite(x).all() or (x.std(axis=0) == 0).any():
            rows.append((g, np.nan, np.nan, 1.0, "constant or missing column"))
        elif len(columns) == 1:
            r, rho = corr(x[:, 0], y), corr(rank(x[:, 0]), rank(y))
            rows.append((g, r, rho, L.permutation_pvalue(corr, x[:, 0], y, rules.shuffles, rules.seed + i), None))
        else:
            rows.append((g, L.joint_f(x, y), np.nan, L.permutation_pvalue(L.joint_f, x, y, rules.shuffles, rules.seed + i), None))
    out = pd.DataFrame(rows, columns=["group", "statistic", "rho", "p", "failed"])
    out["q"] = adjusted(out["p"].to_numpy())
    single = np.array([len(groups[g]) == 1 for g in out["group"]])
    agrees = ~single | (out["statistic"] * out["rho"] >= 0).to_numpy()
    out["selected"] = (out["q"] < rules.level) & agrees & out["failed"].isna()
    left = out.loc[out["selected"], "group"].tolist()
    q = dict(zip(out["group"], out["q"], strict=True))
    while len(left) > 1:
        columns = [c for g in left for c in groups[g]]
        v = dict(zip(columns, L.vif(stations[columns].to_numpy(float)), strict=True))
        worst = {g: max(v[c] for c in groups[g]) for g in left}
        if max(worst.values()) < rules.most_vif:
            break
        left.remove(max(left, key=lambda g: (round(worst[g], 9), q[g], left.index(g))))
    out["kept"] = out["group"].isin(left)
    return out
