"""Queries of the models that run as grouped maps; SQL prepares their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.dialect import frame
from ..operators import benchmark as B
from ..operators import hurdle as H
from ..operators import joint as J
from ..operators import models as M
from ..operators import nearest
from ..operators import relational as R
from ..operators import selection as N
from ..operators import spatial as O
from ..storage import materialise
from . import adapter as A
from .catalogue import query, tables

_ALL = "obs IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL"


def _frame(spark, sf_dir, *steps, select):
    return frame(spark, lambda d: A.sql(A.stations(), A.panel(d), *steps, select=select), **tables(spark, sf_dir, "events"))


def _cells(spark, sf_dir):
    return _frame(spark, sf_dir, O.strip_folds(), select=f"SELECT p.station_id, p.t, f.fold, f.lon, f.lat, p.obs AS y, coalesce(p.a, 0e0) AS a, coalesce(p.b, 0e0) AS b, coalesce(p.c, 0e0) AS c FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id WHERE p.obs IS NOT NULL")


@query("tps_loo")
def tps_loo(spark, sf_dir):
    return M.tps_loo(_cells(spark, sf_dir))


@query("tps")
def tps(spark, sf_dir):
    return M.tps_folds(_cells(spark, sf_dir))


@query("mixed_gwr")
def mixed(spark, sf_dir):
    return M.mixed_gwr(_cells(spark, sf_dir), ["a"], ["b"])


@query("mgwr")
def mgwr(spark, sf_dir):
    return M.multiscale_gwr(_cells(spark, sf_dir), ["a"], [20, 12])


@query("gwr_calib")
def gwr_calib(spark, sf_dir):
    return M.gwr_calibration(_cells(spark, sf_dir), ["a", "b"])


@query("stack_nnls")
def stack_nnls(spark, sf_dir):
    band = S.agreement_band(("a", "b"))
    return M.stack_weights(_frame(spark, sf_dir, f"x AS (SELECT *, {band} AS band FROM panel WHERE {_ALL})", select=f"SELECT band, {R.gram(['1e0', 'a', 'b'], 'obs')} FROM x GROUP BY band"), 3)


@query("hurdle_gwr")
def hurdle(spark, sf_dir):
    x = ["1e0", "(ln(1 + coalesce(a, 0e0)) - 1e0)"]
    wet = f"obs >= {S.num(S.WET)}"
    gram = ", ".join(f"sum(CASE WHEN {wet} THEN {p} * {q} ELSE 0e0 END)" for p in x for q in x)
    rhs = ", ".join(f"sum(CASE WHEN {wet} THEN {p} * ln(1 + obs) ELSE 0e0 END)" for p in x)
    own = _frame(
        spark, sf_dir,
        f"own AS (SELECT station_id, array({gram}) AS gram, array({rhs}) AS rhs, sum(CASE WHEN {wet} THEN power(ln(1 + obs), 2) ELSE 0e0 END) AS yy, sum(CASE WHEN {wet} THEN 1e0 ELSE 0e0 END) AS wet, CAST(count(*) AS DOUBLE) AS n FROM panel GROUP BY station_id)",
        select="SELECT o.*, s.lon, s.lat FROM own AS o JOIN stations AS s ON o.station_id = s.station_id",
    )
    return nearest.hurdle(own, 2)


@query("hilbert_folds")
def hilbert_folds(spark, sf_dir):
    return M.folds(_frame(spark, sf_dir, select="SELECT station_id, lon, lat FROM stations"))


@query("day_block_bootstrap")
def bootstrap(spark, sf_dir):
    return M.bootstrap_delta(
        _frame(spark, sf_dir, O.strip_folds(), select=f"SELECT CAST(f.fold AS STRING) AS stratum, p.t, count(*) AS n, sum(power(p.a - p.obs, 2)) AS sse_a, sum(power(p.b - p.obs, 2)) AS sse_b FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id WHERE {_ALL} GROUP BY 1, 2"),
        "stratum",
    )


@query("select_joint_covariates")
def select_covariates(spark, sf_dir):
    rows = _frame(spark, sf_dir, select="SELECT p.station_id, avg(p.obs) AS y, avg(p.a) AS a, avg(p.b) AS b, avg(p.c) AS c, max(s.lon) AS lon, max(s.lat) AS lat FROM panel AS p JOIN stations AS s ON p.station_id = s.station_id GROUP BY p.station_id HAVING avg(p.obs) IS NOT NULL AND avg(p.a) IS NOT NULL AND avg(p.b) IS NOT NULL AND avg(p.c) IS NOT NULL")
    return M.select_covariates(rows, "y", ["a", "b", "c", "lon", "lat"]).orderBy(F.col("candidate"))


@query("benchmark_smoke")
def benchmark(spark, sf_dir):
    """Cross-validated scores of several methods on the cells that all of them predict."""
    from functools import reduce

    cells = _cells(spark, sf_dir)
    parts = [M.tps_folds(cells).withColumn("method", F.lit("tps")), M.mixed_gwr(cells, ["a"], ["b"]).withColumn("method", F.lit("mixed_gwr")), cells.select("station_id", "t", "y", F.col("a").alias("pred"), F.lit("raw").alias("method"))]
    tall = reduce(lambda x, y: x.unionByName(y), parts).filter("pred IS NOT NULL").withColumn("pred", F.greatest("pred", F.lit(0.0)))
    whole = tall.groupBy("station_id", "t").agg(F.count("*").alias("n")).filter(F.col("n") == len(parts)).select("station_id", "t")
    e = F.col("pred") - F.col("y")
    return tall.join(whole, ["station_id", "t"]).groupBy("method").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"), F.round(F.avg(F.abs(e)), 5).alias("mae"), F.round(F.avg(e), 5).alias("bias"))


@query("joint_residual_gwr")
def joint_residual_gwr(spark, sf_dir):
    from .diagnostics import _CONTEXT_CELLS

    return M.joint_residual(_frame(spark, sf_dir, O.strip_folds(), _CONTEXT_CELLS, O.joint_context(), select="SELECT c.*, f.lon, f.lat FROM context AS c JOIN folds AS f ON c.station_id = f.station_id WHERE c.z IS NOT NULL"))


@query("spatial_variability")
def variability(spark, sf_dir):
    rows = _frame(spark, sf_dir, select="SELECT p.station_id, avg(p.obs) AS y, avg(p.a) AS a, avg(p.b) AS b, max(s.lon) AS lon, max(s.lat) AS lat FROM panel AS p JOIN stations AS s ON p.station_id = s.station_id GROUP BY p.station_id HAVING avg(p.obs) IS NOT NULL AND avg(p.a) IS NOT NULL AND avg(p.b) IS NOT NULL")
    return M.spatial_variability(rows, "y", ["a", "b"])


# --- nested benchmark, joint covariates, hurdle, selection and fusion over the driver's panel


def _product(spark, sf_dir):
    return _frame(spark, sf_dir, select="SELECT station_id, t, obs, a AS product FROM panel WHERE obs IS NOT NULL OR a IS NOT NULL")


def _stations(spark, sf_dir):
    return _frame(spark, sf_dir, select="SELECT station_id, lon, lat FROM stations")


_METHODS = ("idw", "tps", "gwr", "residual_gwr")
_CONFIG = B.Config(powers=(1.0, 2.0), neighbours=(8, None), smooths=(1e-2, 1.0), adaptive=(12, 20), fixed=(50.0,), least_coverage=0.2)


@query("nested_benchmark")
def nested_benchmark(spark, sf_dir):
    """Methods tuned on inner folds, scored on the cells that all predict, with the null predictors and the automatic choice."""
    run = B.run(_product(spark, sf_dir), _stations(spark, sf_dir), _CONFIG, _METHODS)
    return B.method_scores(run, ("raw", *_METHODS))


@query("benchmark_status")
def benchmark_status(spark, sf_dir):
    """Status of each method and held fold, with what was chosen."""
    return B.run(_product(spark, sf_dir), _stations(spark, sf_dir), _CONFIG, ("idw", "residual_gwr")).status


@query("candidate_scan")
def candidate_scan(spark, sf_dir):
    """Every candidate of inverse and angular distance on the inner folds."""
    from functools import reduce

    places = B.split(_stations(spark, sf_dir), _CONFIG)
    cells = _product(spark, sf_dir).join(places, "station_id")
    parts = [B.scores(B.tried(cells, m, B.grid(_CONFIG, m), False, True, scored=True), "held", "candidate").withColumn("method", F.lit(m)) for m in ("idw", "adw")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("selection_folds")
def selection_folds(spark, sf_dir):
    """Outer and inner fold of each station under each held fold."""
    return B.split(_stations(spark, sf_dir), _CONFIG)


def _joint_cells(spark, sf_dir):
    return _frame(spark, sf_dir, O.strip_folds(), select="SELECT p.station_id, p.t, f.fold, f.lon, f.lat, p.obs, p.a AS product, coalesce(p.b, 0e0) AS b, coalesce(p.c, 0e0) AS c, CAST(FLOOR(p.t / 16e0) AS BIGINT) AS period FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id")


_GROUPS = J.Groups({"b": ("b",), "c": ("c",)}, {"b": "local", "c": "global"}, ridge=1e-4, most=200)


@query("joint_context")
def joint_context(spark, sf_dir):
    """Covariates of two groups as each held fold's training rows scale them."""
    return J.context(_joint_cells(spark, sf_dir), _GROUPS, period="period").select("held", "station_id", "t", "sx", "sy", "z_b", "z_c")


@query("joint_prediction")
def joint_prediction(spark, sf_dir):
    """Residual, mixed and multiscale models on two covariate groups with roles: tuned by leaving training stations out, scored on the held folds."""
    from functools import reduce

    rows = materialise(J.context(_joint_cells(spark, sf_dir), _GROUPS, period="period"), "joint")
    parts = []
    for method in J.METHODS:
        widths = len(_GROUPS.names(method))
        candidates = [J.Candidate((k,) * widths) for k in (12, 20)]
        picked = J.best(J.scan(J.predict(J.known(rows), _GROUPS, method, candidates, loo=True)), 0.0)
        parts.append(J.corrected(rows, _GROUPS, method, picked, candidates).withColumn("method", F.lit(method)))
    e = F.col("pred") - F.col("y")
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("method").agg(F.count("pred").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"))


@query("joint_descent")
def joint_descent(spark, sf_dir):
    """Widths of the multiscale model's groups by coordinate descent, over all held folds."""
    rows = materialise(J.context(_joint_cells(spark, sf_dir), _GROUPS, period="period"), "joint")
    groups = _GROUPS.names("mgwr")
    widths, settled = J.Descent(rows, _GROUPS, [12, 20], least_coverage=0.0, sweeps=2).run()
    return spark.createDataFrame([(g, float(w), settled) for g, w in zip(groups, widths, strict=True)], "group string, neighbours double, settled boolean")


@query("hurdle_prediction")
def hurdle_prediction(spark, sf_dir):
    """Wet chance, amount and their product for every cell, each station left out of its own fit."""
    cells = _frame(spark, sf_dir, select="SELECT p.station_id, s.lon, s.lat, timestamp_seconds(p.t * 86400) AS ts, p.obs, p.a AS product FROM panel AS p JOIN stations AS s ON p.station_id = s.station_id")
    model = H.Hurdle(bandwidth=H.FixedBandwidth(80.0), least_samples=20, least_stations=4, diurnal=False, most=500.0)
    return H.predict(H.fit(cells, model), cells, leave_out=True)


@query("panel_selection")
def panel_selection(spark, sf_dir):
    """Covariates of the residual: settled panel, screen with shuffled station blocks, inflation, role."""
    cells = _frame(spark, sf_dir, O.strip_folds(), select="SELECT p.station_id, p.t, CAST(FLOOR(p.t / 16e0) AS BIGINT) AS period, f.fold, f.lon, f.lat, p.obs - p.a AS y, p.a, coalesce(p.b, 0e0) AS b, coalesce(p.c, 0e0) AS c FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id WHERE p.obs IS NOT NULL AND p.a IS NOT NULL")
    found = N.select(cells, {"a": ["a"], "b": ["b"], "c": ["c"]}, N.Rules(least_hours=3, least_stations=4, shuffles=199))
    for column in ("q", "r"):
        found[column] = found[column].round(6) if column in found else None
    return spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in found[["group", "status", "selected", "vif_retained", "role", "included", "q", "r"]].astype(object).itertuples(index=False)], "group string, status string, selected boolean, vif_retained boolean, role string, included boolean, q double, r double")


@query("settled_panel")
def settled_panel(spark, sf_dir):
    """Cells left when thin periods, stations and times go until none does."""
    cells = _frame(spark, sf_dir, select="SELECT station_id, t, CAST(FLOOR(t / 16e0) AS BIGINT) AS period FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL")
    return N.settled(cells, N.Rules(least_hours=4, least_stations=4, least_periods=2))


def _fusion_rows(spark, sf_dir):
    band = S.agreement_band(("a", "b"))
    return _frame(spark, sf_dir, O.strip_folds(), select=f"SELECT p.station_id, p.t, f.fold, {band} AS band, p.obs, p.a, p.b FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id WHERE {_ALL}")


@query("banded_fusion")
def banded_fusion(spark, sf_dir):
    """Fused value of every cell by the other folds' coefficients of its band, or of all bands where those are too few; not below 0."""
    rows = materialise(_fusion_rows(spark, sf_dir), "fusion")
    weights = B.banded_coefficients(rows, ["a", "b"], 200)
    table = spark.createDataFrame([(f, k, [float(x) for x in v]) for (f, k), v in weights.items() if k is not None], "fold bigint, band bigint, w array<double>")
    out = rows.join(table, ["fold", "band"])
    return out.select("station_id", "t", "obs", F.round(F.greatest(F.col("w")[0] + F.col("w")[1] * F.col("a") + F.col("w")[2] * F.col("b"), F.lit(0.0)), 6).alias("fused"))


@query("quantile_map")
def quantile_map(spark, sf_dir):
    """Product values at the observation's quantile, by the other folds' quantiles."""
    return B.quantile_mapped(_fusion_rows(spark, sf_dir), "a").select("station_id", "t", F.round("a", 6).alias("a"), F.round("mapped", 6).alias("mapped"))


@query("banded_blend_weights")
def banded_blend(spark, sf_dir):
    """Weight of the second source by held fold and band, from the other folds; all bands at 0 where none is given."""
    rows = _fusion_rows(spark, sf_dir)
    inner = rows.join(rows.select(F.col("fold").alias("held")).distinct(), F.col("held") != F.col("fold")).withColumn("product", F.col("a"))
    return B.blend_weight(inner, "a", "b", band="band")
