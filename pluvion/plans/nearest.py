"""Plans of queries whose neighbours are too many for a join: lists of the nearest in Python workers; their SQL is beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.dialect import SPARK, frame
from ..operators import nearest as N
from ..operators import relational as R
from ..operators import spatial as O
from ..storage import materialise
from . import adapter as A
from . import diagnostics as D
from . import evaluation, models, spatial  # noqa: F401  their SQL is registered first
from .catalogue import runs, tables


def _cells(spark, sf_dir, value, columns=""):
    steps = (A.stations(), lambda d: A.panel(d), O.strip_folds())
    text = lambda d: A.sql(*(x(d) if callable(x) else x for x in steps), select=f"SELECT p.station_id, p.t, f.fold, f.lon, f.lat, {value} AS y{columns} FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id")
    return frame(spark, text, **tables(spark, sf_dir, "events"))


@runs("residual_scan_best")
def scan_best(spark, sf_dir):
    tries = [(k, r) for k in (8, 12, 20) for r in (1e-4, 1e-2)]
    found = materialise(N.plane_scan(_cells(spark, sf_dir, "p.obs - p.a"), tries), "scan")
    parts = [f"SELECT {k} AS k, {S.num(ridge)} AS ridge, {R.scores('y0', f'p{i}')}, round(avg(CASE WHEN p{i} IS NULL THEN 0e0 ELSE 1e0 END), 6) AS coverage FROM {{found}}" for i, (k, ridge) in enumerate(tries)]
    return frame(spark, lambda d: A.sql(f"scan AS ({' UNION ALL '.join(parts)})", select="SELECT CAST(k AS BIGINT) AS k, ridge, n, rmse, mae, coverage FROM (SELECT *, row_number() OVER (ORDER BY rmse, mae, -coverage, ridge, k) AS rn FROM scan WHERE coverage >= 0.3e0) AS s WHERE rn = 1"), found=found)


@runs("spatial_holdout")
def spatial_holdout(spark, sf_dir):
    cells = materialise(_cells(spark, sf_dir, "p.obs - p.a", ", p.obs, p.a"), "cells")
    fixed = materialise(N.plane_held_out(cells, 12), "held-out").select("station_id", "t", "pred")
    x = materialise(cells.join(fixed, ["station_id", "t"]).select("fold", "obs", "a", (F.col("a") + F.col("pred")).alias("fixed")), "fixed")
    return frame(spark, lambda d: A.sql("x AS (SELECT * FROM {x})", select=D._HOLDOUT_SCORES), x=x)


@runs("nested_bandwidth_cv")
def nested(spark, sf_dir):
    tried = materialise(N.inverse_held_out(_cells(spark, sf_dir, "p.obs"), (4, 8, 16)), "tried")
    return frame(spark, lambda d: A.sql("tried AS (SELECT * FROM {tried})", *D._NESTED_STEPS, select=D._NESTED_SCORES), tried=tried)


@runs("fusion_lag_neighbour_features")
def lag_features(spark, sf_dir):
    events = tables(spark, sf_dir, "events")
    stations = materialise(frame(spark, lambda d: A.sql(A.stations(), select="SELECT station_id, lon, lat FROM stations"), **events), "stations")
    seen = f"SELECT user_id AS station_id, {SPARK.hour_index('ts')} AS h, coalesce(sum(CASE WHEN event_type = 'view' THEN value END), 0) / 10 AS a, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS bad FROM {{events}} GROUP BY 1, 2"
    found = N.hour_features(stations, materialise(frame(spark, lambda d: seen, **events), "seen"))
    return found.select("station_id", "h", *(F.round(c, 6).alias(c) for c in ("a", "before", "after", "around")))
