"""Queries of distances, neighbours and interpolation."""

from __future__ import annotations

from ..functions import scalar as S
from ..operators import relational as R
from ..operators import spatial as O
from . import adapter as A
from .catalogue import sql_query

_CELLS = "cells AS (SELECT station_id, t, obs AS y FROM panel)"
_RESIDUAL = "cells AS (SELECT station_id, t, obs - a AS y FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL)"


def _predictions(d, *steps, name, cells=_CELLS):
    return A.sql(A.stations(), A.panel(d), cells, O.pairs(), *steps, select=f"SELECT target, t, round(y0, 6) AS y0, round(pred, 6) AS pred FROM {name}")


@sql_query("haversine_pairs", "events")
def haversine_pairs(d):
    return A.sql(A.stations(), O.pairs(), select="SELECT target, source, round(km, 6) AS km, round(e, 6) AS e, round(n, 6) AS n FROM pairs WHERE target < source")


@sql_query("knn_reporting", "events")
def knn_reporting(d):
    return A.sql(A.stations(), A.panel(d), _CELLS, O.pairs(), O.candidates(4), select="SELECT target, t, CAST(rn AS BIGINT) AS rn, source, round(km, 6) AS km, round(y, 6) AS y FROM near")


for _k, _name in ((None, "all"), (8, "k8")):
    sql_query(f"idw_{_name}", "events")(lambda d, k=_k: _predictions(d, O.candidates(k), O.idw(), name="idw"))
    sql_query(f"adw_{_name}", "events")(lambda d, k=_k: _predictions(d, O.candidates(k), O.adw(), name="adw"))

for _kernel in S.KERNELS:
    sql_query(f"kernel_weights_{_kernel}", "events")(
        lambda d, kernel=_kernel: A.sql(
            A.stations(), O.pairs(),
            select=f"SELECT target, source, round({S.kernel(kernel, 'km', S.num(50.0))}, 6) AS fixed, round({S.kernel(kernel, 'km', 'bw')}, 6) AS adaptive FROM "
            "(SELECT *, max(CASE WHEN rn <= 10 THEN km END) OVER (PARTITION BY target) AS bw FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY km, source) AS rn FROM pairs) AS r) AS w",
        )
    )


@sql_query("adaptive_bandwidth", "events")
def adaptive_bandwidth(d):
    return A.sql(A.stations(), A.panel(d), _CELLS, O.pairs(), O.candidates(12), O.weights("bisquare", 12), select="SELECT target, t, round(bw, 6) AS bw FROM width")


@sql_query("local_linear_residual", "events")
def local_linear_residual(d):
    return A.sql(
        A.stations(), A.panel(d), _RESIDUAL, O.pairs(), O.candidates(12), O.weights("bisquare", 12), O.local_linear(),
        select="SELECT l.target, l.t, round(p.obs, 6) AS obs, round(p.a, 6) AS product, round(p.a + l.pred, 6) AS corrected FROM local AS l JOIN panel AS p ON l.target = p.station_id AND l.t = p.t",
    )


@sql_query("bench_flagship", "events")
def bench_flagship(d):
    """Leave-one-out residual correction and its scores by station."""
    return A.sql(
        A.stations(), A.panel(d), _RESIDUAL, O.pairs(), O.candidates(12), O.weights("bisquare", 12), O.local_linear(),
        "fixed AS (SELECT l.target, p.obs, p.a + l.pred AS pred FROM local AS l JOIN panel AS p ON l.target = p.station_id AND l.t = p.t)",
        select=f"SELECT target, {R.scores('obs', 'pred')} FROM fixed GROUP BY target",
    )


@sql_query("gwr_direct_p3", "events")
def gwr_direct(d):
    return _predictions(d, O.candidates(), O.weights("gaussian", 12), O.gwr(1e-4), name="gwr")


@sql_query("gwr_residual_p3", "events")
def gwr_residual(d):
    return _predictions(d, O.candidates(), O.weights("exponential", None, 40.0), O.gwr(1e-4), name="gwr", cells=_RESIDUAL)


@sql_query("residual_scan_best", "events")
def scan_best(d):
    """Bandwidths and ridges scored leave-one-out; the best by rmse, mae among those of enough coverage."""
    tries, parts = [], []
    for i, (k, ridge) in enumerate((k, r) for k in (8, 12, 20) for r in (1e-4, 1e-2)):
        steps = ", ".join((O.weights("bisquare", k), O.local_linear(ridge)))
        for name in ("width", "weighted", "share", "moments", "scaled", "local"):
            steps = steps.replace(f"{name} AS (", f"{name}{i} AS (").replace(f"FROM {name} ", f"FROM {name}{i} ").replace(f"JOIN {name} ", f"JOIN {name}{i} ").replace(f"FROM {name})", f"FROM {name}{i})")
        tries.append(steps)
        parts.append(f"SELECT {k} AS k, {S.num(ridge)} AS ridge, {R.scores('y0', 'pred')}, round(avg(CASE WHEN pred IS NULL THEN 0e0 ELSE 1e0 END), 6) AS coverage FROM local{i}")
    return A.sql(
        A.stations(), A.panel(d), _RESIDUAL, O.pairs(), O.candidates(20), *tries, f"scan AS ({' UNION ALL '.join(parts)})",
        select="SELECT CAST(k AS BIGINT) AS k, ridge, n, rmse, mae, coverage FROM (SELECT *, row_number() OVER (ORDER BY rmse, mae, -coverage, ridge, k) AS rn FROM scan WHERE coverage >= 0.3e0) AS s WHERE rn = 1",
    )


@sql_query("nearest_train_km", "events")
def nearest_train_km(d):
    return A.sql(
        A.stations(), O.pairs(), O.strip_folds(),
        select="SELECT p.target, max(a.fold) AS fold, round(min(p.km), 6) AS km FROM pairs AS p JOIN folds AS a ON p.target = a.station_id JOIN folds AS b ON p.source = b.station_id WHERE a.fold <> b.fold GROUP BY p.target",
    )


@sql_query("radius_neighbour_share", "events")
def radius_neighbour_share(d):
    return A.sql(
        A.stations(), A.panel(d), _CELLS, O.pairs(),
        select=f"SELECT p.target, r.t, CAST(count(*) AS BIGINT) AS neighbours, round(avg(CASE WHEN r.y >= {S.num(5.0)} THEN 1e0 ELSE 0e0 END), 6) AS share FROM pairs AS p JOIN cells AS r ON p.source = r.station_id WHERE p.km <= 15e0 AND r.y IS NOT NULL GROUP BY p.target, r.t",
    )


@sql_query("pair_band_baseline", "events")
def pair_band_baseline(d):
    edges = S.PAIR_EDGES_KM
    return A.sql(
        A.stations(), A.panel(d), _CELLS, O.pairs(),
        f"banded AS (SELECT target, source, {S.classed('km', edges[1:])} AS band FROM pairs WHERE km <= {S.num(edges[-1])})",
        select=f"SELECT b.band, {R.scores('x.y', 'y.y')} FROM banded AS b JOIN cells AS x ON b.target = x.station_id JOIN cells AS y ON b.source = y.station_id AND x.t = y.t GROUP BY b.band",
    )


@sql_query("idw_surface", "events")
def idw_surface(d):
    """The network's mean field on a grid over the box."""
    km = S.haversine("g.lon", "g.lat", "s.lon", "s.lat")
    return A.sql(
        A.stations(), A.panel(d), "field AS (SELECT station_id, avg(obs) AS y FROM panel GROUP BY station_id)",
        f"ix AS (SELECT {d.series('0', '10')} AS i)", f"iy AS (SELECT {d.series('0', '10')} AS j)",
        "cells_of AS (SELECT i, j, 109.4e0 + 0.22e0 * i AS lon, 31.2e0 + 0.22e0 * j AS lat FROM ix CROSS JOIN iy)",
        f"met AS (SELECT g.i, g.j, f.y, {km} AS km FROM cells_of AS g CROSS JOIN stations AS s JOIN field AS f ON s.station_id = f.station_id WHERE f.y IS NOT NULL)",
        select="SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(sum(y / greatest(km * km, 1e-12)) / sum(1 / greatest(km * km, 1e-12)), 6) AS z FROM met GROUP BY i, j",
    )


@sql_query("fold_strip", "events")
def fold_strip(d):
    return A.sql(A.stations(), O.strip_folds(), select="SELECT station_id, fold FROM folds")


@sql_query("fold_random_hash", "events")
def fold_random(d):
    return A.sql(A.stations(), select="SELECT station_id, CAST((row_number() OVER (ORDER BY md5(concat('42:', CAST(station_id AS VARCHAR(20)))), station_id) - 1) % 5 + 1 AS BIGINT) AS fold FROM stations")


@sql_query("semivariance_share", "events")
def semivariance(d):
    return A.sql(
        A.stations(), O.pairs(), A.panel(d), "field AS (SELECT station_id, avg(obs) AS y FROM panel GROUP BY station_id)",
        "joined AS (SELECT CASE WHEN km < 30e0 THEN 1 ELSE 0 END AS near, power(a.y - b.y, 2) / 2 AS g FROM pairs AS p JOIN field AS a ON p.target = a.station_id JOIN field AS b ON p.source = b.station_id WHERE p.target < p.source AND a.y IS NOT NULL AND b.y IS NOT NULL)",
        select="SELECT CAST(count(*) AS BIGINT) AS pairs, round(avg(CASE WHEN near = 1 THEN g END), 4) AS near, round(avg(g), 4) AS total, round(avg(CASE WHEN near = 1 THEN g END) / nullif(avg(g), 0), 6) AS share FROM joined",
    )


@sql_query("neighbourhood_max", "events")
def neighbourhood_max(d):
    return A.sql(
        A.stations(), A.panel(d), O.pairs(),
        "close_by AS (SELECT target, source FROM pairs WHERE km <= 20e0 UNION ALL SELECT station_id, station_id FROM stations)",
        select="SELECT c.target, p.t, round(max(p.a), 6) AS highest, round(avg(p.a), 6) AS mean, CAST(count(p.a) AS BIGINT) AS n FROM close_by AS c JOIN panel AS p ON c.source = p.station_id GROUP BY c.target, p.t",
    )


@sql_query("geos_pixel", "events")
def geos_pixel(d):
    x, y = S.scan_angles("lon", "lat")
    return A.sql(
        A.stations(), f"seen AS (SELECT station_id, {S.grid_position(x)} AS px, {S.grid_position(y)} AS py FROM stations)",
        select=f"SELECT station_id, round(px, 5) AS px, round(py, 5) AS py, {S.pixel(d, 'px')} AS ix, {S.pixel(d, 'py')} AS iy FROM seen",
    )


@sql_query("cell_membership", "events")
def cell_membership(d):
    return A.sql(
        A.stations(), f"placed AS (SELECT station_id, {S.cell_index('lon', 180.0)} AS ci, {S.cell_index('lat', 90.0)} AS cj FROM stations)",
        select=f"SELECT ci, cj, CAST(count(*) AS BIGINT) AS n, {d.list_sorted('station_id')} AS members FROM placed GROUP BY ci, cj",
    )


@sql_query("gauge_pairs", "events")
def gauge_pairs(d):
    band = S.classed("p.km", S.PAIR_EDGES_KM[1:])
    return A.sql(
        A.stations(), A.panel(d), O.pairs(),
        select=f"SELECT p.target, p.source, max({band}) AS band, {R.scores('x.obs', 'y.obs')} FROM pairs AS p JOIN panel AS x ON p.target = x.station_id JOIN panel AS y ON p.source = y.station_id AND x.t = y.t WHERE p.target < p.source AND p.km <= 60e0 AND x.obs IS NOT NULL AND y.obs IS NOT NULL GROUP BY p.target, p.source",
    )


@sql_query("pair_summary", "events")
def pair_summary(d):
    band = S.classed("p.km", S.PAIR_EDGES_KM[1:])
    return A.sql(
        A.stations(), A.panel(d), O.pairs(),
        f"by_pair AS (SELECT p.target, p.source, max({band}) AS band, sqrt(avg(power(x.obs - y.obs, 2))) AS rmse FROM pairs AS p JOIN panel AS x ON p.target = x.station_id JOIN panel AS y ON p.source = y.station_id AND x.t = y.t WHERE p.target < p.source AND p.km <= 60e0 AND x.obs IS NOT NULL AND y.obs IS NOT NULL GROUP BY p.target, p.source)",
        select=f"SELECT band, CAST(count(*) AS BIGINT) AS pairs, round({d.percentile('rmse', 0.5)}, 6) AS median_rmse, round(avg(rmse), 6) AS mean_rmse FROM by_pair GROUP BY band",
    )
