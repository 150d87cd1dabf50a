"""Neighbours, interpolation weights and local regression as SQL plans.

Tables that the plans take: ``stations`` (station_id, lon, lat) and ``cells`` (station_id, t, y): what stations report.
Neighbours come from an equal join on cells of a grid, so no plan sets all stations against all; nearest-k choices are
made among the stations that report at the time.
"""

from __future__ import annotations

from ..functions.dialect import KEEP
from ..functions.scalar import COINCIDENT_KM, RADIUS, east_km, haversine, kernel, north_km, num
from .relational import EPS, solve3


def pairs(radius: float = RADIUS) -> str:
    """pairs(target, source, km, e, n) of different stations; e, n: source's offset in km from the target."""
    return (
        f"pairs AS (SELECT a.station_id AS target, b.station_id AS source, {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat', radius)} AS km, "
        f"{east_km('b.lon', 'b.lat', 'a.lon', 'a.lat')} AS e, {north_km('b.lat', 'a.lat')} AS n "
        "FROM stations AS a JOIN stations AS b ON a.station_id <> b.station_id)"
    )


REACH = 96
#: Stations that a grid cell holds on average; its block of 5 x 5 has a full circle of some 12 cells.
PER_CELL = 8


def close_by(radius: float = RADIUS, reach: int = REACH) -> str:
    """close_by(target, source, km, e, n, place): the nearest stations of each, up to ``reach``, those within a circle that is sure to be whole.

    Stations of the 5 x 5 cells around one are met by an equal join; two cell sides from it nothing is missed. Networks
    that span more than half the globe get none (the circle would wrap), so all their cells take the slow way.
    """
    km, side = haversine("a.lon", "a.lat", "b.lon", "b.lat", radius), f"radians(1e0) * {num(radius)}"
    five = "(SELECT -2 AS {0} UNION ALL SELECT -1 UNION ALL SELECT 0 UNION ALL SELECT 1 UNION ALL SELECT 2)"
    return (
        "extents AS (SELECT min(lon) AS lon0, min(lat) AS lat0, greatest(max(lon) - min(lon), 1e-6) AS dx, greatest(max(lat) - min(lat), 1e-6) AS dy, max(abs(lat)) AS far, count(*) AS n FROM stations), "
        f"grid_of AS (SELECT *, greatest(dx / floor(sqrt(n / {num(PER_CELL)}) + 1), 1e-6) AS sx, greatest(dy / floor(sqrt(n / {num(PER_CELL)}) + 1), 1e-6) AS sy FROM extents), "
        "placed_in AS (SELECT s.station_id, s.lon, s.lat, CAST(floor((s.lon - g.lon0) / g.sx) AS BIGINT) AS cx, CAST(floor((s.lat - g.lat0) / g.sy) AS BIGINT) AS cy, "
        f"CASE WHEN g.dx > 180 THEN -1e0 ELSE 1.99e0 * {side} * least(g.sy, g.sx * cos(radians(least(g.far, 89.9e0)))) END AS sure FROM stations AS s CROSS JOIN grid_of AS g), "
        f"around_of AS (SELECT p.*, cx + i AS nx, cy + j AS ny FROM placed_in AS p CROSS JOIN {five.format('i')} AS di CROSS JOIN {five.format('j')} AS dj), "
        f"met_near AS (SELECT a.station_id AS target, b.station_id AS source, {km} AS km, {east_km('b.lon', 'b.lat', 'a.lon', 'a.lat')} AS e, {north_km('b.lat', 'a.lat')} AS n, a.sure "
        "FROM around_of AS a JOIN placed_in AS b ON a.nx = b.cx AND a.ny = b.cy WHERE a.station_id <> b.station_id), "
        f"close_by AS ({KEEP}SELECT * FROM (SELECT target, source, km, e, n, row_number() OVER (PARTITION BY target ORDER BY km, source) AS place FROM met_near WHERE km <= sure) AS o WHERE place <= {reach})"
    )


def _apart(target: str, source: str, radius: float = RADIUS) -> str:
    """km, e and n of two rows of stations as a SELECT list."""
    lon, lat, at_lon, at_lat = f"{source}.lon", f"{source}.lat", f"{target}.lon", f"{target}.lat"
    return f"{haversine(at_lon, at_lat, lon, lat, radius)} AS km, {east_km(lon, lat, at_lon, at_lat)} AS e, {north_km(lat, at_lat)} AS n"


def nearest_reporting(k: int, wanted: str, reports: str = "reports", reach: int = REACH) -> str:
    """met(target, t, source, y, km, e, n, rn <= k): the k nearest of the ``reports`` (station_id, t, y) at each ``wanted`` (target, t).

    The stations close by are tried first; where fewer than k of them report, all that report at that time are.
    """
    ranked = "row_number() OVER (PARTITION BY target, t ORDER BY km, source) AS rn, count(*) OVER (PARTITION BY target, t) AS held"
    return (
        f"{close_by(reach=reach)}, wanted_cells AS ({wanted}), "
        f"quick AS ({KEEP}SELECT * FROM (SELECT *, {ranked} FROM (SELECT w.target, w.t, p.source, r.y, p.km, p.e, p.n FROM wanted_cells AS w JOIN close_by AS p ON w.target = p.target JOIN {reports} AS r ON p.source = r.station_id AND w.t = r.t) AS c) AS q WHERE rn <= {k}), "
        f"enough AS (SELECT target, t FROM quick WHERE rn = {k}), "
        "lacking AS (SELECT w.target, w.t FROM wanted_cells AS w LEFT JOIN enough AS g ON w.target = g.target AND w.t = g.t WHERE g.target IS NULL), "
        f"slow AS (SELECT * FROM (SELECT *, {ranked} FROM (SELECT w.target, w.t, r.station_id AS source, r.y, {_apart('a', 'b')} FROM lacking AS w JOIN {reports} AS r ON w.t = r.t "
        f"JOIN stations AS a ON w.target = a.station_id JOIN stations AS b ON r.station_id = b.station_id WHERE r.station_id <> w.target) AS c) AS q WHERE rn <= {k}), "
        f"met AS (SELECT target, t, source, y, km, e, n, rn FROM quick WHERE held >= {k} UNION ALL SELECT target, t, source, y, km, e, n, rn FROM slow)"
    )


def candidates(k: int | None = None) -> str:
    """near(target, t, y0, source, y, km, e, n, rn): for each reported cell the other stations that report then, the k nearest or all."""
    base = f"reports AS ({KEEP}SELECT station_id, t, y FROM cells WHERE y IS NOT NULL), "
    if k:
        base += nearest_reporting(k, "SELECT station_id AS target, t FROM reports") + ", "
    else:
        base += (
            f"met AS (SELECT *, row_number() OVER (PARTITION BY target, t ORDER BY km, source) AS rn FROM (SELECT o.station_id AS target, o.t, r.station_id AS source, r.y, {_apart('a', 'b')} "
            "FROM reports AS o JOIN reports AS r ON o.t = r.t AND o.station_id <> r.station_id JOIN stations AS a ON o.station_id = a.station_id JOIN stations AS b ON r.station_id = b.station_id) AS c), "
        )
    return base + f"near AS ({KEEP}SELECT m.target, m.t, o.y AS y0, m.source, m.y, m.km, m.e, m.n, m.rn FROM met AS m JOIN reports AS o ON m.target = o.station_id AND m.t = o.t)"


def idw(power: float = 2.0) -> str:
    """idw(target, t, y0, pred): inverse distance; coincident stations give their mean."""
    c = num(COINCIDENT_KM)
    w = f"CASE WHEN km > {c} THEN power(km, {num(-power)}) ELSE 0e0 END"
    return (
        f"idw AS (SELECT target, t, max(y0) AS y0, CASE WHEN sum(CASE WHEN km <= {c} THEN 1 ELSE 0 END) > 0 "
        f"THEN avg(CASE WHEN km <= {c} THEN y END) ELSE sum({w} * y) / sum({w}) END AS pred FROM near GROUP BY target, t)"
    )


def adw(power: float = 2.0) -> str:
    """adw(target, t, y0, pred): inverse distance with Shepard's correction for directions, over the stations chosen."""
    c = num(COINCIDENT_KM)
    return (
        f"based AS ({KEEP}SELECT *, CASE WHEN km > {c} THEN power(km, {num(-power)}) ELSE 0e0 END AS w, e / nullif(sqrt(e * e + n * n), 0) AS ux, n / nullif(sqrt(e * e + n * n), 0) AS uy FROM near), "
        "summed AS (SELECT target, t, sum(w) AS sw, sum(w * ux) AS sx, sum(w * uy) AS sy, "
        f"sum(CASE WHEN km <= {c} THEN 1 ELSE 0 END) AS same, avg(CASE WHEN km <= {c} THEN y END) AS mean_same FROM based GROUP BY target, t), "
        "turned AS (SELECT b.target, b.t, b.y0, b.y, s.same, s.mean_same, "
        "CASE WHEN s.sw - b.w > 0 THEN b.w * (1 + (s.sw - (coalesce(b.ux, 0e0) * coalesce(s.sx, 0e0) + coalesce(b.uy, 0e0) * coalesce(s.sy, 0e0))) / (s.sw - b.w)) ELSE b.w END AS w "
        "FROM based AS b JOIN summed AS s ON b.target = s.target AND b.t = s.t), "
        "adw AS (SELECT target, t, max(y0) AS y0, CASE WHEN max(same) > 0 THEN max(mean_same) ELSE sum(w * y) / nullif(sum(w), 0) END AS pred FROM turned GROUP BY target, t)"
    )


def weights(name: str = "bisquare", k: int | None = 12, km: float | None = None) -> str:
    """weighted(near's columns, w): kernel weights; the bandwidth is the k-th nearest reporting station's distance, or ``km``, or none."""
    if k:
        return (
            f"width AS (SELECT target, t, max(CASE WHEN rn <= {k} THEN km END) AS bw FROM near GROUP BY target, t), "
            f"weighted AS ({KEEP}SELECT a.*, {kernel(name, 'a.km', 'b.bw')} AS w FROM near AS a JOIN width AS b ON a.target = b.target AND a.t = b.t)"
        )
    bw = num(km) if km else "CAST(NULL AS DOUBLE)"
    return f"weighted AS ({KEEP}SELECT *, {kernel(name, 'km', bw)} AS w FROM near)"


def local_linear(ridge: float = 1e-4, least: int = 3) -> str:
    """local(target, t, y0, pred): target-centred weighted plane with ridged slopes; its value at the target.

    Weights sum to 1; offsets are scaled by their weighted root mean square.
    """
    det, x0, _, _ = solve3(("s1", "s_e / s", "s_n / s", f"s_ee / (s * s) + {num(ridge)}", "s_en / (s * s)", f"s_nn / (s * s) + {num(ridge)}"), ("b0", "b1 / s", "b2 / s"))
    return (
        "share AS (SELECT target, t, sum(w) AS total FROM weighted WHERE w > 0 GROUP BY target, t), "
        "moments AS (SELECT a.target, a.t, max(a.y0) AS y0, count(*) AS used, sum(a.w / b.total) AS s1, sum(a.w / b.total * e) AS s_e, sum(a.w / b.total * n) AS s_n, "
        "sum(a.w / b.total * e * e) AS s_ee, sum(a.w / b.total * e * n) AS s_en, sum(a.w / b.total * n * n) AS s_nn, "
        "sum(a.w / b.total * y) AS b0, sum(a.w / b.total * e * y) AS b1, sum(a.w / b.total * n * y) AS b2 "
        "FROM weighted AS a JOIN share AS b ON a.target = b.target AND a.t = b.t WHERE a.w > 0 GROUP BY a.target, a.t), "
        "scaled AS (SELECT *, sqrt(s_ee + s_nn) AS s FROM moments), "
        f"local AS (SELECT target, t, y0, CASE WHEN used >= {least} AND s * s > {EPS} AND abs({det}) > {EPS} THEN {x0} / {det} END AS pred FROM scaled)"
    )


def gwr(ridge: float = 1e-8, least: int = 3) -> str:
    """gwr(target, t, y0, pred): weighted regression on [1, lon, lat], centred on the network mean, ridge on all diagonals."""
    det, x0, x1, x2 = solve3((f"s1 + {num(ridge)}", "s_x", "s_y", f"s_xx + {num(ridge)}", "s_xy", f"s_yy + {num(ridge)}"), ("b0", "b1", "b2"))
    return (
        "centre AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM stations), "
        "placed AS (SELECT station_id, lon - lon0 AS x, lat - lat0 AS yy FROM stations CROSS JOIN centre), "
        "sums AS (SELECT w.target, w.t, max(w.y0) AS y0, count(*) AS used, sum(w) AS s1, sum(w * x) AS s_x, sum(w * yy) AS s_y, sum(w * x * x) AS s_xx, sum(w * x * yy) AS s_xy, sum(w * yy * yy) AS s_yy, "
        "sum(w * w.y) AS b0, sum(w * x * w.y) AS b1, sum(w * yy * w.y) AS b2 FROM weighted AS w JOIN placed AS p ON w.source = p.station_id WHERE w > 0 GROUP BY w.target, w.t), "
        f"gwr AS (SELECT s.target, s.t, s.y0, CASE WHEN used >= {least} AND abs({det}) > {EPS} THEN ({x0} + {x1} * p.x + {x2} * p.yy) / {det} END AS pred "
        "FROM sums AS s JOIN placed AS p ON s.target = p.station_id)"
    )


def strip_folds(k: int = 5) -> str:
    """folds(station_id, lon, lat, fold): contiguous strips along the longer axis."""
    return (
        "extent AS (SELECT max(lon) - min(lon) AS dx, max(lat) - min(lat) AS dy FROM stations), "
        f"folds AS (SELECT station_id, lon, lat, CAST(ntile({k}) OVER (ORDER BY CASE WHEN dx >= dy THEN lon ELSE lat END, station_id) AS BIGINT) AS fold FROM stations CROSS JOIN extent)"
    )


def joint_context(value: str = "a", wet: str = "0.1e0") -> str:
    """context(held, station_id, t, fold, y, product, z): a covariate under each held-out fold.

    z is centred on the time's mean over training stations, then scaled by the weighted mean and deviation over wet
    training cells, each station weighing 1 in all. Needs ``x`` (station_id, t, fold, obs, <value>).
    """
    return (
        "held_folds AS (SELECT DISTINCT fold AS held FROM x), "
        f"centres AS (SELECT u.held, x.t, avg(x.{value}) AS centre FROM held_folds AS u JOIN x ON x.fold <> u.held GROUP BY u.held, x.t), "
        f"centred AS (SELECT c.held, x.station_id, x.t, x.fold, x.obs, x.{value} AS product, x.{value} - c.centre AS z0 FROM centres AS c JOIN x ON c.t = x.t), "
        f"wet_train AS (SELECT held, z0, 1e0 / count(*) OVER (PARTITION BY held, station_id) AS w FROM centred WHERE fold <> held AND obs >= {wet}), "
        "means AS (SELECT held, sum(w * z0) / sum(w) AS mu, sum(w * z0 * z0) / sum(w) AS square FROM wet_train GROUP BY held), "
        "context AS (SELECT c.held, c.station_id, c.t, c.fold, c.obs - c.product AS y, c.product, c.obs, CASE WHEN m.square - m.mu * m.mu > 1e-9 THEN (c.z0 - m.mu) / sqrt(m.square - m.mu * m.mu) END AS z FROM centred AS c JOIN means AS m ON c.held = m.held)"
    )
