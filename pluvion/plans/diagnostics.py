"""Queries of selection, hold-out evaluation and grid-support diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.dialect import DUCKDB, frame
from ..operators.graph import components
from ..operators import relational as R
from ..operators import series as T
from ..operators import spatial as O
from ..storage import materialise
from . import adapter as A
from .catalogue import query, sql_query, tables

_WET = S.num(S.WET)
_ALL = "obs IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"
_RESIDUAL = "cells AS (SELECT station_id, t, obs - a AS y FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL)"
_OBS = "cells AS (SELECT station_id, t, obs AS y FROM panel)"


def _panel(d, *steps, select):
    return A.sql(A.stations(), A.panel(d), *steps, select=select)


def _outside(k: int) -> str:
    """near as in ``candidates``, but only with sources of other folds."""
    return (
        "reports AS (SELECT station_id, t, y FROM cells WHERE y IS NOT NULL), "
        "met AS (SELECT o.station_id AS target, o.t, o.y AS y0, p.source, r.y, p.km, p.e, p.n, f.fold, row_number() OVER (PARTITION BY o.station_id, o.t ORDER BY p.km, p.source) AS rn "
        "FROM reports AS o JOIN reports AS r ON o.t = r.t JOIN folds AS f ON o.station_id = f.station_id JOIN folds AS g ON r.station_id = g.station_id AND f.fold <> g.fold JOIN pairs AS p ON p.target = o.station_id AND p.source = r.station_id), "
        f"near AS (SELECT * FROM met WHERE rn <= {k})"
    )


_HOLDOUT_SCORES = f"SELECT fold, 'raw' AS method, {R.scores('obs', 'a', 5)} FROM x GROUP BY fold UNION ALL SELECT fold, 'corrected', {R.scores('obs', 'fixed', 5)} FROM x GROUP BY fold"


@sql_query("spatial_holdout", "events")
def spatial_holdout(d):
    """Residual correction of each fold's stations from the other folds', against the raw product."""
    return _panel(
        d, _RESIDUAL, O.strip_folds(), O.pairs(), _outside(12), O.weights("bisquare", 12), O.local_linear(),
        "x AS (SELECT f.fold, p.obs, p.a, p.a + l.pred AS fixed FROM local AS l JOIN panel AS p ON l.target = p.station_id AND l.t = p.t JOIN folds AS f ON l.target = f.station_id WHERE l.pred IS NOT NULL)",
        select=_HOLDOUT_SCORES,
    )


def _by_k(ks):
    w = lambda k: f"sum(CASE WHEN rn <= {k} THEN y / greatest(km * km, 1e-12) END) / sum(CASE WHEN rn <= {k} THEN 1 / greatest(km * km, 1e-12) END)"
    return "tried AS (" + " UNION ALL ".join(f"SELECT {k} AS k, fold, target, t, max(y0) AS y0, {w(k)} AS pred FROM near GROUP BY fold, target, t" for k in ks) + ")"


_NESTED_STEPS = (
    "sse AS (SELECT k, fold, sum(power(pred - y0, 2)) AS s, count(*) AS n FROM tried GROUP BY k, fold)",
    "inner_scores AS (SELECT u.fold, v.k, sqrt(sum(v.s) / sum(v.n)) AS rmse FROM (SELECT DISTINCT fold FROM sse) AS u JOIN sse AS v ON u.fold <> v.fold GROUP BY u.fold, v.k)",
    "chosen AS (SELECT fold, k FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(rmse, 8), k) AS rn FROM inner_scores) AS r WHERE rn = 1)",
)
_NESTED_SCORES = f"SELECT t.fold, CAST(max(t.k) AS BIGINT) AS k, {R.scores('t.y0', 't.pred', 5)} FROM tried AS t JOIN chosen AS c ON t.fold = c.fold AND t.k = c.k GROUP BY t.fold"


@sql_query("nested_bandwidth_cv", "events")
def nested(d):
    """Neighbour count chosen on the other folds, scored on the held-out one."""
    return _panel(
        d, _OBS, O.strip_folds(), O.pairs(), _outside(16), _by_k((4, 8, 16)),
        *_NESTED_STEPS,
        select=_NESTED_SCORES,
    )


@sql_query("bandwidth_saturation", "events")
def saturation(d):
    """Share of folds whose best neighbour count is the largest tried."""
    return _panel(
        d, _OBS, O.strip_folds(), O.pairs(), _outside(16), _by_k((4, 8, 16)),
        "best AS (SELECT fold, k FROM (SELECT fold, k, row_number() OVER (PARTITION BY fold ORDER BY round(avg(power(pred - y0, 2)), 8), k) AS rn FROM tried GROUP BY fold, k) AS r WHERE rn = 1)",
        select="SELECT CAST(count(*) AS BIGINT) AS folds, round(avg(CASE WHEN k = 16 THEN 1e0 ELSE 0e0 END), 6) AS saturated, CAST(min(k) AS BIGINT) AS smallest FROM best",
    )


@sql_query("auto_method", "events")
def auto_method(d):
    """Methods on the cells that all predict; the best by rmse, mae, name."""
    return _panel(
        d, _OBS, O.pairs(), O.candidates(8), O.idw(), O.adw(), "climate AS (SELECT t, avg(obs) AS pred FROM panel GROUP BY t)",
        "shared AS (SELECT i.y0, i.pred AS idw, w.pred AS adw, c.pred AS day_mean FROM idw AS i JOIN adw AS w ON i.target = w.target AND i.t = w.t JOIN climate AS c ON i.t = c.t WHERE i.pred IS NOT NULL AND w.pred IS NOT NULL)",
        "scored AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, {R.scores('y0', m, 5)} FROM shared" for m in ("idw", "adw", "day_mean")) + ")",
        select="SELECT method, n, rmse, mae, CAST(row_number() OVER (ORDER BY rmse, mae, method) AS BIGINT) AS place FROM scored",
    )


@sql_query("method_summary", "events")
def method_summary(d):
    """Scores of each product beside the raw one."""
    tall = " UNION ALL ".join(f"SELECT '{c}' AS method, {R.scores('obs', c, 5)} FROM panel WHERE {_ALL}" for c in ("a", "b", "c"))
    return _panel(d, f"s AS ({tall})", select="SELECT s.method, s.n, s.rmse, s.mae, round((r.rmse - s.rmse) / nullif(r.rmse, 0), 4) AS better_than_raw FROM s CROSS JOIN (SELECT rmse FROM s WHERE method = 'a') AS r")


@sql_query("product_consensus", "events")
def consensus(d):
    return _panel(d, f"votes AS (SELECT station_id, t, CASE WHEN obs >= {_WET} THEN 1 ELSE 0 END AS truth, CASE WHEN a >= {_WET} THEN 1 ELSE 0 END + CASE WHEN b >= {_WET} THEN 1 ELSE 0 END + CASE WHEN c >= {_WET} THEN 1 ELSE 0 END AS votes FROM panel)", select="SELECT CAST(votes AS BIGINT) AS votes, CAST(count(*) AS BIGINT) AS n, CAST(sum(truth) AS BIGINT) AS wet, round(avg(CAST(truth AS DOUBLE)), 6) AS share FROM votes GROUP BY votes")


@sql_query("calibration_check", "events")
def calibration_check(d):
    """How often a calibrated value (product times ratio) keeps the product's zeros."""
    return _panel(d, "k AS (SELECT sum(obs) / nullif(sum(a), 0) AS ratio FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL)", select=f"SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN (a < {_WET}) = (a * ratio < {_WET}) THEN 1e0 ELSE 0e0 END), 6) AS same_zero, round(max(ratio), 6) AS ratio FROM panel CROSS JOIN k WHERE a IS NOT NULL")


@sql_query("prediction_coverage", "events")
def coverage(d):
    return _panel(d, _OBS, O.pairs(), O.candidates(4), O.idw(), select="SELECT p.t, CAST(count(*) AS BIGINT) AS eligible, round(avg(CASE WHEN i.pred IS NULL THEN 0e0 ELSE 1e0 END), 6) AS coverage FROM panel AS p LEFT JOIN idw AS i ON p.station_id = i.target AND p.t = i.t WHERE p.obs IS NOT NULL GROUP BY p.t")


_IDENTICAL = _panel(
    DUCKDB,
    select="SELECT x.station_id AS one, y.station_id AS two, CAST(count(*) AS BIGINT) AS overlap FROM panel AS x JOIN panel AS y ON x.t = y.t AND x.station_id < y.station_id WHERE x.obs IS NOT NULL AND y.obs IS NOT NULL GROUP BY x.station_id, y.station_id HAVING bool_and(x.obs = y.obs) AND count(*) >= 2",
)


def equal_series(panel, min_overlap: int = 1):
    """(a, b, overlap): pairs of stations, a < b, with at least ``min_overlap`` shared times and equal values at all of them.

    panel: (station_id, t, obs), a row a station and time. Only stations that are equal somewhere meet; a pair is given if it
    is equal as often as the stations' times intersect.
    """
    rows = panel.filter("obs IS NOT NULL")
    x, y = (rows.select(F.col("station_id").alias(n), "t", "obs") for n in ("a", "b"))
    met = x.join(y, ["t", "obs"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("equal")).filter(F.col("equal") >= min_overlap)
    times = rows.groupBy("station_id").agg(F.collect_set("t").alias("times"))
    for n in ("a", "b"):
        met = met.join(times.select(F.col("station_id").alias(n), F.col("times").alias(f"times_{n}")), n)
    overlap = F.size(F.array_intersect("times_a", "times_b")).cast("bigint")
    return met.filter(F.col("equal") == overlap).select("a", "b", F.col("equal").alias("overlap"))


def series_groups(panel, min_overlap: int = 1):
    """(station_id, component, size, min_overlap): stations that never differ where both report, as connected components of two or more.

    panel: (station_id, t, obs). Equality is exact; a pair with fewer than ``min_overlap`` shared times is no link. The
    relation is not transitive, so a group may hold stations that differ: min_overlap is its thinnest link.
    """
    links = materialise(equal_series(panel, min_overlap), "links")
    member = components(links.select("a", "b"))
    thin = links.join(member, F.col("a") == F.col("node")).groupBy("component").agg(F.min("overlap").alias("min_overlap"))
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    return member.join(sizes, "component").join(thin, "component").select(F.col("node").alias("station_id"), "component", "size", "min_overlap")


def observed(events):
    """(station_id, t, obs) as in the panel, but each sum in the order of event_id: what is compared exactly must not depend on the order of a shuffle."""
    kept = events.filter("event_type = 'purchase' AND value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL")
    day = F.floor(F.floor(F.unix_timestamp("ts") / 3600) / 24).cast("bigint")
    each = kept.groupBy(F.col("user_id").alias("station_id"), day.alias("t")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    return each.select("station_id", "t", (F.aggregate("x", F.lit(0.0), lambda s, e: s + e["value"]) / 10).alias("obs"))


@query("identical_series", _IDENTICAL.format(events="events"))
def identical_series(spark, sf_dir):
    """Station pairs whose shared days never differ, with at least two of them."""
    found = equal_series(materialise(observed(tables(spark, sf_dir, "events")["events"]), "observed"), 2)
    return found.select(F.col("a").alias("one"), F.col("b").alias("two"), "overlap")


_GROUPS = _panel(
    DUCKDB,
    "links AS (SELECT x.station_id AS a, y.station_id AS b, count(*) AS overlap FROM panel AS x JOIN panel AS y ON x.t = y.t AND x.station_id < y.station_id WHERE x.obs IS NOT NULL AND y.obs IS NOT NULL GROUP BY 1, 2 HAVING bool_and(x.obs = y.obs))",
    "edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links)", "reach AS (SELECT a AS node, b AS peer FROM edges UNION SELECT r.node, e.b FROM reach AS r JOIN edges AS e ON r.peer = e.a)",
    "member AS (SELECT node, min(peer) AS component FROM reach GROUP BY node)", "thin AS (SELECT component, min(overlap) AS min_overlap FROM links JOIN member ON a = node GROUP BY component)",
    select="SELECT node AS station_id, component, count(*) OVER (PARTITION BY component) AS size, min_overlap FROM member JOIN thin USING (component)",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("identical_series_groups", _GROUPS.format(events="events"))
def identical_series_groups(spark, sf_dir):
    """Components of stations with identical series."""
    return series_groups(materialise(observed(tables(spark, sf_dir, "events")["events"]), "observed"))


@sql_query("terrain_representativeness", "events")
def representativeness(d):
    """Deciles of the network's north coordinate beside those of the whole box, and the share of the box outside its range."""
    return A.sql(
        A.stations(), f"ix AS (SELECT {d.series('0', '40')} AS i)", "box AS (SELECT 31.2e0 + 2.2e0 * i / 40 AS z FROM ix)",
        select="SELECT " + ", ".join(f"round((SELECT {d.percentile('lat', p)} FROM stations), 6) AS station_{int(p * 100)}, round((SELECT {d.percentile('z', p)} FROM box), 6) AS box_{int(p * 100)}" for p in (0.1, 0.5, 0.9))
        + ", round((SELECT avg(CASE WHEN z < m.low OR z > m.high THEN 1e0 ELSE 0e0 END) FROM box CROSS JOIN (SELECT min(lat) AS low, max(lat) AS high FROM stations) AS m), 6) AS outside",
    )


@sql_query("footprint_pixels", "events")
def footprint(d):
    """Different full-disc pixels that a cell's probe points fall into."""
    x, y = S.scan_angles("lon", "lat")
    return A.sql(
        A.stations(), f"ix AS (SELECT {d.series('-2', '2')} AS i)", f"iy AS (SELECT {d.series('-2', '2')} AS j)",
        "probes AS (SELECT station_id, lon + 0.0213e0 * i AS lon, lat + 0.0197e0 * j AS lat FROM stations CROSS JOIN ix CROSS JOIN iy)",
        f"located AS (SELECT station_id, {S.pixel(d, S.grid_position(x))} AS px, {S.pixel(d, S.grid_position(y))} AS py FROM probes)",
        select="SELECT station_id, CAST(count(DISTINCT px * 10000 + py) AS BIGINT) AS pixels, CAST(count(*) AS BIGINT) AS probes FROM located GROUP BY station_id",
    )


@sql_query("extraction_sensitivity", "events")
def extraction(d):
    """Nearest value against the mean of the surroundings, by station and over all."""
    return _panel(
        d, O.pairs(), "around AS (SELECT p.target, x.t, avg(x.a) AS mean FROM pairs AS p JOIN panel AS x ON p.source = x.station_id WHERE p.km <= 25e0 GROUP BY p.target, x.t)",
        select=f"SELECT p.station_id, {R.scores('p.a', 'm.mean', 9)} FROM panel AS p JOIN around AS m ON p.station_id = m.target AND p.t = m.t WHERE p.a IS NOT NULL AND m.mean IS NOT NULL GROUP BY ROLLUP (p.station_id)",
    )


@sql_query("half_hour_day_total", "events")
def day_total(d):
    """Days' totals from half-hour rates, and how many of the 48 are there."""
    h = d.hour_index("ts")
    return A.sql(
        f"slots AS (SELECT user_id, {h} * 2 + CASE WHEN minute(ts) >= 30 THEN 1 ELSE 0 END AS slot, avg(value) AS rate FROM {{events}} GROUP BY 1, 2)",
        select="SELECT user_id, CAST(FLOOR(slot / 48e0) AS BIGINT) AS day, CAST(count(*) AS BIGINT) AS slots, round(sum(0.5e0 * rate), 6) AS total FROM slots GROUP BY 1, 2",
    )


@sql_query("representative_events", "events")
def representative(d):
    """The event of the largest total in each run of wet days of the network, first start on ties."""
    return A.sql(
        A.stations(), A.hours(d), T.rain_events(),
        "dated AS (SELECT *, CAST(FLOOR((start - 9) / 24e0) AS BIGINT) AS day FROM events_of)", "days AS (SELECT DISTINCT day FROM dated)",
        "runs AS (SELECT day, day - row_number() OVER (ORDER BY day) AS run FROM days)",
        "ranked AS (SELECT x.*, r.run, row_number() OVER (PARTITION BY r.run ORDER BY round(x.total, 6) DESC, x.start, x.station_id) AS rn FROM dated AS x JOIN runs AS r ON x.day = r.day)",
        select="SELECT station_id, event, day, round(total, 6) AS total FROM ranked WHERE rn = 1",
    )


def eligible(d):
    """SQL of ``eligible_cells`` where three rounds reach the fixed point."""
    steps, now = ["c0 AS (SELECT station_id, t FROM panel WHERE obs IS NOT NULL)"], "c0"
    for i in range(1, 4):
        steps.append(f"s{i} AS (SELECT station_id FROM {now} GROUP BY station_id HAVING count(*) >= 5)")
        steps.append(f"u{i} AS (SELECT x.station_id, x.t FROM {now} AS x JOIN s{i} AS s ON x.station_id = s.station_id)")
        steps.append(f"d{i} AS (SELECT t FROM u{i} GROUP BY t HAVING count(*) >= 4)")
        steps.append(f"c{i} AS (SELECT u.station_id, u.t FROM u{i} AS u JOIN d{i} AS z ON u.t = z.t)")
        now = f"c{i}"
    return _panel(d, *steps, select=f"SELECT station_id, CAST(count(*) AS BIGINT) AS days FROM {now} GROUP BY station_id")


def settled_cells(cells, days: int = 5, stations: int = 4):
    """Cells (station_id, t) of stations with enough days among days with enough stations, repeated until no cell is lost."""
    now = materialise(cells.select("station_id", "t"), "cells")
    left = now.count()
    while True:
        enough = now.groupBy("station_id").count().filter(f"count >= {days}").select("station_id")
        kept = now.join(enough, "station_id", "left_semi")
        full = kept.groupBy("t").count().filter(f"count >= {stations}").select("t")
        now = materialise(kept.join(full, "t", "left_semi").select("station_id", "t"), "cells")
        before, left = left, now.count()
        if left == before:
            return now


@query("eligible_cells", eligible(DUCKDB).format(events="events"))
def eligible_cells(spark, sf_dir):
    """Stations with enough days among days with enough stations: the fixed point."""
    cells = frame(spark, lambda d: _panel(d, select="SELECT station_id, t FROM panel WHERE obs IS NOT NULL"), **tables(spark, sf_dir, "events"))
    return settled_cells(cells).groupBy("station_id").agg(F.count("*").alias("days"))


@sql_query("weighted_correlation", "events")
def weighted_correlation(d):
    """Station-balanced correlation: each station's cells weigh 1 in all."""
    return _panel(
        d, "x AS (SELECT obs, a, 1e0 / count(*) OVER (PARTITION BY station_id) AS w FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL)", "m AS (SELECT sum(w * obs) / sum(w) AS mo, sum(w * a) / sum(w) AS ma FROM x)",
        select="SELECT CAST(count(*) AS BIGINT) AS n, round(sum(w * (obs - mo) * (a - ma)) / nullif(sqrt(sum(w * power(obs - mo, 2)) * sum(w * power(a - ma, 2))), 0), 5) AS r FROM x CROSS JOIN m",
    )


@sql_query("panel_sufficient_statistics", "events")
def sufficient(d):
    names = [f"round({c}, 8) AS {c}" for c in ("a0_1", "a1_1", "b0", "b1", "yy")]
    return _panel(d, f"g AS (SELECT station_id, {R.gram(['1e0', 'a'], 'obs')} FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY station_id)", select=f"SELECT station_id, n, {', '.join(names)} FROM g")


@sql_query("monthly_rows", "events")
def monthly(d):
    return _panel(d, select=f"SELECT CAST(FLOOR(t / 10e0) AS BIGINT) AS period, CAST(count(*) AS BIGINT) AS cells, {R.correlation('obs', 'a', 3, 5)} AS r, round(avg(obs), 6) AS mean_obs FROM panel WHERE obs IS NOT NULL GROUP BY 1")


@sql_query("input_audit", "events")
def audit(d):
    return _panel(d, select=" UNION ALL ".join(f"SELECT '{c}' AS source, CAST(count({c}) AS BIGINT) AS cells, CAST(count(DISTINCT CASE WHEN {c} IS NOT NULL THEN station_id END) AS BIGINT) AS stations, CAST(count(DISTINCT CASE WHEN {c} IS NOT NULL THEN t END) AS BIGINT) AS times FROM panel" for c in ("obs", "a", "b", "c")))


@sql_query("neighbour_labels", "events")
def neighbour_labels(d):
    """Share of stations within 30 km that are wet, beside the station's own state."""
    label = "CASE WHEN m.share IS NULL THEN 'alone' WHEN m.share = 0 THEN 'dry_around' WHEN m.share < 0.5e0 THEN 'some' ELSE 'most' END"
    return _panel(
        d, O.pairs(), f"around AS (SELECT p.target, x.t, avg(CASE WHEN x.obs >= {_WET} THEN 1e0 ELSE 0e0 END) AS share FROM pairs AS p JOIN panel AS x ON p.source = x.station_id WHERE p.km <= 30e0 AND x.obs IS NOT NULL GROUP BY p.target, x.t)",
        select=f"SELECT {label} AS label, CASE WHEN p.obs >= {_WET} THEN 'wet' ELSE 'dry' END AS own, CAST(count(*) AS BIGINT) AS n FROM panel AS p LEFT JOIN around AS m ON p.station_id = m.target AND p.t = m.t WHERE p.obs IS NOT NULL GROUP BY 1, 2",
    )


@sql_query("network_labels", "events")
def network_labels(d):
    return A.sql(
        A.stations(), A.hours(d), f"share AS (SELECT h, avg(CASE WHEN obs >= {_WET} THEN 1e0 ELSE 0e0 END) AS share FROM hours WHERE obs IS NOT NULL GROUP BY h)",
        select=f"SELECT CASE WHEN s.share = 0 THEN 'none' WHEN s.share < 0.05e0 THEN 'few' WHEN s.share < 0.25e0 THEN 'some' ELSE 'many' END AS network, CASE WHEN x.obs >= {_WET} THEN 1 ELSE 0 END = 1 AS wet, CAST(count(*) AS BIGINT) AS n, round(avg(x.a), 6) AS product FROM hours AS x JOIN share AS s ON x.h = s.h WHERE x.obs IS NOT NULL GROUP BY 1, 2",
    )


@sql_query("stratifiers", "events")
def stratifiers(d):
    """Counts of cells by several stratifiers at once, each total by itself (grouping sets)."""
    return A.sql(
        A.stations(), A.hours(d),
        f"x AS (SELECT CASE WHEN s.lon < 110.5e0 THEN 'west' ELSE 'east' END AS region, CASE WHEN s.lat < 32.3e0 THEN 'south' ELSE 'north' END AS belt, CASE WHEN h.h % 24 BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS half, {S.classed('h.obs', S.RAIN_EDGES)} AS rain, h.obs, h.a FROM hours AS h JOIN stations AS s ON h.station_id = s.station_id WHERE h.obs IS NOT NULL AND h.a IS NOT NULL)",
        select="SELECT region, belt, half, rain, CAST(count(*) AS BIGINT) AS n, round(avg(a - obs), 6) AS bias FROM x GROUP BY GROUPING SETS ((region), (belt), (half), (rain), (region, half))",
    )


@sql_query("station_audit", "events")
def station_audit(d):
    return _panel(d, select="SELECT station_id, CAST(count(*) AS BIGINT) AS rows_seen, CAST(sum(CASE WHEN obs IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN obs < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, CAST(sum(CASE WHEN obs > 100 THEN 1 ELSE 0 END) AS BIGINT) AS extreme, min(t) AS first_day, max(t) AS last_day FROM panel GROUP BY station_id")


@sql_query("mean_wet_residual", "events")
def mean_wet_residual(d):
    return _panel(d, select=f"SELECT station_id, CAST(count(*) AS BIGINT) AS n, round(avg(obs - a), 6) AS residual FROM panel WHERE obs >= {_WET} AND a IS NOT NULL GROUP BY station_id HAVING count(*) >= 2")


@sql_query("role_stability", "events")
def role_stability(d):
    """How many folds agree on whether a product's slope is positive."""
    slope = lambda c: f"(count(*) * sum({c} * obs) - sum({c}) * sum(obs))"
    tall = " UNION ALL ".join(f"SELECT f.fold, '{c}' AS product, {slope('p.' + c).replace('obs', 'p.obs')} AS s FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id WHERE p.obs IS NOT NULL AND p.{c} IS NOT NULL GROUP BY f.fold" for c in ("a", "b", "c"))
    return _panel(d, O.strip_folds(), f"x AS ({tall})", select="SELECT product, CAST(count(*) AS BIGINT) AS folds, CAST(sum(CASE WHEN s > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM x GROUP BY product")


@sql_query("stratified_summary", "events")
def stratified_summary(d):
    """Best product of each rain class and its lead over the second."""
    tall = " UNION ALL ".join(f"SELECT {S.classed('obs', S.RAIN_EDGES)} AS rain, '{c}' AS method, round(sqrt(avg(power({c} - obs, 2))), 6) AS rmse FROM panel WHERE {_ALL} GROUP BY 1" for c in ("a", "b", "c"))
    return _panel(d, f"s AS ({tall})", "r AS (SELECT *, row_number() OVER (PARTITION BY rain ORDER BY rmse, method) AS place, lead(rmse) OVER (PARTITION BY rain ORDER BY rmse, method) AS second FROM s)", select="SELECT rain, method, rmse, round(second - rmse, 5) AS lead FROM r WHERE place = 1")


_CONTEXT_CELLS = "x AS (SELECT p.station_id, p.t, f.fold, p.obs, p.a FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id WHERE p.obs IS NOT NULL AND p.a IS NOT NULL)"


@sql_query("joint_fold_context", "events")
def joint_context(d):
    return _panel(d, O.strip_folds(), _CONTEXT_CELLS, O.joint_context(), select="SELECT held, station_id, t, round(y, 5) AS y, round(z, 5) AS z FROM context WHERE fold = held")
