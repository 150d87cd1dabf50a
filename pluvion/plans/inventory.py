"""Queries of masks, summaries, labels and report rows that complete the inventory, each about one operator."""

from __future__ import annotations

from ..functions import scalar as S
from ..operators import relational as R
from ..operators import series as T
from ..operators import spatial as O
from . import adapter as A
from .catalogue import sql_query

_WET = S.num(S.WET)
_ALL = "obs IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"
_CELLS = "cells AS (SELECT station_id, t, obs AS y FROM panel)"
_DAY = "CAST(FLOOR((h - 9) / 24e0) AS BIGINT)"
_FOLDED = "x AS (SELECT p.*, f.fold, f.lon, f.lat FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id)"


def _panel(d, *steps, select):
    return A.sql(A.stations(), A.panel(d), *steps, select=select)


def _hours(d, *steps, select):
    return A.sql(A.stations(), A.hours(d), *steps, select=select)


def _n(x="*"):
    return f"CAST(count({x}) AS BIGINT)"


# --- windows, masks and coverage


@sql_query("time_window", "events")
def time_window(d):
    """Inclusive at both ends."""
    return _panel(d, "span AS (SELECT min(t) + 2 AS low, max(t) - 2 AS high FROM panel)", select="SELECT station_id, t, round(obs, 6) AS obs FROM panel CROSS JOIN span WHERE t BETWEEN low AND high")


@sql_query("box_filter", "events")
def box_filter(d):
    """Stations inside a box, its edges included, by id."""
    return A.sql(A.stations(), select="SELECT station_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM stations WHERE lon BETWEEN 110e0 AND 111e0 AND lat BETWEEN 31.5e0 AND 33e0")


@sql_query("sample_mask", "events")
def sample_mask(d):
    return _panel(d, select=f"SELECT station_id, t, {_ALL} AS inside FROM panel")


@sql_query("reduced_method_mask", "events")
def reduced_mask(d):
    """The common mask again with fewer methods, and the cells that the missing method had cost."""
    return _panel(d, select=f"SELECT t, CAST(sum(CASE WHEN {_ALL} THEN 1 ELSE 0 END) AS BIGINT) AS all_methods, CAST(sum(CASE WHEN obs IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_c FROM panel GROUP BY t")


@sql_query("rain_class_mask", "events")
def rain_class_mask(d):
    """Low edge inside, high edge outside."""
    return _panel(d, select="SELECT station_id, t, obs >= 2.5e0 AND obs < 8e0 AS inside FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL")


@sql_query("stratum_mask", "events")
def stratum_mask(d):
    rows = " UNION ALL ".join(f"SELECT '{n}' AS stratum, {S.num(lo)} AS low, {S.num(hi)} AS high" for n, lo, hi in (("dry", 0, 0.1), ("light", 0.1, 2.5), ("moderate", 2.5, 8), ("heavy", 8, 1e9)))
    return _panel(d, f"strata AS ({rows})", select=f"SELECT s.stratum, {_n()} AS n, round(avg(p.obs), 8) AS mean FROM panel AS p JOIN strata AS s ON p.obs >= s.low AND p.obs < s.high GROUP BY s.stratum")


@sql_query("self_excluded_pairs", "events")
def self_excluded(d):
    """Sources of a target, never itself."""
    return A.sql(A.stations(), O.pairs(), select=f"SELECT target, {_n()} AS sources, round(min(km), 6) AS nearest FROM pairs GROUP BY target")


@sql_query("availability_signature", "events")
def availability(d):
    """Days keyed by which stations report."""
    return _panel(d, f"who AS (SELECT t, {d.list_sorted('station_id')} AS reporting, count(*) AS n FROM panel WHERE obs IS NOT NULL GROUP BY t)", select=f"SELECT reporting, {_n()} AS days, CAST(max(n) AS BIGINT) AS stations FROM who GROUP BY reporting")


# --- scores and summaries


@sql_query("script_scores", "events")
def script_scores(d):
    return _panel(d, select=f"SELECT {R.scores('obs', 'b')} FROM panel WHERE {_ALL}")


@sql_query("candidate_score", "events")
def candidate_score(d):
    """Weighted scores of candidates (product times a factor) on cells with observation and product; the coverage counts those with a prediction."""
    w = "(CASE WHEN p.obs >= 8e0 THEN 1e0 ELSE 3e0 END)"
    return _panel(
        d, "tries AS (SELECT 0.5e0 AS factor UNION ALL SELECT 1e0 UNION ALL SELECT 1.5e0)", "x AS (SELECT k.factor, p.obs, p.a, CASE WHEN p.b IS NOT NULL THEN p.a * k.factor END AS pred FROM panel AS p CROSS JOIN tries AS k WHERE p.obs IS NOT NULL AND p.a IS NOT NULL)",
        select=f"SELECT factor, {_n('pred')} AS n, round(sqrt(sum(CASE WHEN pred IS NOT NULL THEN {w.replace('p.', '')} * power(pred - obs, 2) END) / sum(CASE WHEN pred IS NOT NULL THEN {w.replace('p.', '')} END)), 8) AS rmse, "
        f"round(sum(CASE WHEN pred IS NOT NULL THEN {w.replace('p.', '')} * abs(pred - obs) END) / sum(CASE WHEN pred IS NOT NULL THEN {w.replace('p.', '')} END), 8) AS mae, round(count(pred) * 1e0 / count(*), 8) AS coverage FROM x GROUP BY factor",
    )


@sql_query("negative_output", "events")
def negative_output(d):
    """How often and how far uncut residual corrections fall below 0."""
    return _panel(
        d, "m AS (SELECT avg(obs - a) AS shift FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL)",
        select=f"SELECT {_n()} AS n, CAST(sum(CASE WHEN a + shift < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, round(min(a + shift), 8) AS lowest, round(avg(CASE WHEN a + shift < 0 THEN 1e0 ELSE 0e0 END), 8) AS share FROM panel CROSS JOIN m WHERE a IS NOT NULL",
    )


_BY_FOLD = f"by_fold AS (SELECT fold, {R.scores('obs', 'a', 9)} FROM x GROUP BY fold)"


@sql_query("fold_metric_summary", "events")
def fold_summary(d):
    return _panel(d, O.strip_folds(), _FOLDED, _BY_FOLD, select="SELECT CAST(count(*) AS BIGINT) AS folds, " + ", ".join(f"round(avg({c}), 8) AS {c}_mean, round(stddev_samp({c}), 8) AS {c}_std" for c in ("rmse", "mae", "bias", "r")) + " FROM by_fold")


@sql_query("repeat_summary", "events")
def repeat_summary(d):
    """Mean, deviation and extremes of what is known, over repeats (here months of 30 days)."""
    return _panel(
        d, f"by_repeat AS (SELECT CAST(FLOOR(t / 30e0) AS BIGINT) AS period, {R.scores('obs', 'a', 9)} FROM panel GROUP BY 1)",
        select=" UNION ALL ".join(f"SELECT '{c}' AS metric, {_n(c)} AS known, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS std, round(min({c}), 8) AS lowest, round(max({c}), 8) AS highest FROM by_repeat" for c in ("rmse", "mae", "r")),
    )


@sql_query("claim_agreement", "events")
def claim_agreement(d):
    """In how many repeats each method beats the raw product, and whether all agree."""
    tall = " UNION ALL ".join(f"SELECT CAST(FLOOR(t / 30e0) AS BIGINT) AS period, '{c}' AS method, sqrt(avg(power({c} - obs, 2))) < sqrt(avg(power(a - obs, 2))) AS holds FROM panel WHERE {_ALL} GROUP BY 1" for c in ("b", "c"))
    return _panel(d, f"claims AS ({tall})", select=f"SELECT method, {_n()} AS repeats, CAST(sum(CASE WHEN holds THEN 1 ELSE 0 END) AS BIGINT) AS held, min(CASE WHEN holds THEN 1 ELSE 0 END) = max(CASE WHEN holds THEN 1 ELSE 0 END) AS agree FROM claims GROUP BY method")


@sql_query("claim_repeats", "events")
def claim_repeats(d):
    return _panel(d, select="SELECT DISTINCT CAST(FLOOR(t / 30e0) AS BIGINT) AS period FROM panel WHERE obs IS NOT NULL")


@sql_query("paired_run_comparison", "events")
def paired_runs(d):
    """Two runs' scores on all their cells and on those that both have."""
    own = " UNION ALL ".join(f"SELECT '{c}' AS run, {R.scores('obs', c, 8)} FROM panel" for c in ("a", "b"))
    both = " UNION ALL ".join(f"SELECT '{c}' AS run, {R.scores('obs', c, 8)} FROM panel WHERE a IS NOT NULL AND b IS NOT NULL" for c in ("a", "b"))
    return _panel(d, f"own AS ({own})", f"paired AS ({both})", select="SELECT coalesce(o.run, p.run) AS run, o.n, o.rmse, p.n AS paired_n, p.rmse AS paired_rmse, round(p.rmse - o.rmse, 7) AS moved FROM own AS o FULL OUTER JOIN paired AS p ON o.run = p.run")


@sql_query("wet_metrics", "events")
def wet_metrics(d):
    """Wet cells of one stratum: scores, medians and the relative bias."""
    return _panel(d, select=f"SELECT {R.scores('obs', 'a', 8)}, round({d.percentile('obs', 0.5)}, 8) AS median_obs, round({d.percentile('a', 0.5)}, 8) AS median_sat, round(sum(a - obs) / nullif(sum(obs), 0), 8) AS relative_bias FROM panel WHERE obs >= {_WET} AND a IS NOT NULL")


@sql_query("correlation_summary", "events")
def correlation_summary(d):
    """Median and quartiles of the stations' correlations by region and over all."""
    return _panel(
        d, f"by_station AS (SELECT s.lon, p.station_id, {R.correlation('p.obs', 'p.a', 3, 9)} AS r FROM panel AS p JOIN stations AS s ON p.station_id = s.station_id GROUP BY s.lon, p.station_id)",
        "placed AS (SELECT CASE WHEN lon < 110.5e0 THEN 'west' ELSE 'east' END AS region, r FROM by_station WHERE r IS NOT NULL)",
        select=f"SELECT coalesce(region, 'all') AS region, {_n()} AS stations, round({d.percentile('r', 0.25)}, 8) AS low, round({d.percentile('r', 0.5)}, 8) AS median, round({d.percentile('r', 0.75)}, 8) AS high FROM placed GROUP BY ROLLUP (region)",
    )


def block_sums(hours: int, value: str = "obs") -> str:
    """blocks(station_id, block, total): sums of ``hours`` hours, NULL where one is missing."""
    return f"blocks AS (SELECT station_id, CAST(FLOOR(h / {hours}e0) AS BIGINT) AS block, CASE WHEN count({value}) = {hours} THEN sum({value}) END AS total, CASE WHEN count(a) = {hours} THEN sum(a) END AS sat FROM hours GROUP BY 1, 2)"


for _width in (1, 3, 24):
    sql_query(f"block_sums_{_width}h", "events")(lambda d, n=_width: _hours(d, block_sums(n), select="SELECT station_id, block, round(total, 8) AS total, round(sat, 8) AS sat FROM blocks WHERE total IS NULL OR total > 0"))


@sql_query("regional_series_scores", "events")
def regional_scores(d):
    """Scores of the network's mean series at 1, 3 and 24 hours; hours with nine stations in ten, blocks without a gap."""
    parts = []
    for n in (1, 3, 24):
        parts.append(f"SELECT {n} AS hours, {R.scores('obs', 'a', 8)} FROM (SELECT CAST(FLOOR(h / {n}e0) AS BIGINT) AS block, CASE WHEN count(obs) = {n} THEN sum(obs) END AS obs, CASE WHEN count(a) = {n} THEN sum(a) END AS a FROM mean_series GROUP BY 1) AS q WHERE obs IS NOT NULL AND a IS NOT NULL")
    return _hours(
        d, "mean_series AS (SELECT h, CASE WHEN count(obs) >= 0.9e0 * count(*) THEN avg(obs) END AS obs, CASE WHEN count(a) >= 0.9e0 * count(*) THEN avg(a) END AS a FROM hours GROUP BY h)",
        select="SELECT CAST(hours AS BIGINT) AS hours, n, CASE WHEN n >= 10 THEN rmse END AS rmse, CASE WHEN n >= 10 THEN bias END AS bias, CASE WHEN n >= 10 THEN r END AS r FROM (" + " UNION ALL ".join(parts) + ") AS s",
    )


@sql_query("diurnal_composites", "events")
def composites(d):
    """Cube of region by hour and class, with the margin "all"."""
    return _hours(
        d, f"x AS (SELECT CASE WHEN s.lon < 110.5e0 THEN 'west' ELSE 'east' END AS region, h.h % 24 AS hour, {S.classed('h.obs', (0.1, 2.0))} AS class, h.obs, h.a FROM hours AS h JOIN stations AS s ON h.station_id = s.station_id WHERE h.obs IS NOT NULL)",
        select=f"SELECT coalesce(region, 'all') AS region, CAST(hour AS BIGINT) AS hour, coalesce(class, -2) AS class, {_n()} AS n, round(avg(obs), 8) AS obs, round(avg(a), 8) AS sat FROM x GROUP BY GROUPING SETS ((region, hour, class), (region, hour), (hour, class), (hour))",
    )


# --- days and events

_TOTALS = f"totals AS (SELECT station_id, {_DAY} AS day, CASE WHEN count(obs) = 24 THEN sum(obs) END AS total, CASE WHEN count(a) = 24 THEN sum(a) END AS sat FROM hours GROUP BY 1, 2)"


@sql_query("heavy_day_screen", "events")
def heavy_days(d):
    """Days with enough stations above the limit (strictly), their spread and the wettest station."""
    return _hours(
        d, _TOTALS,
        "wettest AS (SELECT day, station_id, row_number() OVER (PARTITION BY day ORDER BY round(total, 6) DESC, station_id) AS rn FROM totals WHERE total IS NOT NULL)",
        f"screened AS (SELECT day, count(total) AS stations, sum(CASE WHEN total > 1e0 THEN 1 ELSE 0 END) AS heavy, avg(CASE WHEN total > {_WET} THEN 1e0 WHEN total IS NOT NULL THEN 0e0 END) AS wide, stddev_samp(total) / nullif(avg(total), 0) AS cv FROM totals GROUP BY day HAVING sum(CASE WHEN total > 1e0 THEN 1 ELSE 0 END) >= 4)",
        select="SELECT s.day, CAST(s.stations AS BIGINT) AS stations, CAST(s.heavy AS BIGINT) AS heavy, round(s.wide, 8) AS wide, round(s.cv, 8) AS cv, w.station_id AS peak_station FROM screened AS s JOIN wettest AS w ON s.day = w.day AND w.rn = 1",
    )


@sql_query("event_station_totals", "events")
def event_totals(d):
    """Totals over a day of stations that all products cover whole."""
    return _hours(
        d, f"worst AS (SELECT {_DAY} AS day, sum(obs) AS s FROM hours GROUP BY 1)", "chosen AS (SELECT day FROM (SELECT day, row_number() OVER (ORDER BY round(s, 6) DESC, day) AS rn FROM worst WHERE s IS NOT NULL) AS r WHERE rn <= 3)",
        select=f"SELECT x.day, x.station_id, round(sum(x.obs), 8) AS obs, round(sum(x.a), 8) AS a, round(sum(x.b), 8) AS b FROM (SELECT *, {_DAY} AS day FROM hours) AS x JOIN chosen AS k ON x.day = k.day GROUP BY x.day, x.station_id HAVING count(x.obs) = 24 AND count(x.a) = 24 AND count(x.b) = 24",
    )


@sql_query("event_hours", "events")
def event_hours(d):
    """Hours of a day that enough stations cover, and the share of the rain in the hours left out."""
    return _hours(
        d, f"by_hour AS (SELECT {_DAY} AS day, h, count(obs) AS have, count(*) AS all_stations, coalesce(sum(obs), 0e0) AS rain FROM hours GROUP BY 1, 2)",
        select="SELECT day, CAST(sum(CASE WHEN have >= 0.9e0 * all_stations THEN 1 ELSE 0 END) AS BIGINT) AS hours, min(CASE WHEN have >= 0.9e0 * all_stations THEN h END) AS first_hour, max(CASE WHEN have >= 0.9e0 * all_stations THEN h END) AS last_hour, "
        "round(sum(CASE WHEN have < 0.9e0 * all_stations THEN rain ELSE 0e0 END) / nullif(sum(rain), 0), 8) AS left_out FROM by_hour GROUP BY day",
    )


@sql_query("event_spatial_scores", "events")
def event_spatial(d):
    """By day over stations: relative bias, centred error, ratio of deviations, Kling-Gupta efficiency, rain-weighted centroids' distance."""
    both = "obs IS NOT NULL AND a IS NOT NULL"
    return _panel(
        d, f"x AS (SELECT p.t, p.obs, p.a, s.lon, s.lat FROM panel AS p JOIN stations AS s ON p.station_id = s.station_id WHERE {both})",
        "m AS (SELECT t, count(*) AS n, avg(obs) AS mo, avg(a) AS ma, stddev_samp(obs) AS so, stddev_samp(a) AS sa, covar_pop(obs, a) / nullif(stddev_pop(obs) * stddev_pop(a), 0) AS r, sqrt(avg(power(a - obs, 2)) - power(avg(a - obs), 2)) AS crmse, "
        "sum(obs * lon) / nullif(sum(obs), 0) AS lon_o, sum(obs * lat) / nullif(sum(obs), 0) AS lat_o, sum(a * lon) / nullif(sum(a), 0) AS lon_s, sum(a * lat) / nullif(sum(a), 0) AS lat_s FROM x GROUP BY t HAVING count(*) >= 3)",
        select=f"SELECT t, CAST(n AS BIGINT) AS n, round((ma - mo) / nullif(mo, 0), 7) AS relative_bias, round(crmse, 7) AS crmse, round(sa / nullif(so, 0), 7) AS ratio, round(1 - sqrt(power(r - 1, 2) + power(sa / nullif(so, 0) - 1, 2) + power(ma / nullif(mo, 0) - 1, 2)), 6) AS kge, "
        f"round({S.haversine('lon_o', 'lat_o', 'lon_s', 'lat_s')}, 6) AS shift_km FROM m",
    )


@sql_query("small_scale_share", "events")
def small_scale(d):
    """Half the mean squared difference of pairs nearer than 10 km over the variance."""
    return _panel(
        d, O.pairs(), "field AS (SELECT station_id, avg(obs) AS v FROM panel WHERE obs IS NOT NULL GROUP BY station_id)",
        "near AS (SELECT avg(power(x.v - y.v, 2)) / 2 AS g, count(*) AS n FROM pairs AS p JOIN field AS x ON p.target = x.station_id JOIN field AS y ON p.source = y.station_id WHERE p.target < p.source AND p.km < 10e0)", "spread AS (SELECT var_samp(v) AS v FROM field)",
        select="SELECT CAST(n AS BIGINT) AS pairs, round(g / nullif(v, 0), 8) AS share FROM near CROSS JOIN spread",
    )


@sql_query("core_hour_diagnostics", "events")
def core_hours(d):
    """By event: the peaks' height and lag, and the share of the rain in its three wettest hours."""
    return _hours(
        d, T.rain_events(), T.scoring_windows(),
        "inside AS (SELECT w.station_id, w.event, x.h, x.obs, x.a FROM windows AS w JOIN hours AS x ON w.station_id = x.station_id AND x.h BETWEEN w.low AND w.high WHERE x.obs IS NOT NULL)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY station_id, event ORDER BY obs DESC, h) AS by_obs, row_number() OVER (PARTITION BY station_id, event ORDER BY a DESC, h) AS by_sat FROM inside)",
        select="SELECT station_id, event, round(max(obs), 8) AS peak, round(max(a), 8) AS sat_peak, max(CASE WHEN by_sat = 1 THEN h END) - max(CASE WHEN by_obs = 1 THEN h END) AS lag, round(sum(CASE WHEN by_obs <= 3 THEN obs END) / nullif(sum(obs), 0), 8) AS top_share FROM ranked GROUP BY station_id, event",
    )


@sql_query("heavy_event_summary", "events")
def heavy_event_summary(d):
    tall = " UNION ALL ".join(f"SELECT t, '{c}' AS product, {R.scores('obs', c, 9)} FROM panel WHERE obs >= {_WET} GROUP BY t" for c in ("a", "b"))
    return _panel(d, f"by_day AS ({tall})", select=f"SELECT product, {_n()} AS days, round(avg(rmse), 8) AS mean_rmse, round({d.percentile('rmse', 0.5)}, 8) AS median_rmse, round(min(bias), 8) AS lowest_bias, round(max(bias), 8) AS highest_bias FROM by_day WHERE rmse IS NOT NULL GROUP BY product")


# --- cells, components and sets

_PLACED = f"placed AS (SELECT station_id, {S.cell_index('lon', 180.0)} AS ci, {S.cell_index('lat', 90.0)} AS cj, {S.cell_index('lon', 180.0, 0.25)} AS di, {S.cell_index('lat', 90.0, 0.25)} AS dj FROM stations)"


@sql_query("cell_multiplicity", "events")
def multiplicity(d):
    """By grid: cells that are taken, stations that share one, and the most in one."""
    return A.sql(
        A.stations(), _PLACED, "held AS (SELECT 'fine' AS grid, count(*) AS n FROM placed GROUP BY ci, cj UNION ALL SELECT 'coarse', count(*) FROM placed GROUP BY di, dj)",
        select=f"SELECT grid, {_n()} AS cells, CAST(sum(n) AS BIGINT) AS stations, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS shared, CAST(max(n) AS BIGINT) AS most FROM held GROUP BY grid",
    )


@sql_query("cell_series_agreement", "events")
def cell_agreement(d):
    """Do stations of one cell read the same series? Different daily values in a cell and day."""
    return _panel(
        d, _PLACED, "x AS (SELECT g.di, g.dj, p.t, p.a FROM panel AS p JOIN placed AS g ON p.station_id = g.station_id WHERE p.a IS NOT NULL)", "met AS (SELECT di, dj, t, count(*) AS n, count(DISTINCT a) AS kinds FROM x GROUP BY di, dj, t HAVING count(*) > 1)",
        select=f"SELECT di, dj, {_n()} AS days, round(avg(CASE WHEN kinds = 1 THEN 1e0 ELSE 0e0 END), 8) AS same FROM met GROUP BY di, dj",
    )


@sql_query("effective_cell_keys", "events")
def effective_keys(d):
    """Stations that share the cells of every grid have one key."""
    key = "concat(CAST(ci AS VARCHAR(12)), ',', CAST(cj AS VARCHAR(12)), '|', CAST(di AS VARCHAR(12)), ',', CAST(dj AS VARCHAR(12)))"
    return A.sql(A.stations(), _PLACED, select=f"SELECT station_id, {key} AS cell_key, CAST(count(*) OVER (PARTITION BY ci, cj, di, dj) AS BIGINT) AS members FROM placed")


@sql_query("pixel_assignment", "events")
def pixel_assignment(d):
    """Pixel of each station, its centre's offset in pixels, and how many stations it holds."""
    x, y = S.scan_angles("lon", "lat")
    return A.sql(
        A.stations(), f"seen AS (SELECT station_id, {S.grid_position(x)} AS px, {S.grid_position(y)} AS py FROM stations)",
        f"cut AS (SELECT *, {S.pixel(d, 'px')} AS ix, {S.pixel(d, 'py')} AS iy FROM seen)",
        select="SELECT station_id, ix, iy, round(px + 1 - ix, 5) AS dx, round(py + 1 - iy, 5) AS dy, CAST(count(*) OVER (PARTITION BY ix, iy) AS BIGINT) AS stations FROM cut",
    )


@sql_query("set_operations", "events")
def set_operations(d):
    """Common, united and left-out ids of two sources."""
    one, two = "(SELECT DISTINCT station_id FROM panel WHERE a IS NOT NULL)", "(SELECT DISTINCT station_id FROM panel WHERE c IS NOT NULL)"
    return _panel(
        d, f"one AS {one}", f"two AS {two}", "folded AS (SELECT station_id FROM stations WHERE station_id % 5 = 0)",
        select="SELECT 'common' AS kind, station_id FROM (SELECT station_id FROM one INTERSECT SELECT station_id FROM two) AS i UNION ALL SELECT 'union', station_id FROM (SELECT station_id FROM one UNION SELECT station_id FROM two) AS u "
        "UNION ALL SELECT 'train', station_id FROM (SELECT station_id FROM stations EXCEPT SELECT station_id FROM folded) AS e",
    )


@sql_query("selection_schemes", "events")
def schemes(d):
    """All stations, and all but each fold."""
    return A.sql(A.stations(), O.strip_folds(), select="SELECT 'full' AS scheme, 0 AS held, station_id FROM folds UNION ALL SELECT 'fold_out' AS scheme, CAST(k.fold AS INT) AS held, f.station_id FROM (SELECT DISTINCT fold FROM folds) AS k JOIN folds AS f ON f.fold <> k.fold")


@sql_query("partition_signature", "events")
def signature(d):
    """A partition's identity, whatever its folds' numbers or order."""
    return A.sql(A.stations(), O.strip_folds(), f"members AS (SELECT fold, {d.list_sorted('station_id')} AS ids FROM folds GROUP BY fold)", select=f"SELECT md5({d.list_sorted('ids')}) AS signature, {_n()} AS folds FROM members")


@sql_query("fold_geometry", "events")
def fold_geometry(d):
    """Quantiles by fold of the distance to the nearest training station."""
    return A.sql(
        A.stations(), O.pairs(), O.strip_folds(), "near AS (SELECT p.target, max(x.fold) AS fold, min(p.km) AS km FROM pairs AS p JOIN folds AS x ON p.target = x.station_id JOIN folds AS y ON p.source = y.station_id WHERE x.fold <> y.fold GROUP BY p.target)",
        select=f"SELECT fold, {_n()} AS stations, " + ", ".join(f"round({d.percentile('km', q)}, 6) AS q{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + ", round(max(km), 6) AS farthest FROM near GROUP BY fold",
    )


@sql_query("random_holdout", "events")
def random_holdout(d):
    """A fifth of the stations, by the order of a seeded hash."""
    return A.sql(A.stations(), "r AS (SELECT station_id, row_number() OVER (ORDER BY md5(concat('7:', CAST(station_id AS VARCHAR(20)))), station_id) AS rn, count(*) OVER () AS n FROM stations)", select="SELECT station_id, rn > round(0.8e0 * n) AS held FROM r")


# --- distances, neighbours and order

for _name, _radius in (("selection", S.RADIUS_SELECTION), ("grid", S.RADIUS_GRID)):
    sql_query(f"distances_{_name}_radius", "events")(lambda d, r=_radius: A.sql(A.stations(), O.pairs(r), select="SELECT target, source, round(km, 6) AS km FROM pairs WHERE target < source AND km <= 30e0"))


@sql_query("distance_from_centre", "events")
def from_centre(d):
    return A.sql(A.stations(), select=f"SELECT station_id, round({S.haversine('lon', 'lat', '110.5e0', '32.3e0')}, 6) AS km, round({S.east_km('lon', 'lat', '110.5e0', '32.3e0', S.RADIUS_GRID)}, 6) AS e, round({S.north_km('lat', '32.3e0', S.RADIUS_GRID)}, 6) AS n FROM stations")


@sql_query("nearest_cell", "events")
def nearest_cell(d):
    """Centre of the grid cell nearest to each station."""
    return A.sql(A.stations(), select=f"SELECT station_id, round(({S.cell_index('lon', 180.0)} + 0.5e0) * 0.1e0 - 180, 6) AS lon, round(({S.cell_index('lat', 90.0)} + 0.5e0) * 0.1e0 - 90, 6) AS lat FROM stations")


@sql_query("top_weights", "events")
def top_weights(d):
    """The eight heaviest sources of each target."""
    return A.sql(
        A.stations(), O.pairs(), f"weighed AS (SELECT target, source, {S.kernel('gaussian', 'km', S.num(40.0))} AS w, km FROM pairs)",
        select="SELECT target, source, round(w, 8) AS w, CAST(rn AS BIGINT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY km, source) AS rn FROM weighed) AS r WHERE rn <= 8",
    )


@sql_query("best_under_coverage", "events")
def best_under_coverage(d):
    """Best candidate by rmse, mae and coverage among those that cover enough; also the one without the gate."""
    tall = " UNION ALL ".join(f"SELECT '{c}' AS method, {R.scores('obs', c, 9)}, avg(CASE WHEN {c} IS NULL THEN 0e0 ELSE 1e0 END) AS coverage FROM panel WHERE obs IS NOT NULL" for c in ("a", "b", "c"))
    order = "ORDER BY rmse, mae, -coverage, method"
    return _panel(d, f"scan AS ({tall})", select=f"SELECT kind, method, rmse FROM (SELECT 'gated' AS kind, method, rmse, row_number() OVER ({order}) AS rn FROM scan WHERE coverage >= 0.3e0 UNION ALL SELECT 'open' AS kind, method, rmse, row_number() OVER ({order}) AS rn FROM scan) AS r WHERE rn = 1")


@sql_query("optimal_relief_window", "lineitem")
def relief_window(d):
    """Mean relief by window side; the side where the logarithm's rise per side changes most, the earliest on ties."""
    per = lambda k: f"SELECT {k} AS side, avg(r) AS relief FROM (SELECT max(z) - min(z) AS r FROM grid GROUP BY CAST(FLOOR(i / {k}e0) AS BIGINT), CAST(FLOOR(j / {k}e0) AS BIGINT) HAVING count(*) = {k * k}) AS b"
    return A.sql(
        "grid AS (SELECT CAST(l_suppkey % 24 AS BIGINT) AS i, CAST(l_partkey % 24 AS BIGINT) AS j, max(CAST(l_quantity AS DOUBLE)) AS z FROM {lineitem} GROUP BY 1, 2)",
        f"sides AS ({' UNION ALL '.join(map(per, (2, 3, 4, 6, 8, 12)))})", "logs AS (SELECT side, relief, ln(relief / (side * side)) AS x, row_number() OVER (ORDER BY side) AS i, count(*) OVER () AS n FROM sides WHERE relief > 0)",
        "parts AS (SELECT p.side, p.i, p.n, avg(CASE WHEN q.i <= p.i THEN q.x END) AS m1, avg(CASE WHEN q.i > p.i THEN q.x END) AS m2 FROM logs AS p JOIN logs AS q ON TRUE GROUP BY p.side, p.i, p.n)",
        select="SELECT CAST(side AS BIGINT) AS side, round(gain, 8) AS gain FROM (SELECT side, i * (n - i) * 1e0 / n * power(m1 - m2, 2) AS gain, row_number() OVER (ORDER BY round(i * (n - i) * 1e0 / n * power(m1 - m2, 2), 9) DESC, side) AS rn FROM parts WHERE i < n) AS r WHERE rn = 1",
    )


@sql_query("mean_block_relief", "lineitem")
def mean_relief(d):
    per = lambda k: f"SELECT {k} AS side, count(*) AS blocks, avg(r) AS relief FROM (SELECT max(z) - min(z) AS r FROM grid GROUP BY CAST(FLOOR(i / {k}e0) AS BIGINT), CAST(FLOOR(j / {k}e0) AS BIGINT) HAVING count(*) = {k * k}) AS b"
    return A.sql("grid AS (SELECT CAST(l_suppkey % 24 AS BIGINT) AS i, CAST(l_partkey % 24 AS BIGINT) AS j, max(CAST(l_quantity AS DOUBLE)) AS z FROM {lineitem} GROUP BY 1, 2)", select="SELECT CAST(side AS BIGINT) AS side, CAST(blocks AS BIGINT) AS blocks, round(relief, 8) AS relief FROM (" + " UNION ALL ".join(map(per, (2, 3, 4, 6, 8, 12))) + ") AS s")


# --- selection and fusion summaries

_ROLES = "roles AS (SELECT f.fold, k.v AS candidate, CASE WHEN abs(coalesce({r}, 0e0)) >= 0.2e0 THEN 'local' WHEN abs(coalesce({r}, 0e0)) >= 0.05e0 THEN 'global' ELSE 'none' END AS role FROM x AS f CROSS JOIN (SELECT 'a' AS v UNION ALL SELECT 'b' UNION ALL SELECT 'c') AS k GROUP BY f.fold, k.v)"


def _roles() -> str:
    value = "CASE k.v WHEN 'a' THEN f.a WHEN 'b' THEN f.b ELSE f.c END"
    return _ROLES.replace("{r}", R.correlation("f.obs", value, 3, 9))


@sql_query("joint_role_stability", "events")
def joint_role_stability(d):
    """By covariate: in how many folds it is chosen, and how often it is local or global."""
    return _panel(d, O.strip_folds(), _FOLDED, _roles(), select=f"SELECT candidate, {_n()} AS folds, CAST(sum(CASE WHEN role <> 'none' THEN 1 ELSE 0 END) AS BIGINT) AS chosen, CAST(sum(CASE WHEN role = 'local' THEN 1 ELSE 0 END) AS BIGINT) AS local, CAST(sum(CASE WHEN role = 'global' THEN 1 ELSE 0 END) AS BIGINT) AS global, count(DISTINCT role) = 1 AS stable FROM roles GROUP BY candidate")


@sql_query("role_consensus", "events")
def role_consensus(d):
    """Covariates that most folds choose, with the role that most give; local on ties."""
    return _panel(d, O.strip_folds(), _FOLDED, _roles(), "votes AS (SELECT candidate, count(*) AS n, sum(CASE WHEN role = 'local' THEN 1 ELSE 0 END) AS l, sum(CASE WHEN role = 'global' THEN 1 ELSE 0 END) AS g FROM roles GROUP BY candidate)", select="SELECT candidate, 2 * (l + g) > n AS consensus, CASE WHEN 2 * (l + g) <= n THEN NULL WHEN l >= g THEN 'local' ELSE 'global' END AS role FROM votes")


@sql_query("experiment_metrics", "events")
def experiment_metrics(d):
    """Rows of an experiment: all and wet cells, with the share of eligible cells that have a prediction."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS stratum, {R.scores('obs', 'b', 8)}, round(avg(CASE WHEN b IS NULL THEN 0e0 ELSE 1e0 END), 8) AS coverage FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL{w}" for n, w in (("all", ""), ("wet", f" AND obs >= {_WET}")))
    return _panel(d, select=rows)


@sql_query("hurdle_diagnostics", "events")
def hurdle_diagnostics(d):
    """Shares of cells by the way their wet chance was found (month, all months, global, none)."""
    return _panel(
        d, f"own AS (SELECT station_id, CAST(FLOOR(t / 30e0) AS BIGINT) AS period, count(*) AS n FROM panel WHERE obs IS NOT NULL GROUP BY 1, 2)", "total AS (SELECT station_id, sum(n) AS n FROM own GROUP BY station_id)",
        "code AS (SELECT CASE WHEN p.a IS NULL THEN 3 WHEN o.n >= 3 THEN 0 WHEN s.n >= 3 THEN 1 ELSE 2 END AS code FROM panel AS p LEFT JOIN own AS o ON p.station_id = o.station_id AND CAST(FLOOR(p.t / 30e0) AS BIGINT) = o.period LEFT JOIN total AS s ON p.station_id = s.station_id)",
        select="SELECT CAST(code AS BIGINT) AS code, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1e0 / max(q.n), 8) AS share FROM code CROSS JOIN (SELECT count(*) AS n FROM panel) AS q GROUP BY code",
    )


@sql_query("band_coefficient_summary", "events")
def band_coefficients(d):
    """Slope and intercept by band over folds: mean, spread and sign."""
    band = S.agreement_band(("a", "b"))
    return _panel(
        d, O.strip_folds(), _FOLDED, f"banded AS (SELECT fold, {band} AS band, obs, a FROM x WHERE obs IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)",
        "fits AS (SELECT fold, band, count(*) AS n, covar_pop(a, obs) / nullif(var_pop(a), 0) AS slope, avg(a) AS ma, avg(obs) AS mo FROM banded GROUP BY fold, band HAVING count(*) >= 5)",
        select="SELECT band, CAST(count(*) AS BIGINT) AS folds, round(avg(slope), 7) AS slope, round(stddev_samp(slope), 7) AS spread, round(avg(mo - slope * ma), 7) AS intercept, round(avg(CASE WHEN slope > 0 THEN 1e0 ELSE 0e0 END), 8) AS positive FROM fits GROUP BY band",
    )


@sql_query("merged_coefficients", "events")
def merged_coefficients(d):
    """One coefficient over folds: the mean weighted by cells."""
    return _panel(d, O.strip_folds(), _FOLDED, "fits AS (SELECT fold, count(*) AS n, covar_pop(a, obs) / nullif(var_pop(a), 0) AS slope FROM x WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY fold)", select="SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * slope) / sum(n), 8) AS slope, round(min(slope), 8) AS lowest, round(max(slope), 8) AS highest FROM fits WHERE slope IS NOT NULL")


@sql_query("zero_pattern_check", "events")
def zero_pattern(d):
    """Cells where a scaled product and the product itself disagree on being dry."""
    return _panel(d, select=f"SELECT station_id, {_n()} AS n, round(avg(CASE WHEN (a < {_WET}) = (0.8e0 * a < {_WET}) THEN 1e0 ELSE 0e0 END), 8) AS same, CAST(sum(CASE WHEN a >= {_WET} AND 0.8e0 * a < {_WET} THEN 1 ELSE 0 END) AS BIGINT) AS dried FROM panel WHERE a IS NOT NULL GROUP BY station_id")


@sql_query("other_products_label", "events")
def other_products(d):
    return _panel(d, select=f"SELECT station_id, t, CASE WHEN b IS NULL AND c IS NULL THEN 'unknown' WHEN CASE WHEN b >= {_WET} THEN 1 ELSE 0 END + CASE WHEN c >= {_WET} THEN 1 ELSE 0 END = 0 THEN 'all_dry' WHEN CASE WHEN b < {_WET} THEN 1 ELSE 0 END + CASE WHEN c < {_WET} THEN 1 ELSE 0 END = 0 THEN 'all_wet' ELSE 'split' END AS label FROM panel WHERE obs IS NOT NULL")


@sql_query("hour_context", "events")
def hour_context(d):
    """Number of the met-day, hour of day and hours since the first one."""
    return _hours(d, "axis_of AS (SELECT DISTINCT h FROM hours)", select=f"SELECT h, CAST(dense_rank() OVER (ORDER BY {_DAY}) AS BIGINT) AS day_number, h % 24 AS hour, h - min(h) OVER () AS since_first FROM axis_of")


@sql_query("shifted_fields", "events")
def shifted_fields(d):
    """Values an hour before and after; the own one where that is missing."""
    return _hours(d, select=f"SELECT station_id, h, {T.shifted('a', 1, 'before')}, {T.shifted('a', -1, 'after')} FROM hours WHERE a IS NOT NULL")


# --- labels and scalar expressions


@sql_query("class_labels", "events")
def class_labels(d):
    """Intensity, false-alarm and relief classes, and labels of thresholds."""
    label = "replace(replace(CAST(CAST(floor(coalesce(obs, 0e0)) + 0.5e0 AS DECIMAL(8, 1)) AS VARCHAR(12)), '.', 'p'), '-', 'm')"
    return _panel(d, select=f"SELECT station_id, t, {S.classed('obs', S.INTENSITY_EDGES)} AS intensity, {S.classed('obs', S.RAIN_EDGES)} AS rain, {S.relief_class('obs * 100')} AS relief, CASE WHEN obs * 100 < 500 THEN 'low' WHEN obs * 100 < 1000 THEN 'middle' ELSE 'high' END AS altitude, {label} AS threshold_label FROM panel WHERE obs IS NOT NULL")


@sql_query("calendar_labels", "events")
def calendar_labels(d):
    """Season, met-day and the feature time nine hours on."""
    h = d.hour_index("ts")
    return A.sql("x AS (SELECT event_id, ts FROM {events})", select=f"SELECT event_id, {S.season('month(ts)')} AS season, CAST(FLOOR(({h} - 9) / 24e0) AS BIGINT) AS met_day, {h} + 9 AS feature_hour, {S.hour_difference(f'({h} % 24)', '6')} AS from_six FROM x")


@sql_query("terrain_components", "events")
def terrain_components(d):
    """Sine and cosine of the aspect (0 where flat), wind and humidity of stations' stand-in values."""
    return A.sql(
        A.stations(), "v AS (SELECT station_id, (station_id * 37) % 360 AS aspect, ((station_id * 13) % 50) / 10e0 AS slope, (station_id % 11) - 5 AS u, (station_id % 7) - 3 AS w, 273.15e0 + station_id % 30 AS tk, 268.15e0 + station_id % 25 AS dk FROM stations)",
        select=f"SELECT station_id, round({S.aspect_component('sin', 'aspect', 'slope')}, 8) AS aspect_sin, round({S.aspect_component('cos', 'aspect', 'slope')}, 8) AS aspect_cos, round({S.wind_speed('u', 'w')}, 8) AS speed, round({S.wind_direction('u', 'w')}, 6) AS direction, round({S.relative_humidity('tk', 'dk')}, 6) AS humidity FROM v",
    )


@sql_query("vegetation_quality", "events")
def vegetation_quality(d):
    """Clean index, quality class and land class of stand-in records."""
    return A.sql(
        "v AS (SELECT event_id, CAST((event_id * 97) % 14000 - 2500 AS BIGINT) AS raw, event_id % 5 - 1 AS reliability, CASE event_id % 4 WHEN 0 THEN 'land (nothing else but land)' WHEN 1 THEN 'ocean coastlines and lake shorelines' WHEN 2 THEN 'shallow inland water' ELSE 'deep ocean' END AS mask FROM {events})",
        select=f"SELECT event_id, round({S.clean_ndvi('raw', 'reliability')}, 8) AS ndvi, CASE reliability WHEN 0 THEN 'good' WHEN 1 THEN 'marginal' WHEN 2 THEN 'snow_ice' WHEN 3 THEN 'cloudy' ELSE 'fill' END AS quality, CASE WHEN mask LIKE '%coast%' THEN 'coast' WHEN mask LIKE '%water%' OR mask LIKE '%ocean%' THEN 'water' WHEN mask LIKE '%land%' THEN 'land' ELSE 'unknown' END AS surface FROM v",
    )


@sql_query("bilinear_weights", "events")
def bilinear_weights(d):
    """Four neighbours of each station's place on the disc and their weights."""
    x, y = S.scan_angles("lon", "lat")
    return A.sql(
        A.stations(), f"seen AS (SELECT station_id, {S.grid_position(x)} AS px, {S.grid_position(y)} AS py FROM stations)",
        "corners AS (SELECT 0 AS i, 0 AS j UNION ALL SELECT 1, 0 UNION ALL SELECT 0, 1 UNION ALL SELECT 1, 1)",
        select="SELECT station_id, CAST(floor(px) AS BIGINT) + i AS ix, CAST(floor(py) AS BIGINT) + j AS iy, round((CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END), 5) AS w FROM seen CROSS JOIN corners",
    )


# --- report checks


@sql_query("silent_spell_totals", "events")
def silent_totals(d):
    """Products' totals over each long dry spell of a gauge."""
    dry = f"CASE WHEN obs IS NULL THEN NULL WHEN obs < {_WET} THEN 1 ELSE 0 END"
    return _hours(
        d, T.islands(dry), "long_dry AS (SELECT station_id, start, stop, length FROM islands WHERE flag = 1 AND length >= 168)",
        "summed AS (SELECT station_id, h, sum(a) OVER w AS run FROM hours WINDOW w AS (PARTITION BY station_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        select="SELECT s.station_id, s.start, s.length, round(e.run - coalesce(b.run, 0e0), 6) AS product_total FROM long_dry AS s JOIN summed AS e ON s.station_id = e.station_id AND s.stop = e.h LEFT JOIN summed AS b ON s.station_id = b.station_id AND s.start - 1 = b.h",
    )


@sql_query("silent_rule_sensitivity", "events")
def silent_sensitivity(d):
    """Silent spells found under several least numbers of wet days nearby."""
    dry = f"CASE WHEN obs IS NULL THEN NULL WHEN obs < {_WET} THEN 1 ELSE 0 END"
    return _hours(
        d, T.islands(dry), "spells AS (SELECT station_id, start, stop FROM islands WHERE flag = 1 AND length >= 72)", f"wet_days AS (SELECT {_DAY} AS day, avg(a) AS around FROM hours GROUP BY 1)",
        "met AS (SELECT s.station_id, s.start, sum(CASE WHEN w.around >= 0.02e0 THEN 1 ELSE 0 END) AS wet FROM spells AS s JOIN wet_days AS w ON w.day BETWEEN CAST(FLOOR((s.start - 9) / 24e0) AS BIGINT) AND CAST(FLOOR((s.stop - 9) / 24e0) AS BIGINT) GROUP BY s.station_id, s.start)",
        select=" UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS least_wet_days, {_n()} AS spells, CAST(count(DISTINCT station_id) AS BIGINT) AS stations FROM met WHERE wet >= {n}" for n in (2, 3, 5)),
    )


@sql_query("cross_report_gate", "events")
def cross_report(d):
    """Two reports' numbers of the same thing: the false alarms from cells and from station sums agree."""
    return _panel(
        d, f"one AS (SELECT sum(CASE WHEN a >= {_WET} AND obs < {_WET} THEN 1e0 ELSE 0e0 END) AS n FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL)",
        f"by_station AS (SELECT station_id, sum(CASE WHEN a >= {_WET} THEN 1e0 ELSE 0e0 END) - sum(CASE WHEN a >= {_WET} AND obs >= {_WET} THEN 1e0 ELSE 0e0 END) AS n FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY station_id)", "two AS (SELECT sum(n) AS n FROM by_station)",
        select="SELECT CAST(one.n AS BIGINT) AS cells, CAST(two.n AS BIGINT) AS stations, abs(one.n - two.n) <= 1e-10 * greatest(abs(one.n), abs(two.n)) AS agree FROM one CROSS JOIN two",
    )


@sql_query("metric_gate", "events")
def metric_gate(d):
    """A pooled score against the one rebuilt from stations' sums."""
    return _panel(
        d, "pooled AS (SELECT sqrt(avg(power(a - obs, 2))) AS rmse, count(*) AS n FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL)", "parts AS (SELECT sum(power(a - obs, 2)) AS sse, count(*) AS n FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY station_id)",
        select="SELECT CAST(max(p.n) AS BIGINT) AS n, round(max(p.rmse), 8) AS rmse, abs(max(p.rmse) - sqrt(sum(q.sse) / sum(q.n))) <= 1e-9 AS agrees FROM pooled AS p CROSS JOIN parts AS q",
    )


@sql_query("region_flags", "events")
def region_flags(d):
    """Regions with too few gauges are flagged."""
    return _panel(d, "r AS (SELECT CASE WHEN lon < 110e0 THEN 'west' WHEN lon < 111e0 THEN 'middle' ELSE 'east' END AS region, count(*) AS gauges FROM stations GROUP BY 1)", select="SELECT region, CAST(gauges AS BIGINT) AS gauges, gauges < 5 AS too_few FROM r")


@sql_query("report_invariants", "events")
def invariants(d):
    """Confusion counts add up to the cells of each station."""
    c = lambda o, s: f"sum(CASE WHEN obs {o} {_WET} AND a {s} {_WET} THEN 1 ELSE 0 END)"
    return _panel(d, select=f"SELECT station_id, {_n()} AS n, {c('>=', '>=')} + {c('>=', '<')} + {c('<', '>=')} + {c('<', '<')} = count(*) AS adds_up FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY station_id")


@sql_query("run_invariance", "events")
def run_invariance(d):
    """Old rows that a new run lacks or changes."""
    return _panel(
        d, "old AS (SELECT station_id, t, a FROM panel WHERE t % 2 = 0)", "new AS (SELECT station_id, t, a + CASE WHEN station_id % 50 = 0 THEN 1e0 ELSE 0e0 END AS a FROM panel)",
        select="SELECT coalesce(o.station_id, n.station_id) AS station_id, CAST(sum(CASE WHEN n.t IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN o.a IS DISTINCT FROM n.a AND o.t IS NOT NULL AND n.t IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS changed, CAST(sum(CASE WHEN o.t IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS added FROM old AS o FULL OUTER JOIN new AS n ON o.station_id = n.station_id AND o.t = n.t GROUP BY 1",
    )


@sql_query("archive_longitudes", "events")
def archive_longitudes(d):
    """Files by the sub-satellite longitude in their names."""
    name = "concat('DISK_', CAST(1230 + (event_id % 3) * 100 AS VARCHAR(6)), 'E_', CAST(event_id AS VARCHAR(20)))"
    return A.sql(f"files AS (SELECT {name} AS path FROM {{events}})", f"parsed AS (SELECT CAST({d.extract('path', '_([0-9]+)E_', 1)} AS DOUBLE) / 10 AS lon FROM files)", select=f"SELECT lon, {_n()} AS files FROM parsed GROUP BY lon")


@sql_query("band_axes", "events")
def band_axes(d):
    """One cell's bands on several axes."""
    return _panel(d, select=f"SELECT station_id, t, {S.agreement_band(('a', 'b', 'c'))} AS agreement, {S.classed('greatest(a, b, c)', S.ENVELOPE_EDGES)} AS envelope, {S.classed('a', S.RAIN_EDGES)} AS product, CAST(FLOOR(t / 30e0) AS BIGINT) AS period FROM panel WHERE {_ALL}")


@sql_query("gram_error", "events")
def gram_error(d):
    """Squared error of weights from sums of products: yy - 2 w'r + w'Gw."""
    return _panel(
        d, f"g AS (SELECT sum(obs * obs) AS yy, sum(a * obs) AS ra, sum(b * obs) AS rb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, count(*) AS n FROM panel WHERE {_ALL})", "w AS (SELECT 0.5e0 AS wa, 0.5e0 AS wb UNION ALL SELECT 1e0, 0e0 UNION ALL SELECT 0.2e0, 0.3e0)",
        select="SELECT wa, wb, CAST(n AS BIGINT) AS n, round(yy - 2 * (wa * ra + wb * rb) + wa * wa * aa + 2 * wa * wb * ab + wb * wb * bb, 6) AS sse FROM g CROSS JOIN w",
    )


@sql_query("convex_combiner", "events")
def convex(d):
    """Weight of two sources that add up to 1, in closed form from the sums of products, kept in 0 to 1, by fold left out."""
    return _panel(
        d, O.strip_folds(), _FOLDED, f"g AS (SELECT fold, sum((obs - b) * (a - b)) AS u, sum((a - b) * (a - b)) AS v FROM x WHERE {_ALL} GROUP BY fold)", "s AS (SELECT sum(u) AS u, sum(v) AS v FROM g)",
        select="SELECT g.fold, round(least(greatest((s.u - g.u) / nullif(s.v - g.v, 0), 0e0), 1e0), 8) AS weight FROM g CROSS JOIN s",
    )


@sql_query("candidate_grid", "events")
def candidate_grid(d):
    """Kernels by family and bandwidth."""
    kernels = " UNION ALL ".join(f"SELECT '{k}' AS kernel" for k in S.KERNELS)
    return A.sql(f"k AS ({kernels})", "b AS (SELECT 'adaptive' AS family, 30e0 AS bw UNION ALL SELECT 'adaptive', 50e0 UNION ALL SELECT 'fixed', 10e0 UNION ALL SELECT 'fixed', 50e0 UNION ALL SELECT 'fixed', NULL)", select="SELECT kernel, family, bw FROM k CROSS JOIN b WHERE (SELECT count(*) FROM {events}) > 0")


@sql_query("tuning_regret", "events")
def tuning_regret(d):
    """What choosing by the wettest days' error costs on all days."""
    tall = " UNION ALL ".join(f"SELECT '{c}' AS method, sqrt(avg(power({c} - obs, 2))) AS whole, sqrt(avg(CASE WHEN obs >= 8e0 THEN power({c} - obs, 2) END)) AS tuned FROM panel WHERE {_ALL}" for c in ("a", "b", "c"))
    return _panel(d, f"s AS ({tall})", "best AS (SELECT min(whole) AS whole FROM s)", "chosen AS (SELECT method, whole FROM (SELECT *, row_number() OVER (ORDER BY tuned, method) AS rn FROM s) AS r WHERE rn = 1)", select="SELECT c.method, round(c.whole - b.whole, 8) AS regret FROM chosen AS c CROSS JOIN best AS b")


@sql_query("grid_support_summary", "events")
def grid_support(d):
    """Headline numbers of the grid-support report in one table."""
    return _panel(
        d, _PLACED, O.pairs(), "near AS (SELECT target, min(km) AS km FROM pairs GROUP BY target)",
        select="SELECT 'stations' AS item, CAST(count(*) AS DOUBLE) AS value FROM stations UNION ALL SELECT 'fine cells', CAST(count(DISTINCT ci * 100000 + cj) AS DOUBLE) FROM placed UNION ALL SELECT 'coarse cells', CAST(count(DISTINCT di * 100000 + dj) AS DOUBLE) FROM placed "
        f"UNION ALL SELECT 'median nearest km', round({d.percentile('km', 0.5)}, 6) FROM near UNION ALL SELECT 'farthest nearest km', round(max(km), 6) FROM near UNION ALL SELECT 'cells with rain', CAST(sum(CASE WHEN obs >= {_WET} THEN 1 ELSE 0 END) AS DOUBLE) FROM panel",
    )


@sql_query("fusion_against_gauges", "events")
def fusion_against_gauges(d):
    """Fused product against gauges alone by fold, with Holm's correction over the family of folds (sign test by days)."""
    return _panel(
        d, O.strip_folds(), _FOLDED, f"daily AS (SELECT fold, t, avg(power((a + b) / 2 - obs, 2)) - avg(power(a - obs, 2)) AS gain FROM x WHERE {_ALL} GROUP BY fold, t)",
        "tests AS (SELECT fold, count(*) AS days, avg(CASE WHEN gain < 0 THEN 1e0 ELSE 0e0 END) AS better, exp(-2 * count(*) * power(avg(CASE WHEN gain < 0 THEN 1e0 ELSE 0e0 END) - 0.5e0, 2)) AS p FROM daily GROUP BY fold)",
        "ranked AS (SELECT *, row_number() OVER (ORDER BY p, fold) AS rn, count(*) OVER () AS m FROM tests)",
        select="SELECT fold, CAST(days AS BIGINT) AS days, round(better, 8) AS better, round(max(least(1e0, (m - rn + 1) * p)) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS holm FROM ranked",
    )


@sql_query("anchor_comparison", "events")
def anchor_comparison(d):
    """All anchors on the cells that every one of them has."""
    return _panel(d, select=" UNION ALL ".join(f"SELECT '{c}' AS anchor, {R.scores('obs', c, 8)} FROM panel WHERE {_ALL}" for c in ("a", "b", "c")))


@sql_query("interpolation_ranking", "events")
def interpolation_ranking(d):
    return _panel(
        d, _CELLS, O.pairs(), O.candidates(8), O.idw(), O.adw(), "preds AS (SELECT i.target, i.t, i.y0, i.pred AS idw, w.pred AS adw FROM idw AS i JOIN adw AS w ON i.target = w.target AND i.t = w.t)",
        f"s AS (SELECT 'idw' AS method, {R.scores('y0', 'idw')} FROM preds UNION ALL SELECT 'adw' AS method, {R.scores('y0', 'adw')} FROM preds)",
        select="SELECT method, n, rmse, mae, CAST(row_number() OVER (ORDER BY rmse, mae, method) AS BIGINT) AS place FROM s",
    )


@sql_query("detection_skill", "events")
def detection_skill(d):
    """Event skill of each product less that of the first, by threshold."""
    tall = " UNION ALL ".join(f"SELECT '{c}' AS product, {S.num(x)} AS threshold, {R.event_scores('obs', c, x, 9)} FROM panel WHERE {_ALL}" for c in ("a", "b", "c") for x in (0.1, 2.5, 8.0))
    return _panel(d, f"s AS ({tall})", select="SELECT x.product, x.threshold, x.hits, round(x.pod - y.pod, 8) AS pod, round(x.far - y.far, 8) AS far, round(x.csi - y.csi, 8) AS csi FROM s AS x JOIN s AS y ON x.threshold = y.threshold AND y.product = 'a' WHERE x.product <> 'a'")


@sql_query("head_to_head", "events")
def head_to_head(d):
    """Daily error of two anchors: how often each wins, and the mean difference."""
    return _panel(d, f"daily AS (SELECT t, avg(power(a - obs, 2)) AS ea, avg(power(b - obs, 2)) AS eb FROM panel WHERE {_ALL} GROUP BY t)", select=f"SELECT {_n()} AS days, CAST(sum(CASE WHEN ea < eb THEN 1 ELSE 0 END) AS BIGINT) AS first_wins, CAST(sum(CASE WHEN eb < ea THEN 1 ELSE 0 END) AS BIGINT) AS second_wins, round(avg(ea - eb), 7) AS difference FROM daily")


# --- panels of the selection


def settled(rounds: int, days: int, stations: int, periods: int) -> list[str]:
    """Table expressions of ``rounds`` rounds of: stations with enough days and periods, days with enough stations."""
    steps, now = ["q0 AS (SELECT station_id, t, CAST(FLOOR(t / 16e0) AS BIGINT) AS period, obs, a, b FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL)"], "q0"
    for i in range(1, rounds + 1):
        steps += [
            f"qs{i} AS (SELECT station_id FROM {now} GROUP BY station_id HAVING count(*) >= {days} AND count(DISTINCT period) >= {periods})", f"qu{i} AS (SELECT x.* FROM {now} AS x JOIN qs{i} AS s ON x.station_id = s.station_id)",
            f"qd{i} AS (SELECT t FROM qu{i} GROUP BY t HAVING count(*) >= {stations})", f"q{i} AS (SELECT u.* FROM qu{i} AS u JOIN qd{i} AS z ON u.t = z.t)",
        ]
        now = f"q{i}"
    return steps


@sql_query("vegetation_panel", "events")
def vegetation_panel(d):
    """Means by station and period of 16 days."""
    return _panel(d, select=f"SELECT station_id, CAST(FLOOR(t / 16e0) AS BIGINT) AS period, {_n('obs')} AS n, round(avg(obs), 8) AS y, round(avg(a), 8) AS x FROM panel GROUP BY 1, 2 HAVING count(obs) >= 2 AND count(a) >= 2")


@sql_query("joint_panel_weights", "events")
def joint_panel(d):
    """Hour-centred values with weights that are equal by period within a station, and by station."""
    return _panel(
        d, "x AS (SELECT station_id, t, CAST(FLOOR(t / 16e0) AS BIGINT) AS period, obs - a AS r, b, b - avg(b) OVER (PARTITION BY t) AS z FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)",
        "periods AS (SELECT station_id, count(DISTINCT period) AS n FROM x GROUP BY station_id)",
        select="SELECT x.station_id, x.t, round(x.r, 8) AS r, round(x.z, 8) AS z, round(1e0 / (p.n * count(*) OVER (PARTITION BY x.station_id, x.period)), 8) AS w FROM x JOIN periods AS p ON x.station_id = p.station_id",
    )


@sql_query("panel_moments", "events")
def panel_moments(d):
    """Weighted mean and deviation of a covariate, its weighted correlation with the residual."""
    return _panel(
        d, "x AS (SELECT station_id, obs - a AS r, b, 1e0 / count(*) OVER (PARTITION BY station_id) AS w FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)", "m AS (SELECT sum(w * r) / sum(w) AS mr, sum(w * b) / sum(w) AS mb FROM x)",
        select=f"SELECT {_n()} AS n, round(max(mb), 8) AS mean, round(sqrt(sum(w * power(b - mb, 2)) / sum(w)), 8) AS deviation, round(sum(w * (r - mr) * (b - mb)) / nullif(sqrt(sum(w * power(r - mr, 2)) * sum(w * power(b - mb, 2))), 0), 8) AS r FROM x CROSS JOIN m",
    )
