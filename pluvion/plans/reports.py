"""Queries of occurrence, spells, events, days and the diurnal cycle."""

from __future__ import annotations

from ..functions import scalar as S
from ..operators import relational as R
from ..operators import series as T
from ..operators import spatial as O
from . import adapter as A
from .catalogue import sql_query

_WET = S.num(S.WET)
_HOUR, _DAY = "(h % 24)", "CAST(FLOOR((h - 9) / 24e0) AS BIGINT)"


def _hours(d, *steps, select):
    return A.sql(A.stations(), A.hours(d), *steps, select=select)


@sql_query("hours_to_rain", "events")
def hours_to_rain(d):
    return _hours(d, T.hours_to_rain(d), select="SELECT station_id, h, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CAST(open_before AS BIGINT) AS open_before, CAST(open_after AS BIGINT) AS open_after FROM to_rain WHERE obs IS NOT NULL")


_NEAREST = "CASE WHEN before IS NULL THEN after WHEN after IS NULL THEN before ELSE least(before, after) END"


@sql_query("proximity_labels", "events")
def proximity_labels(d):
    label = f"CASE WHEN obs IS NULL THEN 'missing' WHEN ({_NEAREST}) = 0 AND obs >= {_WET} THEN 'wet' WHEN open_before + open_after > 0 THEN 'open' WHEN ({_NEAREST}) IS NULL THEN 'none' WHEN ({_NEAREST}) <= 1 THEN '1' WHEN ({_NEAREST}) <= 3 THEN '2-3' WHEN ({_NEAREST}) <= 6 THEN '4-6' WHEN ({_NEAREST}) <= 24 THEN '7-24' ELSE '>24' END"
    return _hours(d, T.hours_to_rain(d), f"labelled AS (SELECT station_id, {label} AS label FROM to_rain)", select="SELECT station_id, label, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY station_id, label")


@sql_query("side_labels", "events")
def side_labels(d):
    b, a = "(before IS NOT NULL AND before <= 3 AND open_before = 0)", "(after IS NOT NULL AND after <= 3 AND open_after = 0)"
    label = f"CASE WHEN obs IS NULL THEN 0 WHEN obs >= {_WET} THEN 5 WHEN {b} AND {a} THEN 3 WHEN {b} THEN 2 WHEN {a} THEN 1 ELSE 4 END"
    return _hours(d, T.hours_to_rain(d), f"labelled AS (SELECT {_HOUR} AS hour, {label} AS side, obs, station_id FROM to_rain)", select="SELECT CAST(hour AS BIGINT) AS hour, CAST(side AS BIGINT) AS side, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY hour, side")


_DRY = f"CASE WHEN obs IS NULL THEN NULL WHEN obs < {_WET} THEN 1 ELSE 0 END"


@sql_query("dry_spells", "events")
def dry_spells(d):
    return _hours(d, T.islands(_DRY), select="SELECT station_id, CAST(flag AS BIGINT) AS dry, start, stop, length, CAST(censored AS BIGINT) AS censored FROM islands")


@sql_query("dry_spell_hist", "events")
def dry_spell_hist(d):
    bins = S.classed("length", (2, 4, 7, 13, 25, 49, 97, 193))
    return _hours(
        d, T.islands(_DRY), f"binned AS (SELECT *, {bins} AS bin FROM islands WHERE flag = 1)",
        select=f"SELECT bin, CAST(count(*) AS BIGINT) AS spells, CAST(sum(length) AS BIGINT) AS hours, CAST(sum(censored) AS BIGINT) AS censored, round({d.percentile('length', 0.5)}, 6) AS median FROM binned GROUP BY bin",
    )


_DAILY = f"daily AS (SELECT station_id, {_DAY} AS day, CASE WHEN count(obs) = 24 THEN sum(obs) END AS total, CAST(count(obs) AS BIGINT) AS known, sum(a) AS a FROM hours GROUP BY 1, 2)"


@sql_query("daily_sums", "events")
def daily_sums(d):
    return _hours(d, _DAILY, select="SELECT station_id, day, round(total, 6) AS total, known FROM daily")


@sql_query("silent_gauge", "events")
def silent_gauge(d):
    """Runs of three dry days or more while the nearest reporting neighbours' median is wet on one at least."""
    return _hours(
        d, _DAILY, O.pairs(),
        "reports AS (SELECT station_id, day AS t, total AS y FROM daily WHERE total IS NOT NULL)",
        O.nearest_reporting(5, "SELECT station_id AS target, day AS t FROM daily"),
        f"around AS (SELECT target, t AS day, {d.percentile('y', 0.5)} AS median FROM met GROUP BY target, t)",
        "flags AS (SELECT x.station_id, x.day AS h, CASE WHEN x.total IS NULL THEN NULL WHEN x.total < 0.1e0 THEN 1 ELSE 0 END AS dry, m.median FROM daily AS x LEFT JOIN around AS m ON x.station_id = m.target AND x.day = m.day)",
        T.islands("dry", "flags"),
        select="SELECT i.station_id, i.start, i.stop, i.length, CAST(sum(CASE WHEN f.median >= 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS wet_around FROM islands AS i JOIN flags AS f ON i.station_id = f.station_id AND f.h BETWEEN i.start AND i.stop WHERE i.flag = 1 AND i.length >= 3 GROUP BY i.station_id, i.start, i.stop, i.length",
    )


@sql_query("rain_events", "events")
def rain_events(d):
    return _hours(d, T.rain_events(), select="SELECT station_id, event, start, stop, round(total, 6) AS total, round(peak, 6) AS peak, CAST(complete AS BIGINT) AS complete FROM events_of")


_SCORED = (
    "cells_in AS (SELECT w.station_id, w.event, w.start, w.stop, x.h, x.obs, x.a, row_number() OVER (PARTITION BY w.station_id, w.event ORDER BY coalesce(x.obs, -1e0) DESC, x.h) AS by_obs, row_number() OVER (PARTITION BY w.station_id, w.event ORDER BY coalesce(x.a, -1e0) DESC, x.h) AS by_sat "
    "FROM windows AS w JOIN hours AS x ON w.station_id = x.station_id AND x.h BETWEEN w.low AND w.high), "
    f"scored AS (SELECT station_id, event, start, stop, sum(obs) AS obs_total, sum(a) AS sat_total, max(CASE WHEN a >= {_WET} THEN 1 ELSE 0 END) AS detected, "
    f"CASE WHEN max(CASE WHEN a >= {_WET} THEN 1 ELSE 0 END) = 1 THEN max(CASE WHEN by_sat = 1 THEN h END) - max(CASE WHEN by_obs = 1 THEN h END) END AS peak_error, "
    f"min(CASE WHEN a >= {_WET} THEN h END) - start AS onset_error, max(CASE WHEN a >= {_WET} THEN h END) - stop AS end_error, "
    "sum(a * h) / nullif(sum(a), 0) - sum(obs * h) / nullif(sum(obs), 0) AS centroid_error FROM cells_in GROUP BY station_id, event, start, stop)"
)


@sql_query("event_scores", "events")
def event_scores(d):
    return _hours(d, T.rain_events(), T.scoring_windows(), _SCORED, select="SELECT station_id, event, round(obs_total, 6) AS obs_total, round(sat_total, 6) AS sat_total, CAST(detected AS BIGINT) AS detected, CAST(peak_error AS BIGINT) AS peak_error, CAST(onset_error AS BIGINT) AS onset_error, CAST(end_error AS BIGINT) AS end_error, round(centroid_error, 4) AS centroid_error FROM scored")


@sql_query("event_summary", "events")
def event_summary(d):
    cls = S.classed("obs_total", (2.0, 5.0, 10.0))
    return _hours(
        d, T.rain_events(), T.scoring_windows(), _SCORED, f"classed AS (SELECT *, {cls} AS class FROM scored)",
        select=f"SELECT class, CAST(count(*) AS BIGINT) AS events, round(avg(CAST(detected AS DOUBLE)), 6) AS detected, round({d.percentile('abs(peak_error)', 0.5)}, 6) AS median_peak_error, round(sum(sat_total) / nullif(sum(obs_total), 0), 6) AS bias FROM classed GROUP BY class",
    )


@sql_query("lagged_correlation", "events")
def lagged_correlation(d):
    return _hours(
        d, f"lags AS (SELECT {d.series('-3', '3')} AS lag_h)",
        select=f"SELECT x.station_id, CAST(lag_h AS BIGINT) AS lag_h, {R.correlation('x.obs', 'y.a', 10)} AS r FROM hours AS x CROSS JOIN lags JOIN hours AS y ON x.station_id = y.station_id AND y.h = x.h + lag_h GROUP BY x.station_id, lag_h",
    )


@sql_query("best_lag", "events")
def best_lag(d):
    return _hours(
        d, f"lags AS (SELECT {d.series('-3', '3')} AS lag_h)",
        f"by_lag AS (SELECT x.station_id, lag_h, {R.correlation('x.obs', 'y.a', 10)} AS r FROM hours AS x CROSS JOIN lags JOIN hours AS y ON x.station_id = y.station_id AND y.h = x.h + lag_h GROUP BY x.station_id, lag_h)",
        select="SELECT station_id, CAST(lag_h AS BIGINT) AS lag_h, r FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY r DESC, abs(lag_h), lag_h) AS rn FROM by_lag WHERE r IS NOT NULL) AS b WHERE rn = 1",
    )


_LABELLED = f"labelled AS (SELECT h.station_id, h.h, h.obs, h.a, h.b, h.c, CASE WHEN s.lon < 110.5e0 THEN 'west' ELSE 'east' END AS region, CASE WHEN {_HOUR} BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS half, {S.classed('h.obs', S.INTENSITY_EDGES)} AS class_obs, {S.classed('h.a', S.INTENSITY_EDGES)} AS class_sat FROM hours AS h JOIN stations AS s ON h.station_id = s.station_id WHERE h.obs IS NOT NULL AND h.a IS NOT NULL)"
_CUBE = "coalesce(region, 'all') AS region, coalesce(half, 'all') AS half"


@sql_query("coverage_cube", "events")
def coverage_cube(d):
    return _hours(d, _LABELLED, select=f"SELECT {_CUBE}, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT station_id) AS BIGINT) AS stations, CAST(count(DISTINCT {_DAY}) AS BIGINT) AS days FROM labelled GROUP BY CUBE (region, half)")


@sql_query("intensity_confusion_cube", "events")
def intensity_confusion(d):
    return _hours(d, _LABELLED, select=f"SELECT {_CUBE}, class_obs, class_sat, CAST(count(*) AS BIGINT) AS n, round(sum(a - obs), 4) AS error FROM labelled GROUP BY class_obs, class_sat, CUBE (region, half)")


@sql_query("false_alarm_cube", "events")
def false_alarm_cube(d):
    bins = S.classed("a", (0.1, 0.2, 0.5, 1.0, 2.0, 4.0, 8.0))
    return _hours(d, _LABELLED, f"dry AS (SELECT *, {bins} AS bin FROM labelled WHERE obs < {_WET})", select=f"SELECT {_CUBE}, bin, CAST(count(*) AS BIGINT) AS n, round(sum(a), 4) AS amount FROM dry GROUP BY bin, CUBE (region, half)")


@sql_query("diurnal_cycle", "events")
def diurnal_cycle(d):
    return _hours(d, _LABELLED, select=f"SELECT coalesce(region, 'all') AS region, CAST({_HOUR} AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n, round(avg(obs), 8) AS obs, round(avg(a), 8) AS sat, round(avg(CASE WHEN obs >= {_WET} THEN 1e0 ELSE 0e0 END), 8) AS wet_share FROM labelled GROUP BY {_HOUR}, ROLLUP (region)")


@sql_query("diurnal_phase", "events")
def diurnal_phase(d):
    """Hour of the first harmonic's maximum by least squares over the 24 hourly means."""
    angle = "(2 * pi() * hour / 24e0)"
    det, x0, x1, x2 = R.solve3(("count(*)", f"sum(cos{angle})", f"sum(sin{angle})", f"sum(cos{angle} * cos{angle})", f"sum(cos{angle} * sin{angle})", f"sum(sin{angle} * sin{angle})"), ("sum(y)", f"sum(y * cos{angle})", f"sum(y * sin{angle})"))
    return _hours(
        d, f"means AS (SELECT station_id, {_HOUR} AS hour, avg(obs) AS y FROM hours WHERE obs IS NOT NULL GROUP BY 1, 2)",
        f"fitted AS (SELECT station_id, {x1} / {det} AS c, {x2} / {det} AS s, {x0} / {det} AS mean FROM means GROUP BY station_id HAVING count(*) = 24)",
        select=f"SELECT station_id, round(mean, 6) AS mean, round(sqrt(c * c + s * s), 6) AS amplitude, CASE WHEN c * c + s * s > 1e-9 THEN round({S.pmod('atan2(s, c) * 12 / pi()', '24')}, 4) END AS phase FROM fitted",
    )


@sql_query("station_correlation", "events")
def station_correlation(d):
    wet = f"(obs >= {_WET} OR a >= {_WET})"
    return _hours(
        d, f"ranked AS (SELECT station_id, obs, a, {R.tied_rank('obs', 'station_id')} AS ro, {R.tied_rank('a', 'station_id')} AS ra FROM hours WHERE obs IS NOT NULL AND a IS NOT NULL AND {wet})",
        select=f"SELECT station_id, CAST(count(*) AS BIGINT) AS n, {R.correlation('obs', 'a', 3, 5)} AS r, {R.correlation('ro', 'ra', 3, 5)} AS rho FROM ranked GROUP BY station_id",
    )


@sql_query("spearman_ties", "events")
def spearman_ties(d):
    return A.sql(A.stations(), A.panel(d), f"ranked AS (SELECT t, {R.tied_rank('obs', 't')} AS ro, {R.tied_rank('a', 't')} AS ra FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL)", select=f"SELECT t, CAST(count(*) AS BIGINT) AS n, {R.correlation('ro', 'ra', 3)} AS rho FROM ranked GROUP BY t")


@sql_query("regional_series", "events")
def regional_series(d):
    """Regional means where most stations report, in blocks of 1, 3 and 24 hours that are complete."""
    step = lambda k: f"SELECT region, CAST({k} AS BIGINT) AS step, CAST(FLOOR(h / {float(k)!r}e0) AS BIGINT) AS block, sum(obs) AS obs, sum(a) AS sat FROM series GROUP BY 1, 2, 3 HAVING count(*) = {k}"
    return _hours(
        d, _LABELLED, "sizes AS (SELECT CASE WHEN lon < 110.5e0 THEN 'west' ELSE 'east' END AS region, count(*) AS n FROM stations GROUP BY 1)",
        "series AS (SELECT l.region, h, avg(obs) AS obs, avg(a) AS a FROM labelled AS l JOIN sizes AS s ON l.region = s.region GROUP BY l.region, h HAVING count(*) >= 0.9e0 * max(s.n))",
        f"blocks AS ({' UNION ALL '.join(map(step, (1, 3, 24)))})",
        select=f"SELECT region, step, {R.scores('obs', 'sat')} FROM blocks GROUP BY region, step",
    )


@sql_query("network_wet_share", "events")
def network_wet_share(d):
    return _hours(d, "size AS (SELECT count(*) AS n FROM stations)", select=f"SELECT h, round(avg(CASE WHEN obs >= {_WET} THEN 1e0 ELSE 0e0 END), 6) AS share, CAST(count(*) AS BIGINT) AS reporting FROM hours CROSS JOIN size WHERE obs IS NOT NULL GROUP BY h HAVING count(*) >= 0.9e0 * max(size.n)")


@sql_query("occurrence_by_stratifier", "events")
def occurrence(d):
    c = lambda cond: f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"
    a_, b_, c_, d_ = c(f"obs >= {_WET} AND a >= {_WET}"), c(f"obs < {_WET} AND a >= {_WET}"), c(f"obs >= {_WET} AND a < {_WET}"), c(f"obs < {_WET} AND a < {_WET}")
    ratio = lambda x, y: f"round(({x}) * 1e0 / nullif({y}, 0), 6)"
    return _hours(
        d, _LABELLED, f"strata AS (SELECT *, 'region' AS kind, region AS level FROM labelled UNION ALL SELECT *, 'half', half FROM labelled UNION ALL SELECT *, 'hour', CAST({_HOUR} AS VARCHAR(4)) FROM labelled)",
        select=f"SELECT kind, level, CAST({a_} AS BIGINT) AS hits, CAST({b_} AS BIGINT) AS false_alarms, CAST({c_} AS BIGINT) AS misses, CAST({d_} AS BIGINT) AS dry, {ratio(b_, f'{b_} + {d_}')} AS pofd, {ratio(b_, f'{a_} + {b_}')} AS far, {ratio(f'{a_} + {b_}', f'{a_} + {c_}')} AS bias, {ratio(d_, f'{c_} + {d_}')} AS npv, "
        f"round({a_} * 1e0 / nullif({a_} + {c_}, 0) - {b_} * 1e0 / nullif({b_} + {d_}, 0), 6) AS pss, round(2e0 * ({a_} * 1e0 * {d_} - {b_} * 1e0 * {c_}) / nullif(({a_} + {c_}) * 1e0 * ({c_} + {d_}) + ({a_} + {b_}) * 1e0 * ({b_} + {d_}), 0), 6) AS hss FROM strata GROUP BY kind, level",
    )


@sql_query("paired_error", "events")
def paired_error(d):
    return _hours(
        d, _LABELLED, f"sides AS (SELECT CASE WHEN obs >= {_WET} THEN 'wet' ELSE 'dry' END AS side, sum(power(a - obs, 2)) AS sse_a, sum(power(b - obs, 2)) AS sse_b, count(*) AS n FROM labelled GROUP BY 1)",
        select="SELECT side, CAST(n AS BIGINT) AS n, round(sse_a, 3) AS sse_a, round(sse_b, 3) AS sse_b, round((sse_b - sse_a) / nullif(sum(sse_b - sse_a) OVER (), 0), 5) AS gap_share FROM sides",
    )


@sql_query("zero_threshold", "events")
def zero_threshold(d):
    return _hours(d, f"taus AS ({d.values('(0.0e0), (0.1e0), (0.5e0), (1.0e0), (2.0e0)', 'tau')})", select=f"SELECT tau, CAST(count(*) AS BIGINT) AS n, {R.event_scores('obs', 'CASE WHEN a < tau THEN 0e0 ELSE a END', S.WET)}, round(sqrt(avg(power(CASE WHEN a < tau THEN 0e0 ELSE a END - obs, 2))), 6) AS rmse FROM hours CROSS JOIN taus WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY tau")


@sql_query("phantom_extent", "events")
def phantom_extent(d):
    return _hours(
        d, f"by_hour AS (SELECT h, avg(CASE WHEN obs >= {_WET} THEN 1e0 ELSE 0e0 END) AS share, avg(CASE WHEN a >= {_WET} THEN 1e0 ELSE 0e0 END) AS claimed, sum(a) AS amount FROM hours WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY h)",
        select="SELECT CASE WHEN claimed < 0.01e0 THEN 'a' WHEN claimed < 0.05e0 THEN 'b' WHEN claimed < 0.25e0 THEN 'c' ELSE 'd' END AS extent, CAST(count(*) AS BIGINT) AS hours, round(sum(amount), 4) AS amount FROM by_hour WHERE share <= 0.02e0 GROUP BY 1",
    )


@sql_query("heavy_days", "events")
def heavy_days(d):
    return _hours(d, _DAILY, "size AS (SELECT count(*) AS n FROM stations)", select="SELECT day, CAST(count(*) AS BIGINT) AS stations, round(max(total), 6) AS highest, round(avg(total), 6) AS mean FROM daily WHERE total > 10e0 GROUP BY day HAVING count(*) >= 2")


@sql_query("rain_processes", "events")
def rain_processes(d):
    return _hours(
        d, _DAILY, "heavy AS (SELECT day, count(*) AS stations, sum(total) AS amount FROM daily WHERE total > 10e0 GROUP BY day)",
        "stepped AS (SELECT *, CASE WHEN day - lag(day) OVER (ORDER BY day) = 1 THEN 0 ELSE 1 END AS fresh FROM heavy)",
        "tagged AS (SELECT *, sum(fresh) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS process FROM stepped)",
        select="SELECT CAST(process AS BIGINT) AS process, min(day) AS first_day, max(day) AS last_day, CAST(count(*) AS BIGINT) AS days, round(sum(amount), 4) AS amount FROM tagged GROUP BY process",
    )


@sql_query("spatial_metrics", "events")
def spatial_metrics(d):
    return _hours(
        d, _DAILY, f"ranked AS (SELECT day, total, a, {R.tied_rank('total', 'day')} AS ro, {R.tied_rank('a', 'day')} AS ra FROM daily WHERE total IS NOT NULL AND a IS NOT NULL)",
        select=f"SELECT day, CAST(count(*) AS BIGINT) AS n, {R.correlation('total', 'a', 3, 5)} AS r, {R.correlation('ro', 'ra', 3, 5)} AS rho, round(stddev_pop(a) / nullif(stddev_pop(total), 0), 5) AS spread_ratio FROM ranked GROUP BY day",
    )


@sql_query("phase_metrics", "events")
def phase_metrics(d):
    """Accumulation phase: hours of the day at which half of the day's amount has fallen, gauge and product."""
    run = lambda c: f"sum({c}) OVER (PARTITION BY station_id, day ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return _hours(
        d, f"tagged AS (SELECT station_id, h, {_DAY} AS day, obs, a FROM hours WHERE obs IS NOT NULL AND a IS NOT NULL)",
        f"running AS (SELECT station_id, day, h, {run('obs')} AS ro, {run('a')} AS ra, sum(obs) OVER (PARTITION BY station_id, day) AS tobs, sum(a) OVER (PARTITION BY station_id, day) AS ta FROM tagged)",
        select="SELECT station_id, day, min(CASE WHEN ro >= 0.5e0 * tobs - 1e-9 THEN h END) - 24 * day - 9 AS obs_half, min(CASE WHEN ra >= 0.5e0 * ta - 1e-9 THEN h END) - 24 * day - 9 AS sat_half FROM running WHERE tobs > 0.5e0 AND ta > 0.5e0 GROUP BY station_id, day",
    )


@sql_query("deficit_attribution", "events")
def deficit_attribution(d):
    return A.sql(
        A.stations(), A.panel(d), O.pairs(), "nearby AS (SELECT p.target, x.t, max(x.a) AS highest FROM pairs AS p JOIN panel AS x ON p.source = x.station_id WHERE p.km <= 20e0 GROUP BY p.target, x.t)",
        "areal AS (SELECT t, avg(a) AS mean FROM panel GROUP BY t)",
        "parts AS (SELECT p.station_id, p.t, greatest(p.obs - p.a, 0e0) AS deficit, least(greatest(p.obs - p.a, 0e0), greatest(coalesce(n.highest, p.a) - p.a, 0e0)) AS displaced, least(greatest(p.obs - p.a, 0e0), greatest(r.mean - p.a, 0e0)) AS smoothed FROM panel AS p LEFT JOIN nearby AS n ON p.station_id = n.target AND p.t = n.t JOIN areal AS r ON p.t = r.t WHERE p.obs IS NOT NULL AND p.a IS NOT NULL)",
        select="SELECT station_id, t, round(deficit, 6) AS deficit, round(displaced, 6) AS displaced, round(smoothed, 6) AS smoothed, round(greatest(deficit - greatest(displaced, smoothed), 0e0), 6) AS missed FROM parts",
    )
