"""Queries of alignment, scores, fusion, blending, stacking, selection statistics and ingest."""

from __future__ import annotations

from ..functions import scalar as S
from ..operators import relational as R
from ..operators import series as T
from ..operators import spatial as O
from . import adapter as A
from .catalogue import sql_query

_WET = S.num(S.WET)
_ALL = "obs IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"


def _panel(d, *steps, select):
    return A.sql(A.stations(), A.panel(d), *steps, select=select)


# --- alignment and masks


@sql_query("panel_align", "events")
def panel_align(d):
    """Cells of stations and days that the observation and every product have."""
    has = lambda c: f"(SELECT DISTINCT station_id FROM panel WHERE {c} IS NOT NULL)"
    at = lambda c: f"(SELECT DISTINCT t FROM panel WHERE {c} IS NOT NULL)"
    return _panel(d, select=f"SELECT station_id, t, round(obs, 6) AS obs, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM panel WHERE {' AND '.join(f'station_id IN {has(x)} AND t IN {at(x)}' for x in ('obs', 'a', 'b', 'c'))}")


@sql_query("panel_common_mask", "events")
def common_mask(d):
    return _panel(d, select=f"SELECT station_id, t, CASE WHEN {_ALL} THEN TRUE ELSE FALSE END AS in_mask FROM panel")


@sql_query("complete_hours", "events")
def complete_hours(d):
    return A.sql(A.stations(), A.hours(d), select="SELECT h, bool_and(obs IS NOT NULL) AS complete, CAST(count(obs) AS BIGINT) AS reporting FROM hours GROUP BY h")


@sql_query("global_time_qc", "events")
def time_qc(d):
    return _panel(d, "times AS (SELECT DISTINCT t FROM panel)", select="SELECT times.t, " + ", ".join(f"max(CASE WHEN p.{c} IS NOT NULL THEN 1 ELSE 0 END) = 1 AS has_{c}" for c in ("obs", "a", "b", "c")) + " FROM times LEFT JOIN panel AS p ON times.t = p.t GROUP BY times.t")


@sql_query("availability_groups", "events")
def availability(d):
    """Days by the set of stations that report."""
    return _panel(d, f"sets AS (SELECT t, {d.list_sorted('station_id')} AS reporting FROM panel WHERE obs IS NOT NULL GROUP BY t)", select="SELECT md5(reporting) AS set_id, CAST(count(*) AS BIGINT) AS days, min(t) AS first_day FROM sets GROUP BY reporting")


@sql_query("unpivot_roundtrip", "events")
def unpivot(d):
    parts = " UNION ALL ".join(f"SELECT station_id, t, '{c}' AS product, {c} AS v FROM panel" for c in ("a", "b", "c"))
    return _panel(d, f"tall AS ({parts})", select="SELECT station_id, t, " + ", ".join(f"round(max(CASE WHEN product = '{c}' THEN v END), 6) AS {c}" for c in ("a", "b", "c")) + " FROM tall GROUP BY station_id, t")


@sql_query("long_to_wide_dupqc", "events")
def dup_qc(d):
    """Hourly means of each user and kind, with how many records and different values they come from."""
    h = d.hour_index("ts")
    return f"SELECT user_id, event_type, {h} + 9 AS h, CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT value) AS BIGINT) AS distinct_values, round(avg(value), 6) AS value FROM {{events}} GROUP BY user_id, event_type, {h}"


@sql_query("time_parse_formats", "events")
def time_parse(d):
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyyMMddHH")
    text = "CASE event_id % 5 WHEN 0 THEN '2022-06-01 05:00:00' WHEN 1 THEN '2022-06-01T06:00:00' WHEN 2 THEN '2022-06-01 07:00' WHEN 3 THEN '2022/06/01 08:00' ELSE 'none' END"
    return f"WITH texts AS (SELECT event_id, {text} AS txt FROM {{events}}) SELECT event_id, {d.hour_index(d.timestamp('txt', formats))} AS h FROM texts"


@sql_query("difference_report", "events", "customer")
def difference_report(d):
    return A.sql(
        A.stations(), "known AS (SELECT c_custkey AS station_id FROM {customer} WHERE c_acctbal > 0)",
        select="SELECT s.station_id, 'excluded' AS why FROM stations AS s LEFT JOIN known AS k ON s.station_id = k.station_id WHERE k.station_id IS NULL UNION ALL SELECT k.station_id, 'missing' FROM known AS k LEFT JOIN stations AS s ON s.station_id = k.station_id WHERE s.station_id IS NULL",
    )


# --- scores


@sql_query("metrics_continuous", "events")
def metrics_continuous(d):
    return _panel(d, select=" UNION ALL ".join(f"SELECT '{c}' AS product, {R.scores('obs', c)} FROM panel WHERE {_ALL}" for c in ("a", "b", "c")))


@sql_query("metrics_event", "events")
def metrics_event(d):
    return _panel(d, select=" UNION ALL ".join(f"SELECT '{c}' AS product, {S.num(x)} AS threshold, {R.event_scores('obs', c, x)} FROM panel" for c in ("a", "b", "c") for x in (0.1, 2.5, 8.0)))


_STRATA = f"strata AS (SELECT p.*, CASE WHEN s.lon < 110.5e0 THEN 'west' ELSE 'east' END AS region, {S.classed('p.obs', S.RAIN_EDGES)} AS rain, f.fold FROM panel AS p JOIN stations AS s ON p.station_id = s.station_id JOIN folds AS f ON p.station_id = f.station_id)"


@sql_query("cv_metrics_stratified", "events")
def cv_metrics(d):
    kinds = (("region", "region"), ("rain", "CAST(rain AS VARCHAR(4))"), ("fold", "CAST(fold AS VARCHAR(4))"), ("all", "'all'"))
    return _panel(d, O.strip_folds(), _STRATA, select=" UNION ALL ".join(f"SELECT '{k}' AS kind, {e} AS level, {R.scores('obs', 'a')} FROM strata WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY {e}" for k, e in kinds))


@sql_query("fold_spread", "events")
def fold_spread(d):
    return _panel(
        d, O.strip_folds(), _STRATA, "by_fold AS (SELECT fold, sqrt(avg(power(a - obs, 2))) AS rmse FROM strata WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY fold)",
        select="SELECT CAST(count(*) AS BIGINT) AS folds, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS spread, round(min(rmse), 6) AS lowest, round(max(rmse), 6) AS highest FROM by_fold",
    )


@sql_query("rank_stability", "events")
def rank_stability(d):
    tall = " UNION ALL ".join(f"SELECT t, '{c}' AS method, sqrt(avg(power({c} - obs, 2))) AS rmse FROM panel WHERE {_ALL} GROUP BY t" for c in ("a", "b", "c"))
    return _panel(
        d, f"tall AS ({tall})", "ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rmse, method) AS place FROM tall)",
        select="SELECT method, CAST(count(*) AS BIGINT) AS repeats, round(avg(CAST(place AS DOUBLE)), 6) AS mean_rank, CAST(min(place) AS BIGINT) AS best, CAST(max(place) AS BIGINT) AS worst, CAST(sum(CASE WHEN place = 1 THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM ranked GROUP BY method",
    )


@sql_query("mse_decomposition", "events")
def mse_decomposition(d):
    return _panel(
        d, "m AS (SELECT station_id, count(*) AS n, avg(obs) AS mo, avg(a) AS ma, avg(obs * obs) - avg(obs) * avg(obs) AS vo, avg(a * a) - avg(a) * avg(a) AS va, avg(obs * a) - avg(obs) * avg(a) AS cov, avg(power(a - obs, 2)) AS mse FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY station_id HAVING count(*) > 2)",
        select="SELECT station_id, CAST(n AS BIGINT) AS n, round(mse, 5) AS mse, round(power(ma - mo, 2), 5) AS bias_part, round(power(sqrt(greatest(va, 0e0)) - sqrt(greatest(vo, 0e0)), 2), 5) AS spread_part, round(2 * (sqrt(greatest(va, 0e0) * greatest(vo, 0e0)) - cov), 5) AS pattern_part FROM m",
    )


@sql_query("satellite_offset", "events")
def satellite_offset(d):
    return _panel(d, select="SELECT station_id, CAST(count(*) AS BIGINT) AS n, round(avg(obs - a), 6) AS offset_mean, round(sum(obs) / nullif(sum(a), 0), 6) AS ratio FROM panel WHERE obs IS NOT NULL AND a IS NOT NULL GROUP BY station_id")


@sql_query("satellite_rescale_oof", "events")
def rescale(d):
    """Each fold's product times the ratio that the other folds give."""
    return _panel(
        d, O.strip_folds(), "sums AS (SELECT f.fold, sum(p.obs) AS so, sum(p.a) AS sa FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id WHERE p.obs IS NOT NULL AND p.a IS NOT NULL GROUP BY f.fold)",
        "factors AS (SELECT x.fold, (sum(y.so) - x.so) / nullif(sum(y.sa) - x.sa, 0) AS factor FROM sums AS x CROSS JOIN sums AS y GROUP BY x.fold, x.so, x.sa)",
        select=f"SELECT f.fold, round(max(k.factor), 6) AS factor, {R.scores('p.obs', 'p.a * k.factor')} FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id JOIN factors AS k ON f.fold = k.fold WHERE p.obs IS NOT NULL AND p.a IS NOT NULL GROUP BY f.fold",
    )


@sql_query("null_predictors", "events")
def null_predictors(d):
    """Zero, the other folds' mean, and the day's mean over the other folds."""
    return _panel(
        d, O.strip_folds(), "x AS (SELECT p.station_id, p.t, p.obs, f.fold FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id WHERE p.obs IS NOT NULL)",
        "by_fold AS (SELECT fold, sum(obs) AS s, count(*) AS n FROM x GROUP BY fold)", "total AS (SELECT sum(s) AS s, sum(n) AS n FROM by_fold)",
        "by_day AS (SELECT t, sum(obs) AS s, count(*) AS n FROM x GROUP BY t)", "by_both AS (SELECT fold, t, sum(obs) AS s, count(*) AS n FROM x GROUP BY fold, t)",
        "preds AS (SELECT x.station_id, x.t, x.obs, 0e0 AS zero, (total.s - b.s) / nullif(total.n - b.n, 0) AS clim, (d.s - q.s) / nullif(d.n - q.n, 0) AS field FROM x JOIN by_fold AS b ON x.fold = b.fold CROSS JOIN total JOIN by_day AS d ON x.t = d.t JOIN by_both AS q ON x.t = q.t AND x.fold = q.fold)",
        select=" UNION ALL ".join(f"SELECT '{c}' AS method, {R.scores('obs', c)} FROM preds" for c in ("zero", "clim", "field")),
    )


@sql_query("mask_cost", "events")
def mask_cost(d):
    return _panel(d, select=" UNION ALL ".join(f"SELECT '{c}' AS product, CAST(count(*) AS BIGINT) AS own, CAST(sum(CASE WHEN {_ALL} THEN 1 ELSE 0 END) AS BIGINT) AS common, round(1 - sum(CASE WHEN {_ALL} THEN 1e0 ELSE 0e0 END) / count(*), 6) AS lost FROM panel WHERE obs IS NOT NULL AND {c} IS NOT NULL" for c in ("a", "b", "c")))


@sql_query("dropout", "events")
def dropout(d):
    return _panel(d, "by_day AS (SELECT t, count(*) AS n, count(a) AS k FROM panel GROUP BY t)", select="SELECT CASE WHEN k = 0 THEN 'whole' WHEN k < n THEN 'scattered' ELSE 'none' END AS kind, CAST(count(*) AS BIGINT) AS days, CAST(sum(n - k) AS BIGINT) AS cells FROM by_day GROUP BY 1")


@sql_query("run_comparison", "events")
def run_comparison(d):
    return _panel(
        d, f"one AS (SELECT station_id, {R.scores('obs', 'a')} FROM panel GROUP BY station_id)", f"two AS (SELECT station_id, {R.scores('obs', 'b')} FROM panel GROUP BY station_id)",
        select="SELECT coalesce(one.station_id, two.station_id) AS station_id, one.n AS n_one, two.n AS n_two, round(two.rmse - one.rmse, 5) AS change FROM one FULL OUTER JOIN two ON one.station_id = two.station_id",
    )


@sql_query("monthly_anomaly", "events")
def anomaly(d):
    return _panel(d, select="SELECT station_id, t, round(obs - avg(obs) OVER (PARTITION BY station_id, CAST(FLOOR(t / 30e0) AS BIGINT)), 6) AS anomaly FROM panel WHERE obs IS NOT NULL")


# --- fusion, blending, stacking


@sql_query("fusion_mean", "events")
def fusion_mean(d):
    return _panel(d, select="SELECT station_id, t, round((a + b + c) / 3, 6) AS fused FROM panel WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")


_FOLD_CELLS = f"x AS (SELECT p.*, f.fold FROM panel AS p JOIN folds AS f ON p.station_id = f.station_id WHERE {_ALL})"
_DESIGN = ["1e0", "a", "b", "c"]


@sql_query("fusion_ols_gram", "events")
def fusion_gram(d):
    names = [f"round(a{i}_{j}, 4) AS a{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"round(b{i}, 4) AS b{i}" for i in range(4)]
    return _panel(d, O.strip_folds(), _FOLD_CELLS, f"g AS (SELECT fold, {R.gram(_DESIGN, 'obs')} FROM x GROUP BY fold)", select=f"SELECT fold, n, {', '.join(names)} FROM g")


def _ols():
    terms = [f"a{i}_{j}" for i in range(4) for j in range(4)] + [f"b{i}" for i in range(4)]
    return (
        f"g AS (SELECT fold, {R.gram(_DESIGN, 'obs')} FROM x GROUP BY fold), "
        f"train AS (SELECT u.fold, {', '.join(f'sum(v.{c}) AS {c}' for c in terms)} FROM g AS u JOIN g AS v ON u.fold <> v.fold GROUP BY u.fold), " + R.eliminate("train", ["fold"], 4)
    )


@sql_query("fusion_ols_apply", "events")
def fusion_ols(d):
    """Least squares on the other folds, applied and cut at 0."""
    return _panel(d, O.strip_folds(), _FOLD_CELLS, _ols(), select="SELECT x.station_id, x.t, x.fold, round(greatest(s.x0 + s.x1 * x.a + s.x2 * x.b + s.x3 * x.c, 0e0), 5) AS fused FROM x JOIN train_solved AS s ON x.fold = s.fold")


@sql_query("fusion_coefficients", "events")
def fusion_coefficients(d):
    return _panel(d, O.strip_folds(), _FOLD_CELLS, _ols(), select="SELECT fold, round(x0, 5) AS x0, round(x1, 5) AS x1, round(x2, 5) AS x2, round(x3, 5) AS x3 FROM train_solved")


@sql_query("fusion_lag_neighbour_features", "events")
def lag_features(d):
    """Value, the hour before and after (own value over a gap) and the mean of the nearest eight, by station and hour."""
    return A.sql(
        A.stations(), A.hours(d), O.pairs(), f"shifted AS (SELECT station_id, h, a, {T.shifted('a', 1, 'before')}, {T.shifted('a', -1, 'after')} FROM hours)",
        "near8 AS (SELECT target, source FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY km, source) AS rn FROM pairs) AS r WHERE rn <= 8)",
        "around AS (SELECT n.target, x.h, avg(x.a) AS mean FROM near8 AS n JOIN hours AS x ON n.source = x.station_id GROUP BY n.target, x.h)",
        select="SELECT s.station_id, s.h, round(s.a, 6) AS a, round(s.before, 6) AS before, round(s.after, 6) AS after, round(coalesce(m.mean, s.a), 6) AS around FROM shifted AS s LEFT JOIN around AS m ON s.station_id = m.target AND s.h = m.h",
    )


_BAND = S.agreement_band(("a", "b", "c"))


@sql_query("agreement_band", "events")
def agreement_band(d):
    return _panel(d, select=f"SELECT station_id, t, {_BAND} AS band FROM panel WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL")


@sql_query("stack_band", "events")
def stack_band(d):
    return _panel(
        d, O.pairs(), "reach AS (SELECT target, min(km) AS km FROM pairs GROUP BY target)",
        select=f"SELECT p.station_id, p.t, {S.stack_band(f'({_BAND})', 'r.km')} AS band FROM panel AS p JOIN reach AS r ON p.station_id = r.target WHERE p.a IS NOT NULL OR p.b IS NOT NULL OR p.c IS NOT NULL",
    )


@sql_query("blend_constant", "events")
def blend_constant(d):
    return _panel(d, select=f"SELECT station_id, t, round({S.blend('a', 'b', 'c', S.num(0.3))}, 6) AS blended FROM panel")


_LAMBDAS = "lams AS (SELECT CAST(i AS DOUBLE) / 10 AS lam FROM ({}) AS s)"


@sql_query("blend_lambda_select", "events")
def blend_lambda(d):
    return _panel(
        d, _LAMBDAS.format(f"SELECT {d.series('0', '10')} AS i"), f"tried AS (SELECT lam, round(sqrt(avg(power({S.blend('a', 'b', 'c', 'lam')} - obs, 2))), 8) AS rmse, round(avg(abs({S.blend('a', 'b', 'c', 'lam')} - obs)), 8) AS mae FROM panel CROSS JOIN lams WHERE {_ALL} GROUP BY lam)",
        select="SELECT lam, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM (SELECT *, row_number() OVER (ORDER BY rmse, mae, lam) AS rn FROM tried) AS r WHERE rn = 1",
    )


@sql_query("blend_banded", "events")
def blend_banded(d):
    return _panel(
        d, _LAMBDAS.format(f"SELECT {d.series('0', '10')} AS i"), f"x AS (SELECT *, {_BAND} AS band FROM panel WHERE {_ALL})",
        "tried AS (SELECT band, lam, round(sum(power((1 - lam) * b + lam * c - obs, 2)), 6) AS sse, count(*) AS n FROM x CROSS JOIN lams WHERE band > 0 GROUP BY band, lam)",
        select="SELECT band, lam, CAST(n AS BIGINT) AS n, round(sse, 4) AS sse FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sse, lam) AS rn FROM tried) AS r WHERE rn = 1",
    )


@sql_query("stack_features", "events")
def stack_features(d):
    return A.sql(A.stations(), A.hours(d), f"f AS (SELECT station_id, h, a, b, c, {T.shifted('a', 1, 'a_before')}, {T.shifted('a', -1, 'a_after')}, {T.shifted('b', 1, 'b_before')}, {T.shifted('b', -1, 'b_after')} FROM hours)", select="SELECT station_id, h, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(a_before, 6) AS a_before, round(a_after, 6) AS a_after, round(b_before, 6) AS b_before, round(b_after, 6) AS b_after FROM f")


@sql_query("banded_gram", "events")
def banded_gram(d):
    return _panel(d, f"x AS (SELECT *, {_BAND} AS band FROM panel WHERE {_ALL})", f"g AS (SELECT band, {R.gram(['1e0', 'a', 'b'], 'obs')} FROM x GROUP BY band)", select="SELECT band, n, round(a0_1, 4) AS a0_1, round(a1_1, 4) AS a1_1, round(a1_2, 4) AS a1_2, round(b1, 4) AS b1, round(yy, 4) AS yy FROM g")


# --- selection statistics


_PVALUES = "p AS (SELECT user_id AS k, CAST((user_id * 7919) % 1000 + 1 AS DOUBLE) / 20000 AS p FROM (SELECT DISTINCT user_id FROM {events}) AS u)"


@sql_query("bh_adjust", "events")
def bh_adjust(d):
    return A.sql(_PVALUES, "r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS rn, count(*) OVER () AS m FROM p)", select="SELECT k, round(least(1e0, min(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM r")


@sql_query("holm_adjust", "events")
def holm_adjust(d):
    return A.sql(_PVALUES, "r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS rn, count(*) OVER () AS m FROM p)", select="SELECT k, round(max(least(1e0, (m - rn + 1) * p)) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS q FROM r")


@sql_query("hierarchical_weights", "events")
def hierarchical(d):
    """Each station weighs 1 in all, its ten-day periods alike, cells alike within one."""
    return _panel(
        d, "x AS (SELECT station_id, t, CAST(FLOOR(t / 10e0) AS BIGINT) AS period FROM panel WHERE obs IS NOT NULL)", "n AS (SELECT station_id, period, count(*) AS cells FROM x GROUP BY station_id, period)", "k AS (SELECT station_id, count(*) AS periods FROM n GROUP BY station_id)",
        select="SELECT x.station_id, x.t, round(1e0 / (n.cells * k.periods), 8) AS weight FROM x JOIN n ON x.station_id = n.station_id AND x.period = n.period JOIN k ON x.station_id = k.station_id",
    )


@sql_query("weighted_vif_gram", "events")
def vif_gram(d):
    return _panel(
        d, f"x AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY station_id) AS w FROM panel WHERE {_ALL})", "m AS (SELECT sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * c) / sum(w) AS mc FROM x)",
        select="SELECT round(sum(w * (a - ma) * (a - ma)), 4) AS aa, round(sum(w * (a - ma) * (b - mb)), 4) AS ab, round(sum(w * (a - ma) * (c - mc)), 4) AS ac, round(sum(w * (b - mb) * (b - mb)), 4) AS bb, round(sum(w * (b - mb) * (c - mc)), 4) AS bc, round(sum(w * (c - mc) * (c - mc)), 4) AS cc FROM x CROSS JOIN m",
    )


@sql_query("station_pair_moments", "events")
def pair_moments(d):
    return _panel(d, select="SELECT x.station_id AS one, y.station_id AS two, CAST(count(*) AS BIGINT) AS n, round(sum(x.obs * y.a), 8) AS xy, round(sum(x.obs), 8) AS sx, round(sum(y.a), 8) AS sy FROM panel AS x JOIN panel AS y ON x.t = y.t WHERE x.obs IS NOT NULL AND y.a IS NOT NULL AND x.station_id < y.station_id GROUP BY x.station_id, y.station_id")


@sql_query("hour_centred_panel", "events")
def hour_centred(d):
    return _panel(d, select="SELECT station_id, t, round(obs - avg(obs) OVER (PARTITION BY t), 6) AS centred, round(1e0 / count(*) OVER (PARTITION BY station_id), 8) AS weight FROM panel WHERE obs IS NOT NULL")


@sql_query("tuning_hour_sample", "events")
def tuning_hours(d):
    """Half the sample are the wettest days, half evenly spaced ones (halves round to even)."""
    spaced = d.round_even("1 + i * (n - 1) / 5e0")
    return _panel(
        d, "wetness AS (SELECT t, avg(obs) AS w FROM panel GROUP BY t)", "r AS (SELECT t, row_number() OVER (ORDER BY coalesce(w, -1e0) DESC, t) AS by_wet, row_number() OVER (ORDER BY t) AS by_time, count(*) OVER () AS n FROM wetness)",
        f"spots AS (SELECT DISTINCT CAST({spaced} AS BIGINT) AS spot FROM (SELECT {d.series('0', '5')} AS i) AS s CROSS JOIN (SELECT max(n) AS n FROM r) AS z)",
        select="SELECT t, CASE WHEN by_wet <= 6 THEN 'wet' ELSE 'spaced' END AS why FROM r WHERE by_wet <= 6 OR by_time IN (SELECT spot FROM spots)",
    )


@sql_query("mean_change_point", "events")
def change_point(d):
    run = "OVER (PARTITION BY station_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return _panel(
        d, f"x AS (SELECT station_id, t, row_number() OVER (PARTITION BY station_id ORDER BY t) AS i, count(*) OVER (PARTITION BY station_id) AS n, sum(obs) {run} AS s, sum(obs) OVER (PARTITION BY station_id) AS total FROM panel WHERE obs IS NOT NULL)",
        "g AS (SELECT *, round(i * (n - i) * power(s / i - (total - s) / nullif(n - i, 0), 2) / n, 6) AS gain FROM x WHERE i < n)",
        select="SELECT station_id, t, gain FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY gain DESC, t) AS rn FROM g) AS r WHERE rn = 1",
    )


@sql_query("block_bootstrap_days", "events")
def bootstrap_days(d):
    """Daily sums of squared errors that the day-block bootstrap resamples."""
    return _panel(d, select=f"SELECT t, CAST(count(*) AS BIGINT) AS n, round(sum(power(a - obs, 2)), 4) AS sse_a, round(sum(power(b - obs, 2)), 4) AS sse_b FROM panel WHERE {_ALL} GROUP BY t")


@sql_query("claim_assessment", "events")
def claim(d):
    """Does product b beat a and c by region, and over all by a margin?"""
    side = lambda e: f"SELECT {e} AS region, sqrt(avg(power(a - obs, 2))) AS ra, sqrt(avg(power(b - obs, 2))) AS rb, sqrt(avg(power(c - obs, 2))) AS rc FROM strata WHERE {_ALL} GROUP BY 1"
    return _panel(d, O.strip_folds(), _STRATA, f"s AS ({side('region')} UNION ALL {side(chr(39) + 'all' + chr(39))})", select="SELECT region, round(ra, 5) AS ra, round(rb, 5) AS rb, round(rc, 5) AS rc, rb < ra AND rb < rc AS beats, round((least(ra, rc) - rb) / nullif(least(ra, rc), 0), 5) AS margin FROM s")


# --- ingest


@sql_query("asof_expiry", "events")
def asof(d):
    """The latest earlier record of a kind for each day: from the next day on, for at most ten days."""
    latest = d.last_value("seen", "PARTITION BY station_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    return _panel(
        d, f"x AS (SELECT station_id, t, CASE WHEN c IS NOT NULL THEN t END AS seen FROM panel)", f"y AS (SELECT station_id, t, {latest} AS source FROM x)",
        select="SELECT y.station_id, y.t, CASE WHEN y.t < y.source + 1 + 10 THEN y.source END AS source, round(CASE WHEN y.t < y.source + 1 + 10 THEN p.c END, 6) AS value FROM y LEFT JOIN panel AS p ON y.station_id = p.station_id AND y.source = p.t",
    )


@sql_query("era5_qc", "events")
def era5_qc(d):
    h = d.hour_index("ts")
    return f"WITH x AS (SELECT user_id, {h} AS h, value, event_type, row_number() OVER (PARTITION BY user_id, {h} ORDER BY event_id) AS rn FROM {{events}}) SELECT user_id, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN value > 90e0 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range FROM x GROUP BY user_id"


@sql_query("hourly_complete_from_segments", "events")
def segments(d):
    """Hours with all four quarter-hour segments of each kind of record, over the whole axis."""
    h = d.hour_index("ts")
    return A.sql(
        f"s AS (SELECT {h} AS h, CAST(FLOOR(minute(ts) / 15e0) AS BIGINT) AS q, count(*) AS n FROM {{events}} GROUP BY 1, 2)", "axis AS (SELECT min(h) AS low, max(h) AS high FROM s)", f"hrs AS (SELECT {d.series('low', 'high')} AS h FROM axis)",
        select="SELECT hrs.h, CAST(count(s.q) AS BIGINT) AS segments, count(s.q) = 4 AS complete FROM hrs LEFT JOIN s ON hrs.h = s.h GROUP BY hrs.h",
    )


@sql_query("block_relief", "lineitem")
def block_relief(d):
    """Highest less lowest value per block of k x k cells, for several k, and its mean."""
    per = lambda k: f"SELECT {k} AS k, CAST(FLOOR(i / {float(k)!r}e0) AS BIGINT) AS bi, CAST(FLOOR(j / {float(k)!r}e0) AS BIGINT) AS bj, max(z) - min(z) AS relief FROM grid GROUP BY 1, 2, 3"
    return A.sql("grid AS (SELECT CAST(l_suppkey % 30 AS BIGINT) AS i, CAST(l_partkey % 30 AS BIGINT) AS j, max(CAST(l_quantity AS DOUBLE)) AS z FROM {lineitem} GROUP BY 1, 2)", f"blocks AS ({' UNION ALL '.join(map(per, (2, 3, 5)))})", select="SELECT CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS blocks, round(avg(relief), 6) AS mean_relief, round(max(relief), 6) AS highest FROM blocks GROUP BY k")


@sql_query("bilinear_combine", "lineitem")
def bilinear(d):
    return A.sql(
        "grid AS (SELECT CAST(l_suppkey % 20 AS BIGINT) AS i, CAST(l_partkey % 20 AS BIGINT) AS j, max(CAST(l_quantity AS DOUBLE)) AS z FROM {lineitem} GROUP BY 1, 2)",
        "points AS (SELECT DISTINCT l_orderkey AS id, (l_orderkey * 37) % 190 / 10e0 AS x, (l_orderkey * 53) % 190 / 10e0 AS y FROM {lineitem})",
        "corners AS (SELECT id, CAST(FLOOR(x) AS BIGINT) + dx AS i, CAST(FLOOR(y) AS BIGINT) + dy AS j, (CASE WHEN dx = 1 THEN x - FLOOR(x) ELSE 1 - x + FLOOR(x) END) * (CASE WHEN dy = 1 THEN y - FLOOR(y) ELSE 1 - y + FLOOR(y) END) AS w FROM points CROSS JOIN ("
        + d.values("(0, 0), (0, 1), (1, 0), (1, 1)", "dx, dy") + ") AS o)",
        select="SELECT c.id, CAST(count(g.z) AS BIGINT) AS valid, round(sum(CASE WHEN g.z IS NOT NULL THEN c.w * g.z END) / nullif(sum(CASE WHEN g.z IS NOT NULL THEN c.w END), 0), 6) AS value FROM corners AS c LEFT JOIN grid AS g ON c.i = g.i AND c.j = g.j GROUP BY c.id",
    )


@sql_query("weather_scalars", "lineitem")
def weather(d):
    u, v = "(CAST(l_quantity AS DOUBLE) - 25.3e0)", "(CAST(l_linenumber AS DOUBLE) - 3.7e0)"
    t = "(270e0 + CAST(l_quantity AS DOUBLE) / 2)"
    return (
        f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, round({S.wind_speed(u, v)}, 6) AS speed, round({S.wind_direction(u, v)}, 6) AS direction, round({S.relative_humidity(t, f'({t} - CAST(l_linenumber AS DOUBLE))')}, 5) AS humidity, "
        f"round({S.aspect_component('sin', '(CAST(l_quantity AS DOUBLE) * 7)', 'CAST(l_linenumber AS DOUBLE)', 1.5)}, 6) AS aspect_sin, {S.relief_class('CAST(l_quantity AS DOUBLE) * 20')} AS relief, round({S.hour_difference('CAST(l_quantity AS DOUBLE)', 'CAST(l_linenumber AS DOUBLE) * 5')}, 6) AS hours_apart FROM {{lineitem}}"
    )


@sql_query("supplier_panel_scores", "lineitem")
def supplier_panel(d):
    """Bench panel: days and suppliers of line items, scores of price by quantity against the supplier's other days."""
    return A.sql(
        "cells AS (SELECT l_suppkey AS s, l_shipdate AS t, sum(CAST(l_quantity AS DOUBLE)) AS y, sum(CAST(l_extendedprice AS DOUBLE)) / 1500 AS p FROM {lineitem} GROUP BY 1, 2)",
        select=f"SELECT s, {R.scores('y', 'p', 4)} FROM cells GROUP BY s",
    )
