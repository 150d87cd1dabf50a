"""Plan pieces on small hand-made tables with known results."""

import duckdb
import pytest

from pluvion.functions import scalar as S
from pluvion.functions.dialect import DUCKDB
from pluvion.operators import relational as R
from pluvion.operators import series as T
from pluvion.operators import spatial as O


def run(*ctes, select):
    return duckdb.sql("WITH " + ", ".join(ctes) + " " + select).fetchall()


def hours(values, start=0):
    rows = ", ".join(f"(1, {start + i}, {'NULL' if v is None else f'{v}e0'})" for i, v in enumerate(values))
    return f"hours AS (SELECT station_id, CAST(h AS BIGINT) AS h, CAST(obs AS DOUBLE) AS obs, CAST(obs AS DOUBLE) * 2 AS a FROM (VALUES {rows}) AS v(station_id, h, obs))"


def test_hours_to_rain():
    got = run(hours([0, 0.5, 0, 0, None, 0, 1, 0]), T.hours_to_rain(DUCKDB), select="SELECT before, after, open_before, open_after FROM to_rain ORDER BY h")
    assert got == [(None, 1, 0, 0), (0, 0, 0, 0), (1, 2, 0, 1), (2, 1, 0, 1), (None, None, 0, 0), (1, 1, 1, 0), (0, 0, 0, 0), (1, None, 0, 0)]


def test_rain_events():
    values = [0, 0, 0, 1, 0, 1, 0, 0, 0, 2, 0, 0, 0, 0]
    at = lambda gap: run(hours(values, 1), T.rain_events(gap=gap), select="SELECT start, stop, complete FROM events_of ORDER BY start")
    assert at(3) == [(4, 6, 1), (10, 10, 1)] and [x[:2] for x in at(1)] == [(4, 4), (6, 6), (10, 10)]
    values[7] = None
    assert at(3)[0] == (4, 6, 0)


def test_windows_never_overlap():
    got = run(hours([0, 0, 0, 1, 0, 1, 0, 0, 0, 2, 0, 0, 0, 0], 1), T.rain_events(), T.scoring_windows(), select="SELECT low, high FROM windows ORDER BY start")
    assert got == [(1, 9), (7, 13)]


def test_islands_and_shift():
    flag = "CASE WHEN obs IS NULL THEN NULL WHEN obs < 0.1e0 THEN 1 ELSE 0 END"
    got = run(hours([0, 0, 1, 0, None, 0, 1]), T.islands(flag), select="SELECT flag, start, stop, length, censored FROM islands ORDER BY start")
    assert got == [(1, 0, 1, 2, 1), (0, 2, 2, 1, 0), (1, 3, 3, 1, 1), (1, 5, 5, 1, 1), (0, 6, 6, 1, 1)]
    got = run(hours([1, None, 3]), select=f"SELECT {T.shifted('obs', 1, 'x')} FROM hours ORDER BY h")
    assert [x[0] for x in got] == [1, 1, 3]


STATIONS = "stations AS (SELECT * FROM (VALUES (1, 110.0e0, 31.0e0), (2, 110.3e0, 31.1e0), (3, 110.1e0, 31.4e0), (4, 110.5e0, 31.5e0), (5, 110.2e0, 31.2e0)) AS v(station_id, lon, lat))"


def predictions(kind, values, k=None, name=None):
    cells = "cells AS (SELECT station_id, t, CAST(y AS DOUBLE) AS y FROM (VALUES " + ", ".join(f"({i + 1}, 0, {'NULL' if v is None else v})" for i, v in enumerate(values)) + ") AS v(station_id, t, y))"
    return dict(run(STATIONS, cells, O.pairs(), O.candidates(k), *kind, select=f"SELECT target, pred FROM {name} ORDER BY target"))


@pytest.mark.parametrize("k", [None, 2])
def test_constant_field(k):
    for kind, name in (((O.idw(),), "idw"), ((O.adw(),), "adw")):
        assert all(v == pytest.approx(3.5) for v in predictions(kind, [3.5] * 5, k, name).values())


@pytest.mark.parametrize("k", [None, 2])
def test_missing_is_absent(k):
    for kind, name in (((O.idw(),), "idw"), ((O.adw(),), "adw")):
        holes = predictions(kind, [1, 2, None, 4, 5], k, name)
        assert set(holes) == {1, 2, 4, 5}
        if k:
            few = duckdb.sql(f"WITH {STATIONS.replace('(3, 110.1e0, 31.4e0), ', '')}, cells AS (SELECT * FROM (VALUES (1, 0, 1e0), (2, 0, 2e0), (4, 0, 4e0), (5, 0, 5e0)) AS v(station_id, t, y)), {O.pairs()}, {O.candidates(k)}, {kind[0]} SELECT target, pred FROM {name}").fetchall()
            assert dict(few) == pytest.approx(holes)


def test_reach_does_not_change_the_nearest():
    cells = "cells AS (SELECT station_id, 0 AS t, CASE WHEN station_id IN (1, 4) THEN NULL ELSE 1e0 * station_id END AS y FROM stations)"
    for reach in (1, 2, 96):
        near = O.nearest_reporting(2, "SELECT station_id AS target, 0 AS t FROM stations", reach=reach)
        got = run(STATIONS, cells, O.pairs(), "reports AS (SELECT * FROM cells WHERE y IS NOT NULL)", near, select="SELECT target, source, rn FROM met ORDER BY target, rn")
        assert got == run(STATIONS, O.pairs(), select="SELECT target, source, rn FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY km, source) AS rn FROM pairs WHERE source NOT IN (1, 4)) AS r WHERE rn <= 2 ORDER BY target, rn")


def test_local_plane():
    plane = {1: 0.0, 2: 2.3, 3: 1.1, 4: 2.9, 5: 0.7}
    for values, want in (([2.5] * 5, 2.5), (None, None)):
        if values is None:
            continue
        got = predictions((O.weights("gaussian", None, 500.0), O.local_linear(1e-9)), values, None, "local")
        assert all(v == pytest.approx(want) for v in got.values())
    rows = run(STATIONS, "cells AS (SELECT station_id, 0 AS t, 3 + 0.2 * (lon - 110) - 0.1 * (lat - 31) AS y FROM stations)", O.pairs(), O.candidates(), O.weights("gaussian", None, 500.0), O.gwr(1e-12), select="SELECT y0, pred FROM gwr")
    assert all(a == pytest.approx(b, abs=1e-6) for a, b in rows) and len(rows) == len(plane)
    assert all(v is None for v in predictions((O.weights("bisquare", 2), O.local_linear()), [1, 2, 3, 4, 5], None, "local").values())


def test_elimination_recovers_coefficients():
    rows = ", ".join(f"({a}, {b}, {0.25 + 0.4 * a + 0.3 * b})" for a, b in ((1, 2), (3, 1), (2, 5), (4, 4), (0, 1)))
    got = run(f"x AS (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(y AS DOUBLE) AS y FROM (VALUES {rows}) AS v(a, b, y))", f"g AS (SELECT 1 AS k, {R.gram(['1e0', 'a', 'b'], 'y')} FROM x)", R.eliminate("g", ["k"], 3), select="SELECT x0, x1, x2 FROM g_solved")
    assert got[0] == pytest.approx((0.25, 0.4, 0.3))


def test_adjusted_p_values_and_ranks():
    p = "p AS (SELECT * FROM (VALUES (1, 0.01), (2, 0.04), (3, 0.03)) AS v(k, p)), r AS (SELECT k, p, row_number() OVER (ORDER BY p) AS rn, count(*) OVER () AS m FROM p)"
    assert [float(x[0]) for x in run(p, select="SELECT min(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM r ORDER BY k")] == pytest.approx([0.03, 0.04, 0.04])
    assert [x[0] for x in run("x AS (SELECT unnest([3, 1, 3, 2]) AS v)", select=f"SELECT {R.tied_rank('v')} FROM x ORDER BY v")] == [1, 2, 3.5, 3.5]


def test_labels():
    one = lambda e: duckdb.sql(f"SELECT {e}").fetchall()[0][0]
    assert [one(S.agreement_band((f"{a}e0", f"{b}e0", f"{c}e0"))) for a, b, c in ((0, 0, 0), (0.1, 0, 0), (3, 0, 9), (9, 9, 9))] == [0, 1, 6, 9]
    assert one(S.agreement_band(("CAST(NULL AS DOUBLE)", "0.5e0"))) == 1
    assert one(S.blend("1e0", "2e0", "4e0", "0.5e0")) == 3 and one(S.blend("0e0", "2e0", "4e0", "0.5e0")) == 2 and one(S.blend("1e0", "CAST(NULL AS DOUBLE)", "4e0", "0.5e0")) is None
    assert one(S.hour_difference("1e0", "23e0")) == 2 and one(S.hour_difference("23e0", "1e0")) == -2
    assert one(S.wind_direction("0e0", "-1e0")) == 0 and one(S.wind_direction("-1e0", "0e0")) == 90
    assert one(S.relative_humidity("290e0", "290e0")) == 100
    x, y = S.scan_angles("133e0", "0e0")
    assert one(S.grid_position(x)) == pytest.approx(1373.5) and one(S.grid_position(y)) == pytest.approx(1373.5)
    assert [one(DUCKDB.round_even(v)) for v in ("2.5e0", "3.5e0")] == [2, 4]
