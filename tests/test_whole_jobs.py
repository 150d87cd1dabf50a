"""Queries that must reach the end of their job, on hand-made tables with known results."""

import numpy as np

from pluvion.operators import models
from pluvion.plans import diagnostics


def test_eligible_cells_reach_the_fixed_point(spark):
    chain = [(i, i + k) for i in range(8) for k in (0, 1)][1:]  # each end that falls makes the next one fall
    ring = [(100 + i, 200 + (i + k) % 3) for i in range(3) for k in (0, 1)]
    got = diagnostics.settled_cells(spark.createDataFrame(chain + ring, "station_id bigint, t bigint"), 2, 2)
    assert sorted(map(tuple, got.collect())) == sorted(ring)


def test_identical_series_are_components(spark):
    # 1 and 3 differ at time 1, but both equal 2 where they meet it; 4 shares no time with them; 5 differs; 6 and 7 are one
    series = {1: {0: 1.0, 1: 5.0}, 2: {0: 1.0, 2: 3.0, 3: 4.0}, 3: {1: 6.0, 2: 3.0, 3: 4.0}, 4: {9: 1.0}, 5: {0: 1.1, 2: 3.1}, 6: {7: 2.0, 8: 2.0}, 7: {7: 2.0, 8: 2.0, 9: 3.0}}
    panel = spark.createDataFrame([(k, t, v) for k, x in series.items() for t, v in x.items()] + [(4, 7, None)], "station_id bigint, t bigint, obs double")
    got = lambda n: sorted((r.station_id, r.component, r["size"], r.min_overlap) for r in diagnostics.series_groups(panel, n).collect())
    assert got(1) == [(1, 1, 3, 1), (2, 1, 3, 1), (3, 1, 3, 1), (6, 6, 2, 2), (7, 6, 2, 2)]
    assert got(2) == [(2, 2, 2, 2), (3, 2, 2, 2), (6, 6, 2, 2), (7, 6, 2, 2)]


def test_screen_comes_before_inflation(spark):
    r = np.random.default_rng(3)
    n = 80
    good, noise, lon = r.normal(size=n), r.normal(size=n), np.linspace(109.5, 111.5, n)
    near = good + 0.1 * noise  # collinear with good
    slope = np.where(lon < 110.5, 3.0, 0.2)
    y = slope * good + 0.1 * r.normal(size=n)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(lon, r.uniform(31, 33, n), y, good, near, noise))], "station_id bigint, lon double, lat double, y double, good double, near double, noise double")
    got = {x.candidate: x for x in models.select_covariates(rows, "y", ["good", "near", "noise"]).collect()}
    assert got["good"].selected and got["near"].selected and got["good"].kept != got["near"].kept
    assert not got["noise"].selected and not got["noise"].kept and got["noise"].role is None
    assert [x.role for x in got.values() if x.kept] == ["local"] and min(x.p for x in got.values()) == 0.001


def test_equal_series_do_not_depend_on_the_order_of_rows(spark):
    # 0.1 + 0.2 + 0.3 differs from 0.3 + 0.2 + 0.1 in its last bit; partitions and row order are reversed for the second station
    values = [0.1, 0.2, 0.3]
    rows = [(k * 10 + i, k, "purchase", v) for k in (1, 2) for i, v in enumerate(values)]
    rows = rows[:3] + rows[:2:-1]
    events = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "event_id bigint, user_id bigint, event_type string, value double").selectExpr("*", "timestamp '2024-01-02 03:00:00' AS ts")
    assert [tuple(r) for r in diagnostics.equal_series(diagnostics.observed(events)).collect()] == [(1, 2, 1)]
    assert diagnostics.series_groups(diagnostics.observed(events)).count() == 2
