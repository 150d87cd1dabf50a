"""Stations and panels from the generic tables, as common table expressions both dialects take.

stations: users of ``events`` placed in the study box. panel: day cells; the observation is the day's purchases, the
products are its views, clicks and signups (all over 10); absent kinds are NULL. hours: the dense hourly grid of each
station; an hour without purchases is 0, one with an error record is missing.
"""

from __future__ import annotations

from ..functions.dialect import Spark
from ..functions.scalar import num

PRODUCTS = ("a", "b", "c")
_KINDS = {"obs": "purchase", "a": "view", "b": "click", "c": "signup"}


def stations() -> str:
    return (
        f"stations AS (SELECT station_id, {num(109.4)} + {num(2.2)} * ((station_id * 7919) % 1000) / 1000e0 + station_id * 1e-6 AS lon, "
        f"{num(31.2)} + {num(2.2)} * ((station_id * 104729) % 1000) / 1000e0 AS lat "
        "FROM (SELECT DISTINCT user_id AS station_id FROM {events}) AS u)"
    )


def panel(d: Spark) -> str:
    value = ", ".join(f"sum(CASE WHEN event_type = '{k}' THEN value END) / 10 AS {c}" for c, k in _KINDS.items())
    return f"panel AS (SELECT user_id AS station_id, CAST(FLOOR({d.hour_index('ts')} / 24) AS BIGINT) AS t, {value} FROM {{events}} GROUP BY 1, 2)"


def hours(d: Spark) -> str:
    """Needs stations. Columns station_id, h, obs, a, b, c; NULL where the hour has an error record."""
    value = ", ".join(f"coalesce(sum(CASE WHEN event_type = '{k}' THEN value END), 0) / 10 AS {c}" for c, k in _KINDS.items())
    return (
        f"seen AS (SELECT user_id AS station_id, {d.hour_index('ts')} AS h, {value}, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS bad FROM {{events}} GROUP BY 1, 2), "
        "axis AS (SELECT min(h) AS low, max(h) AS high FROM seen), "
        f"grid AS (SELECT station_id, {d.series('low', 'high')} AS h FROM stations CROSS JOIN axis), "
        "hours AS (SELECT grid.station_id, grid.h, "
        + ", ".join(f"CASE WHEN bad = 1 THEN NULL ELSE coalesce({c}, 0e0) END AS {c}" for c in _KINDS)
        + " FROM grid LEFT JOIN seen ON grid.station_id = seen.station_id AND grid.h = seen.h)"
    )


def calendar(h: str = "h") -> dict[str, str]:
    """Hour of day, met-day (starts at 9) and month expressions of an hour index."""
    day = f"CAST(FLOOR(({h} - 9) / 24e0) AS BIGINT)"
    return {"hour": f"({h} % 24)", "met_day": day}


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
