"""Time-axis operators over ``hours`` (station_id, h, obs, ...): dense, hourly, NULL where missing."""

from __future__ import annotations

from ..functions.dialect import Spark
from ..functions.scalar import WET, num

BY_STATION = "PARTITION BY station_id ORDER BY h"


def shifted(column: str, step: int, name: str) -> str:
    """The value exactly ``step`` hours away, or the own value where that is missing."""
    f = "lag" if step > 0 else "lead"
    return f"coalesce(CASE WHEN {f}(h, {abs(step)}) OVER ({BY_STATION}) = h - ({step}) THEN {f}({column}, {abs(step)}) OVER ({BY_STATION}) END, {column}) AS {name}"


def hours_to_rain(d: Spark, wet: float = WET) -> str:
    """to_rain(station_id, h, obs, before, after, open_before, open_after): hours to the nearest wet hour behind and ahead.

    A wet hour has 0 and 0. Where a missing hour comes first, the hours to it are given and the side is open; NULL
    where the axis ends first or the hour itself is missing.
    """
    # a mark is twice its hour, one more where the hour is missing
    mark = f"CASE WHEN obs IS NULL THEN 2 * h + 1 WHEN obs >= {num(wet)} THEN 2 * h END"
    back = d.last_value("mark", f"{BY_STATION} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    ahead = d.first_value("mark", f"{BY_STATION} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
    hour = lambda m: f"CAST(floor({m} / 2e0) AS BIGINT)"
    return (
        f"marked AS (SELECT *, {mark} AS mark FROM hours), sided AS (SELECT station_id, h, obs, {back} AS mb, {ahead} AS ma FROM marked), "
        f"to_rain AS (SELECT station_id, h, obs, CASE WHEN obs IS NOT NULL THEN h - {hour('mb')} END AS before, CASE WHEN obs IS NOT NULL THEN {hour('ma')} - h END AS after, "
        f"CASE WHEN obs IS NOT NULL AND mb <> 2 * {hour('mb')} THEN 1 ELSE 0 END AS open_before, CASE WHEN obs IS NOT NULL AND ma <> 2 * {hour('ma')} THEN 1 ELSE 0 END AS open_after FROM sided)"
    )


def islands(flag: str, source: str = "hours") -> str:
    """islands(station_id, flag, start, stop, length, censored): runs of equal flags; a missing hour (NULL flag) parts them.

    A run is censored where the axis or a missing hour ends it on either side.
    """
    return (
        f"flagged AS (SELECT station_id, h, {flag} AS flag FROM {source}), "
        f"turns AS (SELECT *, CASE WHEN lag(flag) OVER ({BY_STATION}) = flag THEN 0 ELSE 1 END AS turn, lag(flag) OVER ({BY_STATION}) AS prev, lead(flag) OVER ({BY_STATION}) AS follow FROM flagged), "
        f"numbered AS (SELECT *, sum(turn) OVER ({BY_STATION} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM turns), "
        "islands AS (SELECT station_id, flag, min(h) AS start, max(h) AS stop, CAST(count(*) AS BIGINT) AS length, max(CASE WHEN prev IS NULL OR follow IS NULL THEN 1 ELSE 0 END) AS censored "
        "FROM numbered WHERE flag IS NOT NULL GROUP BY station_id, flag, island)"
    )


def rain_events(wet: float = WET, gap: int = 3) -> str:
    """events_of(station_id, event, start, stop, total, peak, complete): wet hours joined over fewer than ``gap`` hours between.

    Complete: all hours from gap before to gap after lie on the axis and are known.
    """
    return (
        f"wet_hours AS (SELECT station_id, h, obs, h - lag(h) OVER ({BY_STATION}) - 1 AS pause FROM hours WHERE obs >= {num(wet)}), "
        f"chained AS (SELECT *, sum(CASE WHEN pause < {gap} THEN 0 ELSE 1 END) OVER ({BY_STATION} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event FROM wet_hours), "
        "spans AS (SELECT station_id, CAST(event AS BIGINT) AS event, min(h) AS start, max(h) AS stop, sum(obs) AS total, max(obs) AS peak FROM chained GROUP BY station_id, event), "
        "events_of AS (SELECT s.station_id, s.event, s.start, s.stop, max(s.total) AS total, max(s.peak) AS peak, "
        f"CASE WHEN count(x.obs) = s.stop - s.start + 1 + {2 * gap} THEN 1 ELSE 0 END AS complete "
        f"FROM spans AS s LEFT JOIN hours AS x ON s.station_id = x.station_id AND x.h BETWEEN s.start - {gap} AND s.stop + {gap} GROUP BY s.station_id, s.event, s.start, s.stop)"
    )


def scoring_windows(pad: int = 3) -> str:
    """windows(station_id, event, start, stop, low, high): padded, but never into a neighbouring event."""
    by = "PARTITION BY station_id ORDER BY start"
    return (
        f"windows AS (SELECT station_id, event, start, stop, greatest(start - {pad}, coalesce(lag(stop) OVER ({by}) + 1, start - {pad})) AS low, "
        f"least(stop + {pad}, coalesce(lead(start) OVER ({by}) - 1, stop + {pad})) AS high FROM events_of)"
    )
