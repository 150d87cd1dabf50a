"""Nearest stations of large networks in Python workers: of one time's reports, or of the whole network.

Distances, offsets, weights and planes are those of the SQL in ``spatial``, expression by expression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import near
from ..functions.scalar import RADIUS
from ..session import ship
from .relational import EPS

#: Tasks that the targets of a whole network are dealt to.
TASKS = 48


def km(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """``scalar.haversine`` of (targets, sources)."""
    lat, lon = np.sin(np.radians(source[None, :, 1] - target[:, None, 1]) / 2), np.sin(np.radians(source[None, :, 0] - target[:, None, 0]) / 2)
    a = lat * lat + np.cos(np.radians(target[:, None, 1])) * np.cos(np.radians(source[None, :, 1])) * (lon * lon)
    return 2 * RADIUS * np.arcsin(np.sqrt(np.clip(a, 0, 1)))


def offsets(target: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """km east and north of each target (t, 2) of its sources (t, k, 2)."""
    turn = np.fmod(np.fmod(source[..., 0] - target[:, None, 0] + 180, 360) + 360, 360) - 180
    return RADIUS * np.radians(turn) * np.cos(np.radians(target[:, 1]))[:, None], RADIUS * np.radians(source[..., 1] - target[:, None, 1])


def planes(d: np.ndarray, e: np.ndarray, n: np.ndarray, y: np.ndarray, k: int, ridge: float, least: int = 3) -> np.ndarray:
    """``spatial.local_linear`` under bisquare weights that end at the k-th source; rows of sources in ascending order, inf where there is none."""
    met = np.isfinite(d)
    width = np.where(met[:, :k], d[:, :k], -np.inf).max(axis=1, initial=-np.inf)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(met & (d <= width), (1 - (d / width) ** 2) ** 2, 0.0)
        w = np.where(w > 0, w, 0.0)
        w = w / w.sum(axis=1)[:, None]
        total = lambda *x: np.where(w > 0, w * np.prod(x, axis=0) if x else w, 0.0).sum(axis=1)
        s1, se, sn, see, sen, snn = total(), total(e), total(n), total(e, e), total(e, n), total(n, n)
        b0, b1, b2 = total(y), total(e, y), total(n, y)
        s = np.sqrt(see + snn)
        a00, a01, a02, a11, a12, a22 = s1, se / s, sn / s, see / (s * s) + ridge, sen / (s * s), snn / (s * s) + ridge
        c00, c01, c02 = a11 * a22 - a12 * a12, a02 * a12 - a01 * a22, a01 * a12 - a02 * a11
        det = a00 * c00 + a01 * c01 + a02 * c02
        ok = ((w > 0).sum(axis=1) >= least) & (s * s > float(EPS)) & (np.abs(det) > float(EPS))
        return np.where(ok, (c00 * b0 + c01 * (b1 / s) + c02 * (b2 / s)) / det, np.nan)


def _sources(rows: pd.DataFrame, at: np.ndarray, of: np.ndarray, k: int):
    """(km, e, n, y) of the k nearest rows ``of`` of the rows ``at``; a row is none of its own."""
    place, y = rows[["lon", "lat"]].to_numpy(float), rows["y"].to_numpy(float)
    number = np.full(len(rows), -1)
    number[of] = np.arange(len(of))
    index, d = near.nearest(place[of], place[at], k, km=km, own=number[at])
    index = np.maximum(index, 0)
    source = place[of][index] if len(of) else np.zeros((*index.shape, 2))
    e, n = offsets(place[at], source)
    return d, e, n, y[of][index] if len(of) else np.zeros(index.shape)


def by_time(cells: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``function`` of one time's rows (station_id, t, lon, lat, y, ...) in the order of stations."""
    ship(cells.sparkSession)
    return cells.filter("station_id IS NOT NULL AND t IS NOT NULL AND y IS NOT NULL").groupBy("t").applyInPandas(lambda rows: function(rows.sort_values("station_id", ignore_index=True)), schema)


def plane_scan(cells: DataFrame, tries: list[tuple[int, float]]) -> DataFrame:
    """(target, t, y0, p0, p1, ...): the plane of each (k, ridge) at each reported cell that another one meets, from the nearest of the largest k."""
    most = max(k for k, _ in tries)

    def one(rows):
        every = np.arange(len(rows))
        d, e, n, y = _sources(rows, every, every, most)
        out = pd.DataFrame({"target": rows["station_id"], "t": rows["t"], "y0": rows["y"]} | {f"p{i}": planes(d, e, n, y, k, ridge) for i, (k, ridge) in enumerate(tries)})
        return out[np.isfinite(d[:, 0])]

    found = by_time(cells, one, "target bigint, t bigint, y0 double" + "".join(f", p{i} double" for i in range(len(tries))))
    return found.withColumns({f"p{i}": F.when(~F.isnan(f"p{i}"), F.col(f"p{i}")) for i in range(len(tries))})


def _held_out(rows: pd.DataFrame, k: int):
    """(rows, km, e, n, y) of each fold's stations with their k nearest of other folds."""
    fold = rows["fold"].to_numpy()
    for f in np.unique(fold):
        at = np.flatnonzero(fold == f)
        yield at, *_sources(rows, at, np.flatnonzero(fold != f), k)


def plane_held_out(cells: DataFrame, k: int, ridge: float = 1e-4) -> DataFrame:
    """(station_id, t, fold, pred): the plane at each reported cell from the k nearest of other folds; cells without one are left out."""

    def one(rows):
        out = rows[["station_id", "t", "fold"]].assign(pred=np.nan)
        for at, *found in _held_out(rows, k):
            out.loc[at, "pred"] = planes(*found, k, ridge)
        return out[np.isfinite(out["pred"])]

    return by_time(cells, one, "station_id bigint, t bigint, fold bigint, pred double")


def inverse_held_out(cells: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, fold, target, t, y0, pred): inverse square distance of the k nearest of other folds, for each k."""

    def one(rows):
        out = []
        for at, d, _, _, y in _held_out(rows, max(ks)):
            met = np.isfinite(d)
            w = np.where(met, 1 / np.maximum(np.where(met, d * d, 1.0), 1e-12), 0.0)
            some = met[:, 0]
            for k in ks:
                part = rows.loc[at[some], ["fold", "station_id", "t", "y"]]
                out.append(part.assign(k=k, pred=(w * y)[some, :k].sum(axis=1) / w[some, :k].sum(axis=1)))
        return pd.concat(out, ignore_index=True).rename(columns={"station_id": "target", "y": "y0"})[["k", "fold", "target", "t", "y0", "pred"]]

    return by_time(cells, one, "k int, fold bigint, target bigint, t bigint, y0 double, pred double")


def over_network(rows: DataFrame, work: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``work(network, place, targets)`` over blocks of targets that lie together.

    rows: one a station (station_id, lon, lat, sums); they are held on the driver and sent to each task once, as those of the other
    models of a network are.
    """
    spark = rows.sparkSession
    network = rows.filter("station_id IS NOT NULL").toPandas().sort_values("station_id", ignore_index=True)
    held = spark.sparkContext.broadcast(network)

    def run(batches):
        data = held.value
        place = data[["lon", "lat"]].to_numpy(float)
        each = list(near.blocks(place, 4 * near.BLOCK))
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for block in each[part::TASKS]:
                    yield work(data, place, np.sort(block))

    ship(spark)
    return spark.range(0, TASKS, 1, TASKS).mapInArrow(run, schema)


def nearest_stations(stations: DataFrame, k: int) -> DataFrame:
    """(target, source): the k nearest other stations of each."""

    def work(data, place, targets):
        index, _ = near.nearest(place, place[targets], k, km=km, own=targets)
        met, ids = index >= 0, data["station_id"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[targets], met.sum(axis=1))), pa.array(ids[index[met]])], names=["target", "source"])

    return over_network(stations, work, "target bigint, source bigint")


def hurdle(own: DataFrame, features: int, k: int = 20, least: float = 0.1, most: float = 500.0, samples: float = 100.0, prior: float = 20.0) -> DataFrame:
    """``models.hurdle`` from one row a station (station_id, lon, lat, gram array, rhs array, yy, wet, n): only the near ones weigh, and the plain sums are of all."""
    sums: dict = {}

    def arrays(data):
        if not sums:
            x = {c: np.stack(data[c]).astype(float) for c in ("gram", "rhs")} | {c: data[c].to_numpy(float) for c in ("yy", "wet", "n")}
            x["gram"] = x["gram"].reshape(-1, features, features)
            sums.update(x, all={c: v.sum(axis=0) for c, v in x.items()})
        return sums

    def work(data, place, targets):
        x, out = arrays(data), []
        whole, wide = x["all"], min(k + 12, len(place))
        index, d = near.nearest(place, place[targets], wide, km=km)
        plain = L.hurdle_amount(whole["gram"], whole["rhs"], float(whole["yy"]), float(whole["wet"]))
        rate = float(whole["wet"]) / max(float(whole["n"]), 1.0)
        for i, t in enumerate(targets):
            at, far = index[i], d[i]
            bw = max(far[min(k, len(place)) - 1], 1e-6) * 1.0001
            if far[-1] <= bw and wide < len(place):
                at, far = np.arange(len(place)), km(place[t : t + 1], place)[0]
            w = L.kernel_weights(far, bw)
            at, w = at[w > 0], w[w > 0]
            effective, code, fit = float((w * x["wet"][at]).sum()), 0, None
            if effective >= samples and float(w.sum()) ** 2 / max(float((w * w).sum()), 1e-12) >= 8:
                fit = L.hurdle_amount((w[:, None, None] * x["gram"][at]).sum(axis=0), (w[:, None] * x["rhs"][at]).sum(axis=0), float((w * x["yy"][at]).sum()), effective)
            if fit is None:
                code, fit = 1, plain
            chance = (effective + prior * rate) / (float((w * x["n"][at]).sum()) + prior)
            amount = None if fit is None else round(float(L.expected_amount(np.eye(features)[:1], fit[0], fit[1], least, most)[0]), 6)
            out.append((round(chance, 6), amount, code))
        chance, amount, code = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(data["station_id"].to_numpy()[targets]), pa.array(chance, pa.float64()), pa.array(amount, pa.float64()), pa.array(code, pa.int32())], names=["target", "wet_chance", "amount", "code"])

    return over_network(own, work, "target bigint, wet_chance double, amount double, code int")


#: Values of dense hours that a worker holds at once.
DENSE = 500_000


def hour_features(stations: DataFrame, seen: DataFrame, k: int = 8) -> DataFrame:
    """(station_id, h, a, before, after, around) of the dense hours; seen: (station_id, h, a, bad) of hours with a record.

    What most hours hold is 0: only the others move, and each station's hours are laid out where its rows end up.
    """
    low, high = seen.agg(F.min("h"), F.max("h")).first()
    schema = "station_id bigint, h bigint, a double, before double, after double, around double"
    if low is None:
        return stations.sparkSession.createDataFrame([], schema)
    told = seen.filter("h IS NOT NULL AND (a <> 0 OR bad = 1)").groupBy("station_id").agg(F.collect_list(F.struct("h", "a", "bad")).alias("own"))
    met = nearest_stations(stations, k).join(told.withColumnRenamed("station_id", "source"), "source", "left").groupBy("target").agg(F.flatten(F.collect_list("own")).alias("others"), F.count(F.lit(1)).alias("met"))
    rows = stations.select("station_id").join(told, "station_id", "left").join(met.withColumnRenamed("target", "station_id"), "station_id", "left")
    hours = high - low + 1

    def laid(lists):
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return row, flat.field(0).to_numpy(zero_copy_only=False) - low, flat.field(1).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(zero_copy_only=False) == 1

    def run(batches):
        step = max(1, DENSE // hours)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                shape = (batch.num_rows, hours)
                a, gone, total, lost = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape), np.zeros(shape, np.int64)
                row, h, value, bad = laid(batch.column(1))
                a[row, h], gone[row, h] = value, bad
                row, h, value, bad = laid(batch.column(2))
                np.add.at(total, (row[~bad], h[~bad]), value[~bad])
                np.add.at(lost, (row[bad], h[bad]), 1)
                count = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)[:, None] - lost
                columns = [(a, gone)]
                for side, edge in ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))):
                    v, out = a.copy(), gone.copy()
                    use = ~gone[:, side]
                    v[:, edge] = np.where(use, a[:, side], a[:, edge])
                    out[:, edge] = gone[:, edge] & ~use
                    columns.append((v, out))
                columns.append((np.where(count > 0, total / np.maximum(count, 1), a), gone & (count <= 0)))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(shape[0]), hours)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(low, high + 1), shape[0])), *(pa.array(v.ravel(), mask=m.ravel()) for v, m in columns)], names=["station_id", "h", "a", "before", "after", "around"])

    ship(stations.sparkSession)
    return rows.select("station_id", "own", "others", "met").mapInArrow(run, schema)
