"""Nearest stations and local smoothers of large networks, without a matrix of all stations by all.

Targets are taken in blocks that lie together, each against the stations in a box around it; the box grows until what
lies outside is sure to be farther. Results are those of the full matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from . import linalg as L

#: Distances that a matrix may hold; beyond it work goes by blocks.
WHOLE = 1 << 22
#: Distances that are held at once then.
HELD = 1 << 20
BLOCK = 256
#: Neighbours that a list may hold; wider smoothers take all stations, a block of targets at a time.
MOST = 256
#: Kernels without weight at their bandwidth and beyond.
COMPACT = ("bisquare", "tricube")
RADIUS = 6378.388


def blocks(place: np.ndarray, size: int = BLOCK) -> Iterator[np.ndarray]:
    """Rows of ``place`` in blocks that lie together."""
    side = max(1, round((len(place) / size) ** 0.5))
    for strip in np.array_split(np.argsort(place[:, 0], kind="stable"), side):
        for part in np.array_split(strip[np.argsort(place[strip, 1], kind="stable")], side):
            if len(part):
                yield part


def few(targets: int, stations: int, least: int = 16) -> int:
    """Targets of a block that spans about BLOCK stations."""
    return min(BLOCK, max(least, BLOCK * targets // max(stations, 1)))


def runs(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows of ``width`` distances each."""
    step = max(1, HELD // max(width, 1))
    for a in range(0, n, step):
        yield slice(a, min(a + step, n))


class Field:
    """Stations sorted by longitude, for those in a box."""

    def __init__(self, train: np.ndarray, target: np.ndarray):
        self.train, self.order = train, np.argsort(train[:, 0], kind="stable")
        self.lon = train[self.order, 0]
        both = np.concatenate([train, target])
        self.low, self.high = both.min(axis=0), both.max(axis=0)
        self.round = self.high[0] - self.low[0] >= 180
        self.cos = float(np.cos(np.radians(min(np.abs(both[:, 1]).max(), 90.0))))

    def inside(self, at: np.ndarray, lat: float) -> tuple[np.ndarray, float]:
        """(stations within ``lat`` degrees of latitude, and as much of longitude, of the box of ``at``; km within which none is missed)."""
        lon = lat / self.cos if self.cos > 1e-6 else np.inf
        low, high = at.min(axis=0) - (lon, lat), at.max(axis=0) + (lon, lat)
        if self.round or not np.isfinite(lon) or ((low <= self.low) & (high >= self.high)).all():
            return np.arange(len(self.train)), np.inf
        found = self.order[np.searchsorted(self.lon, low[0], "left") : np.searchsorted(self.lon, high[0], "right")]
        found = np.sort(found[(self.train[found, 1] >= low[1]) & (self.train[found, 1] <= high[1])])
        chord = min(np.sin(np.radians(min(lat, 180.0)) / 2), self.cos * np.sin(np.radians(min(lon, 180.0)) / 2))
        return found, float(2 * RADIUS * np.arcsin(min(chord, 1.0)) * (1 - 1e-9))


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row, ascending, the earlier first on ties."""
    n = d.shape[1]
    wide = min(k + 4, n)
    if wide == n:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    part = np.sort(np.argpartition(d, wide - 1, axis=1)[:, :wide], axis=1)
    value = np.take_along_axis(d, part, 1)
    sort = np.argsort(value, axis=1, kind="stable")[:, :k]
    out = np.take_along_axis(part, sort, 1)
    tied = np.flatnonzero(np.take_along_axis(value, sort[:, -1:], 1)[:, 0] >= value.max(axis=1))
    for i in tied:
        out[i] = np.argsort(d[i], kind="stable")[:k]
    return out


def nearest(train: np.ndarray, target: np.ndarray, k: int, same: bool = False, km: Callable = L.haversine_km, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``train``, km): the k nearest of each target, ascending, the earlier row first on ties; -1 and inf where there are fewer.

    same: target i is station i (or ``own[i]``), and none of its own. ``km``: distances of (targets, stations).
    """
    if same and own is None:
        own = np.arange(len(target))
    index, far = np.full((len(target), k), -1), np.full((len(target), k), np.inf)
    if not len(train) or not len(target):
        return index, far
    field = Field(train, target)
    span = np.ptp(train, axis=0)
    start = 1.2 * float(np.sqrt((k + 1) / len(train) * max(span[0] * span[1], 1e-9) / np.pi)) if len(train) > k else np.inf
    for block in blocks(target, few(len(target), len(train))):
        reach = start
        while len(block):
            found, sure = field.inside(target[block], reach) if np.isfinite(reach) else (np.arange(len(train)), np.inf)
            if len(found) <= k + 1 and np.isfinite(sure):
                reach *= 2
                continue
            left = []
            for run in runs(len(block), len(found)):
                rows = block[run]
                d = km(target[rows], train[found])
                if own is not None:
                    d[found[None, :] == own[rows][:, None]] = np.inf
                at = _least(d, min(k, len(found)))
                value = np.take_along_axis(d, at, 1)
                ok = value[:, -1] < sure if np.isfinite(sure) else np.ones(len(rows), bool)
                index[rows[ok], : at.shape[1]] = np.where(np.isfinite(value[ok]), found[at[ok]], -1)
                far[rows[ok], : at.shape[1]] = value[ok]
                left.append(rows[~ok])
            block = np.concatenate(left)
            reach *= 2
    return index, far


def within(train: np.ndarray, target: np.ndarray, km: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(targets, stations): blocks of targets with all stations within ``km`` of any of them, and some more."""
    field = Field(train, target)
    lat = float(np.degrees(km / RADIUS)) * (1 + 1e-6) + 1e-9
    for block in blocks(target, few(len(target), len(train), 64)):
        reach = lat
        found, sure = field.inside(target[block], reach)
        while sure < km:
            reach *= 1.1
            found, sure = field.inside(target[block], reach)
        for run in runs(len(block), len(found)):
            yield block[run], found


class Squares:
    """Squared distances (km) to many stations, from products of places about their middle.

    Places near each other, whose difference that would lose, take the haversine: all are right to about 1e-11.
    """

    #: Squared chord, as a share of the network's largest, below which pairs take the haversine; up to which the series holds.
    NEAR, FAR = 1e-3, 0.01

    def __init__(self, train: np.ndarray):
        self.train, place = train, self._unit(train)
        self.middle = place.mean(axis=0)
        place -= self.middle
        self.size = np.einsum("ij,ij->i", place, place)
        self.turned = np.ascontiguousarray(-2 * place.T)

    @staticmethod
    def _unit(at: np.ndarray) -> np.ndarray:
        lon, lat = np.radians(at).T
        return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])

    def of(self, target: np.ndarray) -> np.ndarray:
        u = self._unit(target) - self.middle
        size = np.einsum("ij,ij->i", u, u)
        q = u @ self.turned
        q += size[:, None]
        q += self.size
        large = max(size.max(initial=0.0), self.size.max(initial=0.0))  # no squared chord is above four times that
        if 4 * large > self.FAR:
            return L.haversine_km(target, self.train) ** 2
        i, j = np.nonzero(q < self.NEAR * large)
        # the terms of (2 asin(chord / 2)) ** 2 that count, the last first
        terms = [a for n, a in enumerate((1, 12, 90, 560, 3150, 16632)) if (4 * large) ** n / a > 1e-15]
        out = q / terms.pop()
        for a in reversed(terms):
            out += 1 / a
            out *= q
        out *= RADIUS * RADIUS
        p, r = np.radians(target[i]), np.radians(self.train[j])
        h = np.sin((r[:, 1] - p[:, 1]) / 2) ** 2 + np.cos(p[:, 1]) * np.cos(r[:, 1]) * np.sin((r[:, 0] - p[:, 0]) / 2) ** 2
        out[i, j] = (2 * RADIUS * np.arcsin(np.sqrt(h))) ** 2
        return out


# --- smoothers


class Hat:
    """A smoother's rows as lists: ``value`` at the training rows ``index``."""

    def __init__(self, index: np.ndarray, value: np.ndarray):
        self.index, self.value = index, value

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.einsum("tk,tk->t", self.value, v.take(self.index))


class Recomputed:
    """A smoother whose rows are worked out anew at each product, some targets at a time."""

    def __init__(self, rows: Callable[[slice], np.ndarray], targets: int, width: int):
        self.rows, self.targets, self.width = rows, targets, width

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([self.rows(run) @ v for run in runs(self.targets, self.width)])


class Projection:
    """``linalg.projection`` without its matrix."""

    def __init__(self, x: np.ndarray, ridge: float = 1e-6):
        self.x, self.a = x, x.T @ x + ridge * np.eye(x.shape[1])

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return self.x @ np.linalg.solve(self.a, self.x.T @ v)


def projected(x: np.ndarray, ridge: float = 1e-6):
    return L.projection(x, ridge) if len(x) ** 2 <= WHOLE else Projection(x, ridge)


def _count(bw: float, train: int, loo: bool = False) -> int:
    """Neighbours of an adaptive width."""
    return int(np.clip(np.rint(bw), 2, max(train - loo, 2)))


def shared(train: np.ndarray, target: np.ndarray, widths: list[float], kernel: str) -> tuple[np.ndarray, np.ndarray] | None:
    """``nearest`` for smoothers of several adaptive widths between the same places: that of the widest holds those of all; None where they make no lists."""
    some = [k for k in (_count(b, len(train)) for b in widths) if k <= MOST]
    return nearest(train, target, max(some)) if some and kernel in COMPACT and len(train) * len(target) > WHOLE else None


def lists(train: np.ndarray, target: np.ndarray, k: int, kernel: str, same: bool = False, met: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(rows, weights) of each target's k nearest under a kernel that ends at the k-th; None where lists don't hold all that weigh. met: of ``shared``."""
    if kernel not in COMPACT or k > MOST:
        return None
    index, d = nearest(train, target, k, same) if met is None else (x[:, :k] for x in met)
    if (d[:, -1] <= L.EPS).any():  # more than k in one place weigh alike
        return None
    width = np.where(np.isfinite(d[:, -1]), d[:, -1], 1.0)
    met = index >= 0
    return np.maximum(index, 0), np.where(met, L.kernel_weights(np.where(met, d, 0), width[:, None], kernel), 0.0)


def smoother(xt: np.ndarray, xg: np.ndarray, train: np.ndarray, target: np.ndarray, bw: float, kernel: str = "bisquare", adaptive: bool = True, ridge: float = 1e-6, loo: bool = False, met: tuple[np.ndarray, np.ndarray] | None = None):
    """``linalg.local_hat`` from places, as what multiplies a vector: its matrix for small networks, else lists or blocks of rows. met: of ``shared``."""
    if len(train) * len(target) <= WHOLE:
        return L.local_hat(xt, xg, L.haversine_km(target, train), bw, kernel, adaptive, ridge, loo)
    p = xt.shape[1]
    found = lists(train, target, _count(bw, len(train), loo), kernel, loo, met) if adaptive else None
    if found is None:

        def rows(run: slice) -> np.ndarray:
            d = L.haversine_km(target[run], train)
            if loo:
                d[np.arange(len(d)), np.arange(run.start, run.stop)] = np.inf
            return L.local_hat(xt, xg[run], d, bw, kernel, adaptive, ridge)

        return Recomputed(rows, len(target), len(train))
    index, w = found
    value = np.zeros_like(w)
    enough = (w > 0).sum(axis=1) >= p + 1
    for run in runs(len(index), index.shape[1] * p * 2):
        some = np.flatnonzero(enough[run]) + run.start
        if len(some):
            x = xt[index[some]]
            a = np.swapaxes(x * w[some][:, :, None], 1, 2) @ x + ridge * np.eye(p)
            value[some] = (x @ np.linalg.solve(a, xg[some][:, :, None]))[:, :, 0] * w[some]
    return Hat(index, value)


def calibrate(x: np.ndarray, y: np.ndarray, place: np.ndarray, k: int, kernel: str = "bisquare") -> dict:
    """rss, sigma, trace and aic as of ``linalg.gwr_calibrate`` under adaptive widths, its rows one block after the other."""
    n, p = x.shape
    found = lists(place, place, k, kernel) if k <= n else None
    fit, trace, square = np.empty(n), 0.0, 0.0
    for run in runs(n, (n if found is None else found[0].shape[1]) * p * 2):
        own = np.arange(run.start, run.stop)
        if found is None:
            d = L.haversine_km(place[run], place)
            index, w = np.broadcast_to(np.arange(n), d.shape), L.kernel_weights(d, L.adaptive_width(d, k)[:, None], kernel)
        else:
            index, w = found[0][run], found[1][run]
        at = x[index]
        xw = np.swapaxes(at * w[:, :, None], 1, 2)
        hat = (x[own][:, None, :] @ np.linalg.solve(xw @ at + 1e-8 * np.eye(p), xw))[:, 0]
        fit[run] = (hat * y[index]).sum(axis=1)
        trace += float(hat[index == own[:, None]].sum())
        square += float((hat * hat).sum())
    residual = y - fit
    rss = float(residual @ residual)
    sigma = float(np.sqrt(rss / max(n - 2 * trace + square, L.EPS)))
    aic = n * np.log(max(rss / n, L.EPS)) + n * np.log(2 * np.pi) + n * (n + trace) / max(n - 2 - trace, L.EPS)
    return {"rss": rss, "sigma": sigma, "trace": trace, "aic": float(aic)}
