"""Weighted regression kernels: coefficient forms, the four bandwidth rules, predictors of one time, smoothers."""

from __future__ import annotations

import numpy as np

from . import near as N
from .linalg import EPS, adaptive_width, backfit, haversine_km, kernel_weights, local_km, projection

COINCIDENT_KM = float(np.sqrt(EPS))

# --- bandwidth rules


def width_plain(d: np.ndarray, bw: float) -> np.ndarray:
    """k-th distance, the station itself counted; beyond the row its largest distance is scaled."""
    return adaptive_width(d, int(bw))


def width_finite(d: np.ndarray, bw: float) -> np.ndarray:
    """The k-th finite distance, k rounded and kept in 2 .. all; where that is 0 the smallest positive one (1 where none is)."""
    s = np.sort(np.where(np.isfinite(d), d, np.inf), axis=1)
    count = np.isfinite(s).sum(axis=1)
    k = np.clip(np.rint(bw), 2, np.maximum(count, 2)).astype(int)
    w = s[np.arange(len(s)), np.minimum(k, s.shape[1]) - 1]
    positive = np.where((s > 0) & np.isfinite(s), s, np.inf).min(axis=1)
    return np.where(np.isfinite(w) & (w > 0), w, np.where(np.isfinite(positive), positive, 1.0))


def weights_panel(d: np.ndarray, k: int, loo: bool = False) -> np.ndarray:
    """Bisquare of distances strictly below the k-th usable one (the largest positive one where that is 0)."""
    d = np.where(np.isfinite(d), d, np.inf)
    if loo:
        d = d.copy()
        np.fill_diagonal(d, np.inf)
    s = np.sort(d, axis=1)
    count = np.isfinite(s).sum(axis=1)
    w = s[np.arange(len(s)), np.clip(k, 1, np.maximum(count, 1)) - 1]
    top = np.where(np.isfinite(s), s, 0).max(axis=1)
    w = np.where((w > 0) & np.isfinite(w), w, np.where(top > 0, top, 1.0))
    u = np.where(np.isfinite(d), d / w[:, None], 2.0)
    return np.where(u < 1, (1 - u * u) ** 2, 0.0)


def weights_hurdle(d: np.ndarray, bw: float, adaptive: bool = True, kernel: str = "bisquare", excluded: int | None = None) -> np.ndarray:
    """Weights of one target's stations; the width is the k-th finite distance and never below the coincidence limit."""
    d = np.array(d, float)
    if excluded is not None:
        d[excluded] = np.inf
    finite = np.sort(d[np.isfinite(d)])
    if adaptive and len(finite) < bw:
        raise ValueError(f"{int(bw)} neighbours are wanted and {len(finite)} are there")
    width = max(finite[int(bw) - 1] if adaptive else bw, COINCIDENT_KM)
    return np.where(np.isfinite(d), kernel_weights(np.where(np.isfinite(d), d, 0), width, kernel), 0.0)


# --- coefficients


def gwr_coefficients(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    """(targets, p) or (targets, p, times): weighted coefficients of every target, one weight row each; y: (n,) or (n, times)."""
    p = x.shape[1]
    a = (w @ (x[:, :, None] * x[:, None, :]).reshape(len(x), p * p)).reshape(-1, p, p) + ridge * np.eye(p)
    b = np.einsum("tn,np,nk->tpk", w, x, y.reshape(len(y), -1))
    out = np.linalg.solve(a, b)
    return out[:, :, 0] if y.ndim == 1 else out


def solve_inverse(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    xw = x * w[:, None]
    return np.linalg.inv(xw.T @ x + ridge * np.eye(x.shape[1])) @ (xw.T @ y)


def solve_cholesky(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    xw = x * w[:, None]
    low = np.linalg.cholesky(xw.T @ x + ridge * np.eye(x.shape[1]))
    return np.linalg.solve(low.T, np.linalg.solve(low, xw.T @ y))


def top_weights(w: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` heaviest weights of each row (earlier column first on ties), the others 0."""
    keep = np.argsort(-w, axis=1, kind="stable")[:, :most]
    out = np.zeros_like(w)
    np.put_along_axis(out, keep, np.take_along_axis(w, keep, 1), 1)
    return out


def st_gwr(x: np.ndarray, y: np.ndarray, w: np.ndarray, x_at: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
    """(targets, times): one weight row a target serves all times; ``most``: only its heaviest stations."""
    beta = gwr_coefficients(x, y, w if most is None else top_weights(w, most))
    return fitted(x if x_at is None else x_at, beta)


def fitted(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """x . beta by target, or by target and time."""
    return np.einsum("tp,tp->t", x, beta) if beta.ndim == 2 else np.einsum("tp,tpk->tk", x, beta)


def calibration_parts(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, C with beta = C y) of one target."""
    xw = x * w[:, None]
    c = np.linalg.solve(xw.T @ x + 1e-8 * np.eye(x.shape[1]), xw.T)
    return c @ y, c


def loo_rmse(x: np.ndarray, y: np.ndarray, ridge: float = 1e-8) -> float:
    """Leave-one-out error of least squares from the hat diagonal."""
    h = projection(x, ridge)
    return float(np.sqrt(np.mean(((y - h @ y) / (1 - np.diag(h))) ** 2)))


def global_ridge(x: np.ndarray, y: np.ndarray, x_at: np.ndarray, ridge: float, loo: bool = False) -> np.ndarray:
    """Ridge on all diagonals; with ``loo`` each training row is predicted without itself. No columns: 0."""
    if not x.shape[1]:
        return np.zeros(len(x) if loo else len(x_at))
    a = x.T @ x + ridge * np.eye(x.shape[1])
    if not loo:
        return x_at @ np.linalg.solve(a, x.T @ y)
    c = np.linalg.solve(a, x.T)  # taking a row out of A is a rank-one change
    left = 1 - (x * c.T).sum(axis=1)
    return np.where(np.abs(left) > 1e-12, y - (y - x @ (c @ y)) / np.where(np.abs(left) > 1e-12, left, 1), np.nan)


def local_ridge(x: np.ndarray, y: np.ndarray, x_at: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Local fit at each target; NaN where fewer than p + 1 known stations weigh."""
    known = np.isfinite(y) & np.isfinite(x).all(axis=1)
    out = np.full(len(x_at), np.nan)
    ok = ((w[:, known] > 0).sum(axis=1) >= x.shape[1] + 1) & np.isfinite(x_at).all(axis=1)
    if ok.any():
        out[ok] = fitted(x_at[ok], gwr_coefficients(x[known], y[known], w[ok][:, known], ridge))
    return out


def backfit_times(y: np.ndarray, hats: list[np.ndarray], fixed: np.ndarray | None, **options) -> list:
    """``backfit`` of each column of y with the same smoothers; None where one doesn't settle."""
    return [backfit(y[:, k], hats, fixed, **options) for k in range(y.shape[1])]


# --- predictors of one time: (train places, values, target places, ...) -> values at the targets


def _distances(train: np.ndarray, target: np.ndarray, same: bool) -> np.ndarray:
    d = haversine_km(target, train)
    if same:
        np.fill_diagonal(d, np.inf)
    return d


def idw(train, y, target, power: float = 2.0, k: int | None = None, same: bool = False, angular: bool = False) -> np.ndarray:
    """Inverse distance of the k nearest (or all), with Shepard's correction for directions where ``angular``; ``same``: targets are the stations, never their own source."""
    if len(train) * len(target) > N.WHOLE:
        return idw_options(train, y, target, [(power, k)], same, angular)[0]
    d = _distances(train, target, same)
    out = np.full(len(target), np.nan)
    for t in range(len(target)):
        order = np.argsort(d[t], kind="stable")
        order = order[np.isfinite(d[t][order])][: k or len(train)]
        if not len(order):
            continue
        near = d[t][order]
        if (near <= COINCIDENT_KM).any():
            out[t] = y[order[near <= COINCIDENT_KM]].mean()
            continue
        b = near**-power
        if angular and len(order) > 1:
            u = local_km(train[order], target[t])
            u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), EPS)
            total, pull = b.sum(), (b[:, None] * u).sum(axis=0)
            rest = total - b
            b = np.where(rest > 0, b * (1 + (total - u @ pull) / np.where(rest > 0, rest, 1)), b)
        out[t] = (b * y[order]).sum() / b.sum()
    return out


def _met(d: np.ndarray, y: np.ndarray, powers: list[float], directions) -> list[np.ndarray]:
    """``idw`` of rows of distances d (inf: not met) and values y, for each power; directions: east and north of each source, or None."""
    met, same = np.isfinite(d), d <= COINCIDENT_KM
    count, at = met.sum(axis=1), np.where(same.any(axis=1), np.where(same, y, 0).sum(axis=1) / np.maximum(same.sum(axis=1), 1), np.nan)
    safe = np.where(same, 1.0, d)
    if directions is not None:
        east, north = directions
        size = np.maximum(np.sqrt(east * east + north * north), EPS)
        east, north = np.where(met, east / size, 0), np.where(met, north / size, 0)
    out = []
    for power in powers:
        b = 1 / safe if power == 1 else 1 / (safe * safe) if power == 2 else safe**-power
        if directions is not None:
            total = b.sum(axis=1)[:, None]
            rest = total - b
            pull = east * (b * east).sum(axis=1)[:, None] + north * (b * north).sum(axis=1)[:, None]
            b = np.where(met & (rest > 0) & (count > 1)[:, None], b * (1 + (total - pull) / np.where(rest > 0, rest, 1)), b)
        with np.errstate(invalid="ignore", divide="ignore"):
            found = (b * np.where(met, y, 0)).sum(axis=1) / b.sum(axis=1)
        out.append(np.where(count > 0, np.where(np.isnan(at), found, at), np.nan))
    return out


def _all_met(train, y, target, powers: list[float], same: bool, angular: bool) -> list[np.ndarray]:
    """``idw`` of all stations under each power, from squared distances of few targets at a time; rows with a coincident station take ``_met``."""
    out = [np.full(len(target), np.nan) for _ in powers]
    count = len(train) - same
    if count < 1:
        return out
    squares, turn, both = N.Squares(train), np.radians(train), np.column_stack([y, np.ones(len(y))])
    for run in N.runs(len(target), 16 * len(train)):
        s = squares.of(target[run])
        if same:
            s[np.arange(len(s)), np.arange(run.start, run.stop)] = np.inf
        odd = np.flatnonzero(s.min(axis=1) <= (1.001 * COINCIDENT_KM) ** 2)
        s[odd] = 1.0
        if angular and count > 1:
            at = np.radians(target[run])
            east, north = turn[:, 0] - at[:, :1], turn[:, 1] - at[:, 1:]
            east *= np.cos(at[:, 1:])
            size = east * east
            size += north * north
            np.sqrt(size, out=size)
            np.maximum(size, EPS, out=size)
            east /= size
            north /= size
        for part, power in zip(out, powers, strict=True):
            b = 1 / s if power == 2 else 1 / np.sqrt(s) if power == 1 else s ** (-power / 2)
            if angular and count > 1:
                total = b.sum(axis=1)[:, None]
                pull = east * np.einsum("tk,tk->t", b, east)[:, None]
                pull += north * np.einsum("tk,tk->t", b, north)[:, None]
                np.subtract(total, pull, out=pull)
                rest = total - b
                alone = rest <= 0
                if alone.any():
                    rest[alone], pull[alone] = 1, 0
                pull /= rest
                pull += 1
                b *= pull
            sums = b @ both
            part[run] = sums[:, 0] / sums[:, 1]
        if len(odd):
            rows = np.arange(run.start, run.stop)[odd]
            d = haversine_km(target[rows], train)
            if same:
                d[np.arange(len(rows)), rows] = np.inf
            directions = None
            if angular:
                u = turn[None] - np.radians(target[rows])[:, None, :]
                directions = u[..., 0] * np.cos(np.radians(target[rows][:, 1]))[:, None], u[..., 1]
            for part, found in zip(out, _met(d, np.broadcast_to(y, d.shape), powers, directions), strict=True):
                part[rows] = found
    return out


def idw_options(train, y, target, options: list[tuple[float, int | None]], same: bool = False, angular: bool = False) -> list[np.ndarray]:
    """``idw`` under each (power, k), some targets at a time; distances are worked out once for all that share k."""
    out: list = [None] * len(options)
    for k in dict.fromkeys(k for _, k in options):
        which = [i for i, o in enumerate(options) if o[1] == k]
        powers = [options[i][0] for i in which]
        if not k or k >= len(train):
            for i, part in zip(which, _all_met(train, y, target, powers, same, angular), strict=True):
                out[i] = part
            continue
        parts = [np.full(len(target), np.nan) for _ in which]
        few = k is not None and 0 < k <= N.MOST
        index, far = N.nearest(train, target, k, same) if few else (None, None)
        for run in N.runs(len(target), 4 * (k if few else len(train))):
            if few:
                d, source = far[run], np.maximum(index[run], 0)
            else:
                d, source = haversine_km(target[run], train), np.arange(len(train))[None, :]
                if same:
                    d[np.arange(len(d)), np.arange(run.start, run.stop)] = np.inf
                if k:
                    keep = np.argsort(d, axis=1, kind="stable")[:, :k]
                    d, source = np.take_along_axis(d, keep, 1), keep
            directions = None
            if angular:
                turn = np.radians(train[source] - target[run][:, None, :])
                directions = turn[..., 0] * np.cos(np.radians(target[run][:, 1]))[:, None], turn[..., 1]
            for part, found in zip(parts, _met(d, y[source], powers, directions), strict=True):
                part[run] = found
        for i, part in zip(which, parts, strict=True):
            out[i] = part
    return out


def adw(train, y, target, power: float = 2.0, k: int | None = None, same: bool = False) -> np.ndarray:
    return idw(train, y, target, power, k, same, True)


def gwr(train, y, target, kernel: str = "bisquare", adaptive: bool = True, bw: float = 30, same: bool = False, least: int = 3) -> np.ndarray:
    """Plane [1, lon, lat] about the training mean; NaN with fewer than three stations or a vanishing determinant."""
    centre = train.mean(axis=0)
    x, at = (np.column_stack([np.ones(len(v)), v - centre]) for v in (train, target))
    out = np.full(len(target), np.nan)

    def plane(rows, w, a, b):
        ok = (np.count_nonzero(w > 0, axis=1) >= least) & (np.abs(np.linalg.det(a)) > EPS)
        if ok.any():
            out[rows[ok]] = (at[rows[ok]] * np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]).sum(axis=1)

    moments = np.concatenate([(x[:, :, None] * x[:, None, :]).reshape(-1, 9), x * y[:, None]], axis=1)

    def matrix(rows, found):
        d = haversine_km(target[rows], train[found])
        w = kernel_weights(d, width_plain(d, bw)[:, None] if adaptive else bw, kernel)
        if same:
            w[found[None, :] == rows[:, None]] = 0.0
        some = x[found]
        plane(rows, w, (w @ (some[:, :, None] * some[:, None, :]).reshape(-1, 9)).reshape(-1, 3, 3) + 1e-8 * np.eye(3), (w * y[found]) @ some)

    all_rows, all_found = np.arange(len(target)), np.arange(len(train))
    large = len(train) * len(target) > N.WHOLE
    found = N.lists(train, target, int(bw), kernel) if large and adaptive and 0 < int(bw) <= len(train) else None
    if found is not None:
        for run in N.runs(len(target), 12 * found[0].shape[1]):
            index, w = found[0][run], found[1][run].copy()
            if same:
                w[index == all_rows[run][:, None]] = 0.0
            xw = np.swapaxes(x[index] * w[:, :, None], 1, 2)
            plane(all_rows[run], w, xw @ x[index] + 1e-8 * np.eye(3), (xw @ y[index][:, :, None])[:, :, 0])
    elif large and not adaptive and np.isinf(bw) and not same:  # one plane for all
        total = np.broadcast_to(moments.sum(axis=0), (1, 12))
        plane(all_rows, np.ones((1, len(train))), np.broadcast_to(total[:, :9].reshape(-1, 3, 3) + 1e-8 * np.eye(3), (len(target), 3, 3)), np.broadcast_to(total[:, 9:], (len(target), 3)))
    elif large and not adaptive and kernel == "bisquare" and 0 < bw < np.inf:
        for rows, some in N.within(train, target, max(float(bw), 1e-6)):
            squares, of = N.Squares(train[some]), moments[some]
            for run in N.runs(len(rows), 16 * len(some)):
                part = rows[run]
                w = squares.of(target[part])
                w /= -float(bw) ** 2
                w += 1
                np.maximum(w, 0, out=w)
                w *= w
                if same:
                    w[some[None, :] == part[:, None]] = 0.0
                sums = w @ of
                plane(part, w, sums[:, :9].reshape(-1, 3, 3) + 1e-8 * np.eye(3), sums[:, 9:])
    elif large and not adaptive and kernel in N.COMPACT and np.isfinite(bw):
        for rows, some in N.within(train, target, max(float(bw), 1e-6)):
            matrix(rows, some)
    else:
        for run in N.runs(len(target), len(train)) if large else [slice(None)]:
            matrix(all_rows[run], all_found)
    return out


def damped(y: np.ndarray, place: np.ndarray, groups: list[np.ndarray], fixed: np.ndarray, target: np.ndarray, groups_at: list[np.ndarray], fixed_at: np.ndarray, widths: list[float], kernel: str = "bisquare", adaptive: bool = True, loo: bool = False, ridge: float = 1e-6, omega: float = 1.5, tol: float = 1e-5, most: int = 1000) -> np.ndarray:
    """Local groups with a width each and global terms, over-relaxed; with ``loo`` self-excluding smoothers give the fit itself. NaN where it doesn't settle."""
    hats = [N.smoother(g, g, place, place, b, kernel, adaptive, ridge, loo) for g, b in zip(groups, widths, strict=True)]
    done = backfit(y, hats, N.projected(fixed, ridge) if fixed.shape[1] else None, tol, most, omega)
    if done is None:
        return np.full(len(y) if loo else len(target), np.nan)
    parts, whole = done
    if loo:
        return sum(parts) + whole
    beta = np.linalg.solve(fixed.T @ fixed + ridge * np.eye(fixed.shape[1]), fixed.T @ (y - sum(parts))) if fixed.shape[1] else np.zeros(0)
    out = fixed_at @ beta if fixed.shape[1] else np.zeros(len(target))
    for i, (g, at, b) in enumerate(zip(groups, groups_at, widths, strict=True)):
        rest = y - (fixed @ beta if fixed.shape[1] else 0) - sum(c for j, c in enumerate(parts) if j != i)
        out = out + N.smoother(g, at, place, target, b, kernel, adaptive, ridge) @ rest
    return out


def mixed(y, place, local, fixed, target, local_at, fixed_at, bw: float, kernel: str = "bisquare", adaptive: bool = True, loo: bool = False, ridge: float = 1e-6, tol: float = 1e-5, most: int = 200) -> np.ndarray:
    """One local group and global terms by undamped back-fitting; the target's smoother leaves it out where ``loo``."""
    done = backfit(y, [N.smoother(local, local, place, place, bw, kernel, adaptive, ridge)], N.projected(fixed, ridge) if fixed.shape[1] else None, tol, most)
    if done is None:
        return np.full(len(y) if loo else len(target), np.nan)
    (part,), _ = done
    beta = np.linalg.solve(fixed.T @ fixed + ridge * np.eye(fixed.shape[1]), fixed.T @ (y - part)) if fixed.shape[1] else np.zeros(0)
    rest = y - (fixed @ beta if fixed.shape[1] else 0)
    whole = (fixed if loo else fixed_at) @ beta if fixed.shape[1] else 0.0
    return N.smoother(local, local if loo else local_at, place, place if loo else target, bw, kernel, adaptive, ridge, loo) @ rest + whole


# --- folds


def weighted_draw(rng: np.random.Generator, weights: np.ndarray) -> int:
    """Index drawn with the weights' odds; any where all are 0."""
    total = weights.sum()
    return int(rng.integers(len(weights))) if total <= 0 else int(np.searchsorted(np.cumsum(weights), rng.random() * total, side="right").clip(0, len(weights) - 1))


def first_centres(xy: np.ndarray, k: int, seed: int = 0, farthest: bool = False) -> np.ndarray:
    """k places of ``xy``: each next one drawn by the squared distance to those there (or the farthest)."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(xy)))] if not farthest else [int(np.argmax(((xy - xy.mean(axis=0)) ** 2).sum(axis=1)))]
    near = ((xy - xy[at[0]]) ** 2).sum(axis=1)
    while len(at) < k:
        at.append(int(np.argmax(near)) if farthest else weighted_draw(rng, near))
        near = np.minimum(near, ((xy - xy[at[-1]]) ** 2).sum(axis=1))
    return xy[at]


def balanced_folds(lonlat: np.ndarray, k: int, seed: int = 0, farthest: bool = False, rounds: int = 100) -> np.ndarray:
    """Fold 1..k of each station: k compact groups whose sizes differ by one at most."""
    from .linalg import nearest_with_room

    xy = local_km(lonlat)
    room = np.full(k, len(xy) // k) + (np.arange(k) < len(xy) % k)
    centres = first_centres(xy, k, seed, farthest)
    fold = None
    for _ in range(rounds):
        moved = nearest_with_room(((xy[:, None] - centres[None]) ** 2).sum(axis=2), room)
        if fold is not None and np.array_equal(moved, fold):
            break
        fold = moved
        centres = np.array([xy[fold == f].mean(axis=0) if (fold == f).any() else centres[f] for f in range(k)])
    return fold + 1


# --- smoother selection and surfaces


def smoother_hats(x: np.ndarray, d: np.ndarray, k: int, loo: bool = True, ridge: float = 1e-6) -> np.ndarray:
    """Hat of a local fit with panel weights."""
    w = weights_panel(d, k, loo)
    p = x.shape[1]
    a = (w @ (x[:, :, None] * x[:, None, :]).reshape(len(x), p * p)).reshape(-1, p, p) + ridge * np.eye(p)
    return (np.linalg.solve(a, x[:, :, None])[:, :, 0] @ x.T) * w


def best_width(x: np.ndarray, y: np.ndarray, d: np.ndarray, candidates: list[int]) -> tuple[int, float]:
    """Neighbour count with the least leave-one-out error; the smaller on ties."""
    errors = [float(np.sqrt(np.mean((y - smoother_hats(x, d, k) @ y) ** 2))) for k in candidates]
    at = int(np.argmin(errors))
    return candidates[at], errors[at]


def shuffled_moments(moments: np.ndarray, order: np.ndarray) -> float:
    """Correlation of x with the series of station ``order`` in place of each station's own, from pair moments (n, xy, sx, sy, sxx, syy) by (station, station)."""
    n, xy, sx, sy, sxx, syy = moments[np.arange(len(order)), order].sum(axis=0)
    if n < 3:
        return 0.0
    v = (sxx - sx * sx / n) * (syy - sy * sy / n)
    return float((xy - sx * sy / n) / np.sqrt(v)) if v > 0 else 0.0


def block_pvalue(moments: np.ndarray, n: int = 999, seed: int = 0) -> tuple[float, float]:
    """(r, p): whole stations' series are shuffled among stations, so a series' own dependence stays."""
    rng, size = np.random.default_rng(seed), len(moments)
    r = shuffled_moments(moments, np.arange(size))
    above = sum(abs(shuffled_moments(moments, rng.permutation(size))) >= abs(r) for _ in range(n))
    return r, (above + 1) / (n + 1)
