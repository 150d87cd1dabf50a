"""Dense numerical kernels on small arrays: what Python workers run inside grouped maps."""

from __future__ import annotations

import itertools

import numpy as np

EPS = np.finfo(float).eps
#: Fixed value: share of a full turn between rotations (golden section).
TURN = 0.6180339887498949


def kernel_weights(d: np.ndarray, bw, kernel: str = "bisquare") -> np.ndarray:
    """Weights at distances d; an infinite bandwidth weighs all alike, a distance equal to it is inside."""
    bw = np.asarray(bw, float)
    u = np.where(np.isinf(bw), 0.0, d / np.where(bw == 0, EPS, bw))
    shape = {
        "gaussian": lambda: np.exp(-0.5 * u * u), "exponential": lambda: np.exp(-u), "bisquare": lambda: np.where(u > 1, 0.0, (1 - u * u) ** 2),
        "tricube": lambda: np.where(u > 1, 0.0, (1 - u**3) ** 3), "boxcar": lambda: np.where(u > 1, 0.0, 1.0),
    }
    return shape[kernel]()


def adaptive_width(d: np.ndarray, k: int) -> np.ndarray:
    """Distance of the k-th nearest (itself included) in each row; k beyond the row scales its largest distance."""
    n = d.shape[1]
    s = np.sort(d, axis=1)
    return s[:, k - 1] if k <= n else s[:, -1] * k / n


def haversine_km(a: np.ndarray, b: np.ndarray, radius: float = 6378.388) -> np.ndarray:
    """(len(a), len(b)) distances of (lon, lat) rows in degrees."""
    p, q = np.radians(a), np.radians(b)
    h = np.sin((q[None, :, 1] - p[:, None, 1]) / 2) ** 2 + np.cos(p[:, None, 1]) * np.cos(q[None, :, 1]) * np.sin((q[None, :, 0] - p[:, None, 0]) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def local_km(lonlat: np.ndarray, centre: np.ndarray | None = None, radius: float = 6378.388) -> np.ndarray:
    c = lonlat.mean(axis=0) if centre is None else centre
    return np.column_stack([radius * np.radians(lonlat[:, 0] - c[0]) * np.cos(np.radians(c[1])), radius * np.radians(lonlat[:, 1] - c[1])])


# --- thin-plate splines


def tps_kernel(r2: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(r2 <= EPS, 0.0, 0.5 * r2 * np.log(r2))


def flatness(xy: np.ndarray) -> float:
    """Extent of the points across their main direction, as a share of that along it: 0 where all are on a line or in one place."""
    s = np.linalg.svd(xy - xy.mean(axis=0), compute_uv=False)
    return float(s[1] / s[0]) if len(s) > 1 and s[0] > 0 else 0.0


def _solved(a: np.ndarray, b: np.ndarray, close: float = 1e-6, spend: bool = False) -> np.ndarray | None:
    """Solution of a system scaled to a diagonal of about 1; None where it is singular or the solution doesn't satisfy it. spend: ``a`` may be written over."""
    scale = 1 / np.sqrt(np.maximum(np.maximum(a.max(axis=1), -a.min(axis=1)), EPS))
    even, right = np.multiply(a, scale[:, None], out=a if spend else None), scale[:, None] * b.reshape(len(a), -1)
    even *= scale[None]
    try:
        x = np.linalg.solve(even, right)
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(x).all() or np.abs(even @ x - right).max() > close * max(np.abs(right).max(), EPS):
        return None
    return scale[:, None] * x


def _tps_system(xy: np.ndarray, smooth: float, scale: float | None):
    n = len(xy)
    if n < 3 or flatness(xy) < 1e-6:
        return None
    system = np.zeros((n + 3, n + 3))
    for run in near.runs(n, n):
        system[run, :n] = tps_kernel(((xy[run, None] - xy[None]) ** 2).sum(axis=2))
    if scale is None:
        # each value stands once above the diagonal, which leaves the median as it is
        size = np.empty(n * (n - 1) // 2)
        end = 0
        for i in range(n - 1):
            row = system[i, i + 1 : n]
            row = row[row != 0]
            size[end : end + len(row)] = row
            end += len(row)
        size = np.abs(size[:end], out=size[:end])
        scale = float(np.median(size, overwrite_input=True)) if end else 1.0
        del size
    system[np.arange(n), np.arange(n)] += smooth * scale
    system[:n, n], system[:n, n + 1 :] = 1.0, xy
    system[n:, :n] = system[:n, n:].T
    return system


def tps_predict(train: np.ndarray, y: np.ndarray, target: np.ndarray, smooth: float = 0.01, scale: float | None = None) -> np.ndarray:
    """Smoothing spline through (lon, lat) stations at the targets; NaN with fewer than 3 stations, all (nearly) on a line, or a singular system."""
    centre = train.mean(axis=0)
    xy, at = local_km(train, centre), local_km(target, centre)
    system = _tps_system(xy, smooth, scale)
    if system is None:
        return np.full(len(target), np.nan)
    w = _solved(system, np.concatenate([y, np.zeros(3)]), spend=True)
    del system
    if w is None:
        return np.full(len(target), np.nan)
    out = np.column_stack([np.ones(len(at)), at]) @ w[-3:, 0]
    for run in near.runs(len(at), len(xy)):
        out[run] += tps_kernel(((at[run, None] - xy[None]) ** 2).sum(axis=2)) @ w[:-3, 0]
    return out


def tps_loo(train: np.ndarray, y: np.ndarray, smooth: float = 0.01) -> np.ndarray:
    """Leave-one-out values from the hat matrix; NaN with fewer than 4 stations."""
    xy = local_km(train)
    system = _tps_system(xy, smooth, None) if len(train) >= 4 else None
    if system is None:
        return np.full(len(train), np.nan)
    n = len(train)
    plain = system[:n, :n].copy()
    np.fill_diagonal(plain, tps_kernel(np.zeros(n)))
    inverse = _solved(system, np.eye(len(system)))
    if inverse is None:
        return np.full(len(train), np.nan)
    hat = np.hstack([plain, system[:n, n:]]) @ inverse[:, :n]
    left = 1 - np.diag(hat)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.abs(left) <= 1e-10, np.nan, y - (y - hat @ y) / left)


# --- weighted and geographically weighted regression


def solve_weighted(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    a = (x * w[:, None]).T @ x + ridge * np.eye(x.shape[1])
    return np.linalg.solve(a, (x * w[:, None]).T @ y)


def gwr_calibrate(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> dict:
    """Coefficients, standard errors, RSS, sigma, hat trace and corrected AIC of square GWR; weights[i] are those for target i."""
    n, p = x.shape
    beta, se, hat = np.empty((n, p)), np.empty((n, p)), np.empty((n, n))
    for i in range(n):
        xw = x * weights[i][:, None]
        c = np.linalg.solve(xw.T @ x + 1e-8 * np.eye(p), xw.T)
        beta[i], hat[i] = c @ y, x[i] @ c
        se[i] = (c * c).sum(axis=1)
    residual = y - hat @ y
    rss, trace = float(residual @ residual), float(np.trace(hat))
    free = max(n - 2 * trace + float((hat * hat).sum()), EPS)
    sigma = np.sqrt(rss / free)
    aic = n * np.log(max(rss / n, EPS)) + n * np.log(2 * np.pi) + n * (n + trace) / max(n - 2 - trace, EPS)
    return {"beta": beta, "se": sigma * np.sqrt(se), "rss": rss, "sigma": float(sigma), "trace": trace, "aic": float(aic), "fitted": hat @ y}


def local_hat(xt: np.ndarray, xg: np.ndarray, d: np.ndarray, bw: float, kernel: str = "bisquare", adaptive: bool = True, ridge: float = 1e-6, loo: bool = False) -> np.ndarray:
    """(targets, train) rows that map training values to local fits; rows without enough stations are 0."""
    p = xt.shape[1]
    dist = np.array(d, float)
    if loo:
        np.fill_diagonal(dist, np.inf)
    met = np.isfinite(dist)
    count = met.sum(axis=1)
    if adaptive:
        kth = np.clip(np.rint(bw), 2, np.maximum(count, 2)).astype(int) - 1
        width = np.sort(dist, axis=1)[np.arange(len(dist)), np.minimum(kth, dist.shape[1] - 1)]
    else:
        width = np.full(len(dist), float(bw))
    width = np.where(np.isfinite(width), np.maximum(width, EPS), 1.0)
    w = np.where(met, kernel_weights(np.where(met, dist, 0), width[:, None], kernel), 0.0)
    enough = (w > 0).sum(axis=1) >= p + 1
    products = (xt[:, :, None] * xt[:, None, :]).reshape(len(xt), p * p)
    a = (w @ products).reshape(-1, p, p) + ridge * np.eye(p)
    solved = np.zeros((len(xg), p))
    if enough.any():
        solved[enough] = np.linalg.solve(a[enough], xg[enough][:, :, None])[:, :, 0]
    return (solved @ xt.T) * w


def backfit(y: np.ndarray, hats: list[np.ndarray], projection: np.ndarray | None, tol: float = 1e-5, most: int = 200, damping: float = 1.0):
    """Gauss-Seidel components of local smoothers and a global projection.

    Undamped sweeps end when the residual sum of squares changes by less than ``tol`` of itself; damped ones when the
    fit does. None where that doesn't happen in ``most`` sweeps or a value is not finite.
    """
    locals_ = [np.zeros(len(y)) for _ in hats]
    fixed = projection @ y if projection is not None else np.zeros(len(y))
    before, fit = None, sum(locals_) + fixed
    for sweep in range(most):
        for i, h in enumerate(hats):
            rest = y - fixed - sum(c for j, c in enumerate(locals_) if j != i)
            locals_[i] = locals_[i] + damping * (h @ rest - locals_[i])
        if projection is not None:
            fixed = fixed + damping * (projection @ (y - sum(locals_)) - fixed)
        now = sum(locals_) + fixed
        if not np.isfinite(now).all():
            return None
        rss = float(((y - now) ** 2).sum())
        if damping == 1.0:
            if before is not None and abs(before - rss) / max(before, EPS) < tol:
                return locals_, fixed
        elif sweep and np.linalg.norm(now - fit) / max(np.linalg.norm(fit), EPS) < tol:
            return locals_, fixed
        before, fit = rss, now
    return None


def projection(x: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    return x @ np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T)


def mixed_gwr(lonlat: np.ndarray, y: np.ndarray, local: np.ndarray, fixed: np.ndarray, bw: float, target: np.ndarray, local_at: np.ndarray, fixed_at: np.ndarray, kernel: str = "bisquare", ridge: float = 1e-6) -> np.ndarray:
    """Local terms by GWR, global ones by least squares, back-fitted; NaN where too few stations report or sweeps don't settle."""
    if len(y) <= local.shape[1] + fixed.shape[1] + 2:
        return np.full(len(target), np.nan)
    bw = min(bw, len(y) - 1)
    done = backfit(y, [near.smoother(local, local, lonlat, lonlat, bw, kernel, ridge=ridge)], near.projected(fixed, ridge))
    if done is None:
        return np.full(len(target), np.nan)
    (component,), _ = done
    beta = np.linalg.solve(fixed.T @ fixed + ridge * np.eye(fixed.shape[1]), fixed.T @ (y - component))
    return near.smoother(local, local_at, lonlat, target, bw, kernel, ridge=ridge) @ (y - fixed @ beta) + fixed_at @ beta


def multiscale_gwr(lonlat: np.ndarray, y: np.ndarray, groups: list[np.ndarray], widths: list[float], target: np.ndarray, groups_at: list[np.ndarray], kernel: str = "bisquare", damping: float = 1.5, most: int = 1000, ridge: float = 1e-6) -> np.ndarray:
    """Each group of terms with a bandwidth of its own, over-relaxed back-fitting; NaN where it doesn't settle."""
    if len(y) <= sum(g.shape[1] for g in groups) + 2:
        return np.full(len(target), np.nan)
    widths = [min(b, len(y) - 1) for b in widths]
    met = near.shared(lonlat, lonlat, widths, kernel)
    hats = [near.smoother(g, g, lonlat, lonlat, b, kernel, ridge=ridge, met=met) for g, b in zip(groups, widths, strict=True)]
    done = backfit(y, hats, None, 1e-5, most, damping)
    if done is None:
        return np.full(len(target), np.nan)
    parts, _ = done
    out, met = np.zeros(len(target)), near.shared(lonlat, target, widths, kernel)
    for i, (g, at, b) in enumerate(zip(groups, groups_at, widths, strict=True)):
        rest = y - sum(c for j, c in enumerate(parts) if j != i)
        out += near.smoother(g, at, lonlat, target, b, kernel, ridge=ridge, met=met) @ rest
    return out


def nnls(gram: np.ndarray, rhs: np.ndarray, yy: float) -> np.ndarray:
    """Non-negative least squares from normal equations: the best among the feasible solutions of all supports."""
    p, best, least = len(rhs), np.zeros(len(rhs)), yy
    for size in range(1, p + 1):
        for support in map(list, itertools.combinations(range(p), size)):
            a = gram[np.ix_(support, support)]
            if np.linalg.cond(a) > 1e12:
                continue
            w = np.linalg.solve(a, rhs[support])
            if (w < 0).any():
                continue
            error = yy - 2 * w @ rhs[support] + w @ a @ w
            if error < least - 1e-12 * max(abs(least), 1):
                least, best = error, np.zeros(p)
                best[support] = w
    return best


# --- statistics


def vif(x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Variance inflation of each column: diagonal of the inverse correlation matrix."""
    w = np.ones(len(x)) if w is None else w
    z = x - (x * w[:, None]).sum(axis=0) / w.sum()
    s = np.sqrt((z * z * w[:, None]).sum(axis=0) / w.sum())
    z = z / np.where(s > 0, s, 1)
    corr = (z * w[:, None]).T @ z / w.sum()
    return np.diag(np.linalg.pinv(corr))


def prune_by_vif(x: np.ndarray, q: np.ndarray, limit: float = 5.0) -> list[int]:
    """Columns left after dropping the worst one (ties: larger q) until all inflations are below the limit."""
    left = list(range(x.shape[1]))
    while len(left) > 1:
        v = vif(x[:, left])
        if v.max() < limit:
            break
        left.remove(max(zip(v.tolist(), q[left].tolist(), left, strict=True))[2])
    return left


def permutation_pvalue(statistic, x: np.ndarray, y: np.ndarray, n: int = 499, seed: int = 0) -> float:
    rng, observed = np.random.default_rng(seed), abs(statistic(x, y))
    return (sum(abs(statistic(x, rng.permutation(y))) >= observed for _ in range(n)) + 1) / (n + 1)


def joint_f(x: np.ndarray, y: np.ndarray, ridge: float = 1e-8) -> float:
    design = np.column_stack([np.ones(len(y)), x])
    fit = design @ np.linalg.solve(design.T @ design + ridge * np.eye(design.shape[1]), design.T @ y)
    rss, tss, p = float(((y - fit) ** 2).sum()), float(((y - y.mean()) ** 2).sum()), x.shape[1]
    return (tss - rss) / p / max(rss / max(len(y) - p - 1, 1), EPS)


def block_bootstrap(sums: np.ndarray, statistic, reps: int = 2000, seed: int = 0) -> dict:
    """Days (rows of sums) drawn with replacement: point, 95 % interval and two-sided p of statistic(summed row)."""
    rng = np.random.default_rng(seed)
    draws = np.array([np.bincount(rng.integers(0, len(sums), len(sums)), minlength=len(sums)) for _ in range(reps)]) @ sums
    values = np.array([statistic(r) for r in draws])
    values = values[np.isfinite(values)]
    low, high = np.quantile(values, [0.025, 0.975])
    return {"point": float(statistic(sums.sum(axis=0))), "low": float(low), "high": float(high), "p": float(min(1.0, 2 * min((values <= 0).mean(), (values >= 0).mean())))}


# --- balanced spatial folds along a Hilbert curve


def hilbert_index(x: np.ndarray, y: np.ndarray, order: int = 16) -> np.ndarray:
    """Place of each cell (x, y) of a 2**order grid along the Hilbert curve from (0, 0) to (2**order - 1, 0).

    The curve visits a square's quarters in the order lower left, upper left, upper right, lower right. The first is the
    curve mirrored at the diagonal, the last one mirrored at the other diagonal: two signs say how the quarter met lies.
    """
    x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
    place = np.zeros(np.broadcast(x, y).shape, np.int64)
    swapped, turned = np.zeros(place.shape, bool), np.zeros(place.shape, bool)
    for bit in reversed(range(order)):
        right, up = ((x >> bit) & 1) ^ turned, ((y >> bit) & 1) ^ turned
        right, up = np.where(swapped, up, right), np.where(swapped, right, up)
        place = place << 2 | right << 1 | right ^ up
        turned ^= (right == 1) & (up == 0)
        swapped ^= up == 0
    return place


def nearest_with_room(squared: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Centre of each point (rows of squared distances): nearest with room left; who loses most by its second choice goes first."""
    two = np.partition(squared, 1, axis=1) if squared.shape[1] > 1 else np.hstack([squared, squared])
    left, out, order, at = room.copy(), np.zeros(len(squared), int), np.argsort(-(two[:, 1] - two[:, 0]), kind="stable"), 0
    while at < len(order) and (left > 0).any():
        # all choose at once; that holds up to the first point that fills a centre
        choice = np.argmin(np.where(left > 0, squared[order[at:]], np.inf), axis=1)
        filled = [hits[n - 1] + 1 for hits, n in ((np.flatnonzero(choice == c), left[c]) for c in np.flatnonzero(left > 0)) if len(hits) >= n]
        choice = choice[: min(filled, default=len(choice))]
        out[order[at : at + len(choice)]] = choice
        left -= np.bincount(choice, minlength=len(left))
        at += len(choice)
    return out


def hilbert_folds(ids: list, lonlat: np.ndarray, k: int, rotation: int = 0, rounds: int = 100) -> np.ndarray:
    """Fold 1..k of each station: equal runs along a turned Hilbert curve, then rounds of nearest centre with room."""
    xy = local_km(lonlat)
    angle = 2 * np.pi * (rotation * TURN % 1.0)
    c, s = np.cos(angle), np.sin(angle)
    along = np.column_stack([c * xy[:, 0] - s * xy[:, 1], s * xy[:, 0] + c * xy[:, 1]])
    low, span = along.min(axis=0), np.ptp(along, axis=0)
    cells = np.rint((along - low) / np.where(span > 0, span, 1) * 65535).astype(np.int64)
    runs = np.array_split(np.lexsort((np.asarray(ids), hilbert_index(cells[:, 0], cells[:, 1]))), k)
    fold = np.empty(len(xy), int)
    for f, run in enumerate(runs):
        fold[run] = f
    room = np.array([len(run) for run in runs])
    for _ in range(rounds):
        centres = np.column_stack([np.bincount(fold, xy[:, j], k) for j in (0, 1)]) / np.maximum(np.bincount(fold, minlength=k), 1)[:, None]
        moved = nearest_with_room(((xy[:, None] - centres[None]) ** 2).sum(axis=2), room)
        if np.array_equal(moved, fold):
            break
        fold = moved
    return fold + 1


# --- hurdle model


def hurdle_amount(gram: np.ndarray, rhs: np.ndarray, yy: float, n: float, ridge: float = 1e-4, most_condition: float = 1e10):
    """(coefficients, residual variance) of log1p amounts from weighted sums; None if the system is too ill-conditioned."""
    a = gram + ridge * max(n, 1.0) * np.diag([0.0] + [1.0] * (len(rhs) - 1))
    if not np.isfinite(a).all() or np.linalg.cond(a) > most_condition:
        return None
    beta = np.linalg.solve(a, rhs)
    return beta, max(float(yy - 2 * beta @ rhs + beta @ gram @ beta) / max(n - len(rhs), 1.0), 0.0)


def expected_amount(x: np.ndarray, beta: np.ndarray, variance: float, least: float, most: float) -> np.ndarray:
    return np.clip(np.exp(np.clip(x @ beta + 0.5 * variance, -50, 50)) - 1, least, most)


def slope_variance(place: np.ndarray, x: np.ndarray, y: np.ndarray, bw: float = 20, ridge: float = 1e-4) -> float:
    """Variance over stations of the local slope of y on x."""
    d = haversine_km(place, place)
    w = kernel_weights(d, np.maximum(adaptive_width(d, int(bw)), EPS)[:, None])
    sw = w.sum(axis=1)
    mx, my = w @ x / sw, w @ y / sw
    sxx, sxy = w @ (x * x) / sw - mx * mx, w @ (x * y) / sw - mx * my
    return float(np.var(sxy / (sxx + ridge)))


from . import near  # noqa: E402  it takes distances and kernels from here
