"""Building blocks of SQL plans: scores, linear systems, ranks and islands."""

from __future__ import annotations

from ..functions.scalar import num

EPS = "2.220446049250313e-16"


def pearson(x: str, y: str) -> str:
    """Correlation from centred sums; NULL where a side is constant."""
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def scores(y: str, p: str, digits: int = 6) -> str:
    """n, rmse, mae, bias and r of a group as a SELECT list; r is NULL where a side is constant or n < 2."""
    both = f"({y}) IS NOT NULL AND ({p}) IS NOT NULL"
    e = lambda x: f"CASE WHEN {both} THEN {x} END"
    n = f"count({e('1')})"
    vary = " AND ".join(f"max({e(x)}) > min({e(x)})" for x in (y, p))
    r = f"CASE WHEN {n} >= 2 AND {vary} THEN round({pearson(e(y), e(p))}, {digits}) END"
    return (
        f"CAST({n} AS BIGINT) AS n, round(sqrt(avg({e(f'power(({p}) - ({y}), 2)')})), {digits}) AS rmse, round(avg({e(f'abs(({p}) - ({y}))')}), {digits}) AS mae, "
        f"round(avg({e(f'({p}) - ({y})')}), {digits}) AS bias, {r} AS r"
    )


def event_scores(y: str, p: str, threshold: float, digits: int = 6) -> str:
    """hits, misses, false alarms, pod, far, csi; both sides count from the threshold on."""
    both, t = f"({y}) IS NOT NULL AND ({p}) IS NOT NULL", num(threshold)
    c = lambda cond: f"sum(CASE WHEN {both} AND {cond} THEN 1 ELSE 0 END)"
    hit, miss, false = c(f"({y}) >= {t} AND ({p}) >= {t}"), c(f"({y}) >= {t} AND ({p}) < {t}"), c(f"({y}) < {t} AND ({p}) >= {t}")
    ratio = lambda a, b: f"round({a} * 1e0 / nullif({b}, 0), {digits})"
    return (
        f"CAST({hit} AS BIGINT) AS hits, CAST({miss} AS BIGINT) AS misses, CAST({false} AS BIGINT) AS false_alarms, "
        f"{ratio(hit, f'({hit} + {miss})')} AS pod, {ratio(false, f'({hit} + {false})')} AS far, {ratio(hit, f'({hit} + {miss} + {false})')} AS csi"
    )


def correlation(x: str, y: str, least: int = 2, digits: int = 6) -> str:
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    e = lambda v: f"CASE WHEN {both} THEN {v} END"
    vary = " AND ".join(f"max({e(v)}) > min({e(v)})" for v in (x, y))
    return f"CASE WHEN count({e('1')}) >= {least} AND {vary} THEN round({pearson(e(x), e(y))}, {digits}) END"


def solve3(a: tuple[str, ...], b: tuple[str, str, str]) -> tuple[str, str, str, str]:
    """(determinant, x0, x1, x2 times the determinant) of a symmetric system with a = (a00, a01, a02, a11, a12, a22)."""
    a00, a01, a02, a11, a12, a22 = (f"({x})" for x in a)
    b0, b1, b2 = (f"({x})" for x in b)
    c00, c01, c02 = f"({a11} * {a22} - {a12} * {a12})", f"({a02} * {a12} - {a01} * {a22})", f"({a01} * {a12} - {a02} * {a11})"
    c11, c12, c22 = f"({a00} * {a22} - {a02} * {a02})", f"({a01} * {a02} - {a00} * {a12})", f"({a00} * {a11} - {a01} * {a01})"
    det = f"({a00} * {c00} + {a01} * {c01} + {a02} * {c02})"
    return det, f"({c00} * {b0} + {c01} * {b1} + {c02} * {b2})", f"({c01} * {b0} + {c11} * {b1} + {c12} * {b2})", f"({c02} * {b0} + {c12} * {b1} + {c22} * {b2})"


def eliminate(source: str, keys: list[str], n: int, result: str = "x") -> str:
    """CTEs that solve the n x n systems of a table with columns a0_0 .. (upper and lower) and b0 .. by elimination.

    Gives ``<source>_solved`` with the keys and x0 .. ; a pivot of 0 gives NULLs.
    """
    out, now = [], source
    keep = ", ".join(keys)
    for k in range(n):
        cols = []
        for i in range(n):
            for j in range(k + 1, n):
                pivot = f"a{k}_{j} / nullif(a{k}_{k}, 0)"
                cols.append(f"{pivot} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * ({pivot}) AS a{i}_{j}")
            pivot = f"b{k} / nullif(a{k}_{k}, 0)"
            cols.append(f"{pivot} AS b{k}" if i == k else f"b{i} - a{i}_{k} * ({pivot}) AS b{i}")
        out.append(f"{source}_e{k} AS (SELECT {keep + ', ' if keep else ''}{', '.join(cols)} FROM {now})")
        now = f"{source}_e{k}"
    out.append(f"{source}_solved AS (SELECT {keep + ', ' if keep else ''}{', '.join(f'b{i} AS {result}{i}' for i in range(n))} FROM {now})")
    return ",\n".join(out)


def gram(features: list[str], y: str, weight: str = "1e0") -> str:
    """Sums of products of the features and of each with y as a SELECT list: a0_0 .., b0 .., yy, n."""
    out = [f"sum({weight} * ({f}) * ({g})) AS a{i}_{j}" for i, f in enumerate(features) for j, g in enumerate(features)]
    out += [f"sum({weight} * ({f}) * ({y})) AS b{i}" for i, f in enumerate(features)]
    return ", ".join([*out, f"sum({weight} * ({y}) * ({y})) AS yy", "CAST(count(*) AS BIGINT) AS n"])


def tied_rank(x: str, partition: str = "") -> str:
    p = f"PARTITION BY {partition} " if partition else ""
    q = f"PARTITION BY {partition + ', ' if partition else ''}{x}"
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({q}) - 1) / 2e0)"
