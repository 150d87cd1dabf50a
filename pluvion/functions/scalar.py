"""Scalar expressions as SQL text: distances, kernels, labels, physics and geometry.

Numbers carry an exponent so that both dialects take them as doubles.
"""

from __future__ import annotations

from .dialect import Spark, pmod

#: Earth radii in km.
RADIUS, RADIUS_SELECTION, RADIUS_GRID = 6378.388, 6371.0088, 6378.137
KERNELS = ("gaussian", "exponential", "bisquare", "tricube", "boxcar")
COINCIDENT_KM = 1.4901161193847656e-08
WET, RESOLUTION = 0.1, 0.5
#: Intensity classes, benchmark rain classes, strata of distance, relief and false alarms.
INTENSITY_EDGES = (0.1, 2.0, 4.0, 8.0, 20.0)
RAIN_EDGES = (0.1, 2.5, 8.0)
ENVELOPE_EDGES = (0.1, 2.5, 8.0)
DISTANCE_EDGES_KM = (20.0, 50.0, 100.0)
RELIEF_EDGES = (30.0, 200.0, 500.0, 1000.0)
PAIR_EDGES_KM = (0.0, 5.0, 10.0, 20.0, 40.0, 60.0)
SATELLITE_HEIGHT_KM, SATELLITE_LONGITUDE, GRID_SIDE, PIXEL_M = 42164.0, 133.0, 2748, 4000.0


def num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def haversine(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = RADIUS) -> str:
    a = f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * {num(radius)} * asin(sqrt(least(greatest({a}, 0e0), 1e0))))"


def kernel(name: str, d: str, bw: str) -> str:
    """Weight at distance d; a NULL or infinite bandwidth weighs all alike."""
    u = f"({d} / {bw})"
    shape = {
        "gaussian": f"exp(-power({d}, 2) / (2 * power({bw}, 2)))",
        "exponential": f"exp(-{u})",
        "bisquare": f"CASE WHEN {d} > {bw} THEN 0e0 ELSE power(1 - power({u}, 2), 2) END",
        "tricube": f"CASE WHEN {d} > {bw} THEN 0e0 ELSE power(1 - power({u}, 3), 3) END",
        "boxcar": f"CASE WHEN {d} > {bw} THEN 0e0 ELSE 1e0 END",
    }[name]
    return f"CASE WHEN {bw} IS NULL THEN 1e0 ELSE {shape} END"


def east_km(lon: str, lat: str, lon0: str, lat0: str, radius: float = RADIUS) -> str:
    """Kilometres east of a target, right across the date line."""
    turn = f"({pmod(f'{lon} - {lon0} + 180', '360')} - 180)"
    return f"({num(radius)} * radians({turn}) * cos(radians({lat0})))"


def north_km(lat: str, lat0: str, radius: float = RADIUS) -> str:
    return f"({num(radius)} * radians({lat} - {lat0}))"


def classed(x: str, edges: tuple[float, ...]) -> str:
    """Number of edges not above x; NULL: -1."""
    steps = " ".join(f"WHEN {x} < {num(e)} THEN {i}" for i, e in enumerate(edges))
    return f"CAST(CASE WHEN {x} IS NULL THEN -1 {steps} ELSE {len(edges)} END AS BIGINT)"


def season(month: str) -> str:
    return f"CASE WHEN {month} IN (3, 4, 5) THEN 'MAM' WHEN {month} IN (6, 7, 8) THEN 'JJA' WHEN {month} IN (9, 10, 11) THEN 'SON' ELSE 'DJF' END"


def relative_humidity(t_k: str, d_k: str) -> str:
    """Magnus, in percent, kept in 0 to 100."""
    e = lambda t: f"exp(17.625e0 * ({t} - 273.15e0) / (243.04e0 + {t} - 273.15e0))"
    return f"least(greatest(100 * {e(d_k)} / {e(t_k)}, 0e0), 100e0)"


def wind_speed(u: str, v: str) -> str:
    return f"sqrt({u} * {u} + {v} * {v})"


def wind_direction(u: str, v: str) -> str:
    return pmod(f"degrees(atan2(-({u}), -({v})))", "360")


def aspect_component(trig: str, aspect: str, slope: str, flat: float = 0.1) -> str:
    return f"CASE WHEN {slope} < {num(flat)} THEN 0e0 ELSE {trig}(radians({aspect})) END"


def hour_difference(a: str, b: str) -> str:
    """Circular, in [-12, 12)."""
    return f"({pmod(f'{a} - {b} + 12', '24')} - 12)"


def relief_class(m: str) -> str:
    names = ("plain", "low_hill", "hill", "low_mountain", "mountain")
    steps = " ".join(f"WHEN {m} < {num(e)} THEN '{n}'" for e, n in zip(RELIEF_EDGES, names))
    return f"CASE WHEN {m} IS NULL THEN NULL {steps} ELSE '{names[-1]}' END"


def cell_index(x: str, low: float, step: float = 0.1) -> str:
    return f"CAST(FLOOR(({x} + {num(low)}) / {num(step)}) AS BIGINT)"


def scan_angles(lon: str, lat: str, sat_lon: float = SATELLITE_LONGITUDE) -> tuple[str, str]:
    """Scan angles (x, y) in radians of a point seen from a geostationary satellite over a sphere."""
    dl = f"radians({lon} - {num(sat_lon)})"
    phi = f"radians({lat})"
    r1 = f"({num(SATELLITE_HEIGHT_KM)} - {num(RADIUS_GRID)} * cos({phi}) * cos({dl}))"
    r2 = f"({num(-RADIUS_GRID)} * cos({phi}) * sin({dl}))"
    r3 = f"({num(RADIUS_GRID)} * sin({phi}))"
    return f"atan2(-{r2}, {r1})", f"asin(-{r3} / sqrt(power({r1}, 2) + power({r2}, 2) + power({r3}, 2)))"


def grid_position(angle: str) -> str:
    """Position on the full disc, counted from 0 at its edge; the centre is the middle of the grid."""
    per_pixel = PIXEL_M / 1000.0 / (SATELLITE_HEIGHT_KM - RADIUS_GRID)
    return f"({angle} / {num(per_pixel)} + {num((GRID_SIDE - 1) / 2)})"


def pixel(d: Spark, position: str) -> str:
    """Nearest pixel, counted from 1; halves go to the even one."""
    return f"CAST({d.round_even(position)} + 1 AS BIGINT)"


def agreement_band(sources: tuple[str, ...]) -> str:
    """0 where no source is wet, else 1 to 9: sources that agree (up to 3) by class of the largest."""
    wet = " + ".join(f"CASE WHEN {s} >= {num(WET)} THEN 1 ELSE 0 END" for s in sources)
    top = f"greatest({', '.join(sources)})"
    envelope = f"(CASE WHEN {top} < {num(ENVELOPE_EDGES[1])} THEN 1 WHEN {top} < {num(ENVELOPE_EDGES[2])} THEN 2 ELSE 3 END)"
    return f"CAST(CASE WHEN ({wet}) = 0 THEN 0 ELSE (least({wet}, 3) - 1) * 3 + {envelope} END AS BIGINT)"


def stack_band(agreement: str, km: str) -> str:
    near, far = num(20.0), num(50.0)
    return f"CAST({agreement} * 3 + CASE WHEN {km} < {near} THEN 0 WHEN {km} < {far} THEN 1 ELSE 2 END AS BIGINT)"


def blend(product: str, prediction: str, fallback: str, weight: str, wet: float = WET) -> str:
    """Prediction, mixed with the fallback where the product is wet and both are known."""
    return (
        f"CASE WHEN {product} IS NULL OR {prediction} IS NULL THEN NULL "
        f"WHEN {product} >= {num(wet)} AND {fallback} IS NOT NULL THEN (1 - {weight}) * {prediction} + {weight} * {fallback} ELSE {prediction} END"
    )


def clean_ndvi(raw: str, reliability: str) -> str:
    return f"CASE WHEN {raw} BETWEEN -2000 AND 10000 AND {reliability} IN (0, 1) THEN {raw} * 1e-4 END"


def tps_kernel(r2: str) -> str:
    return f"CASE WHEN {r2} <= 2.220446049250313e-16 THEN 0e0 ELSE 0.5e0 * {r2} * ln({r2}) END"
