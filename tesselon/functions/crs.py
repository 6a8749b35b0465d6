"""Swiss LV95 and WGS84: oblique Mercator on the Bessel ellipsoid and a three-parameter shift.

The transformation is a list of named steps in SQL both Spark and ANSI engines read, evaluated as
one projection a step, so every intermediate value is computed once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

# Bessel 1841, WGS84, the projection's origin, and the datum shift.
BESSEL_A, BESSEL_E2 = 6377397.155, 0.006674372230614
WGS_A, WGS_E2 = 6378137.0, 0.00669437999014
LAT0, LON0 = math.radians(46 + 57 / 60 + 8.66 / 3600), math.radians(7 + 26 / 60 + 22.50 / 3600)
SHIFT = 674.374, 15.056, 405.346
FALSE_EAST, FALSE_NORTH = 2600000.0, 1200000.0

_E = math.sqrt(BESSEL_E2)
_ALPHA = math.sqrt(1 + BESSEL_E2 / (1 - BESSEL_E2) * math.cos(LAT0) ** 4)
_R = BESSEL_A * math.sqrt(1 - BESSEL_E2) / (1 - BESSEL_E2 * math.sin(LAT0) ** 2)
_B0 = math.asin(math.sin(LAT0) / _ALPHA)
_K = math.log(math.tan(math.pi / 4 + _B0 / 2)) - _ALPHA * math.log(math.tan(math.pi / 4 + LAT0 / 2)) + _ALPHA * _E / 2 * math.log((1 + _E * math.sin(LAT0)) / (1 - _E * math.sin(LAT0)))


def number(x: float) -> str:
    """A double literal in either dialect."""
    text = repr(float(x))
    return f"({text}{'' if 'e' in text else 'e0'})"


def _shifted(lat: str, lon: str, a: float, e2: float, sign: int, to_a: float, to_e2: float) -> list[tuple[str, str]]:
    """Geodetic to geocentric (height 0), shift, and back on the other ellipsoid by iteration."""
    n, dx, dy, dz = number, *(number(sign * s) for s in SHIFT)
    steps = [
        ("nu", f"{n(a)} / sqrt(1 - {n(e2)} * sin({lat}) * sin({lat}))"),
        ("gx", f"nu * cos({lat}) * cos({lon}) + {dx}"),
        ("gy", f"nu * cos({lat}) * sin({lon}) + {dy}"),
        ("gz", f"nu * (1 - {n(e2)}) * sin({lat}) + {dz}"),
        ("gp", "sqrt(gx * gx + gy * gy)"),
        ("t0", f"atan(gz / (gp * (1 - {n(to_e2)})))"),
    ]
    for i in range(5):
        steps.append((f"t{i + 1}", f"atan((gz + {n(to_e2 * to_a)} * sin(t{i}) / sqrt(1 - {n(to_e2)} * sin(t{i}) * sin(t{i}))) / gp)"))
    return [*steps, ("out_lat", "t5"), ("out_lon", "atan2(gy, gx)")]


def to_wgs84_steps(x: str = "x", y: str = "y") -> list[tuple[str, str]]:
    n = number
    steps = [
        ("lq", f"({x} - {n(FALSE_EAST)}) / {n(_R)}"),
        ("bq", f"2 * (atan(exp(({y} - {n(FALSE_NORTH)}) / {n(_R)})) - {n(math.pi / 4)})"),
        ("b", f"asin({n(math.cos(_B0))} * sin(bq) + {n(math.sin(_B0))} * cos(bq) * cos(lq))"),
        ("l", f"atan(sin(lq) / ({n(math.cos(_B0))} * cos(lq) - {n(math.sin(_B0))} * tan(bq)))"),
        ("blon", f"{n(LON0)} + l / {n(_ALPHA)}"),
        ("s", f"(ln(tan({n(math.pi / 4)} + b / 2)) - {n(_K)}) / {n(_ALPHA)}"),
        ("f0", "b"),
    ]
    for i in range(6):
        steps.append((f"f{i + 1}", f"2 * atan(exp(s + {n(_E)} * ln(tan({n(math.pi / 4)} + asin({n(_E)} * sin(f{i})) / 2)))) - {n(math.pi / 2)}"))
    return steps + _shifted("f6", "blon", BESSEL_A, BESSEL_E2, 1, WGS_A, WGS_E2) + [("lat", "degrees(out_lat)"), ("lon", "degrees(out_lon)")]


def to_lv95_steps(lat: str = "lat", lon: str = "lon") -> list[tuple[str, str]]:
    n = number
    return [
        ("rlat", f"radians({lat})"),
        ("rlon", f"radians({lon})"),
        *_shifted("rlat", "rlon", WGS_A, WGS_E2, -1, BESSEL_A, BESSEL_E2),
        ("s", f"{n(_ALPHA)} * ln(tan({n(math.pi / 4)} + out_lat / 2)) - {n(_ALPHA * _E / 2)} * ln((1 + {n(_E)} * sin(out_lat)) / (1 - {n(_E)} * sin(out_lat))) + {n(_K)}"),
        ("b", f"2 * (atan(exp(s)) - {n(math.pi / 4)})"),
        ("l", f"{n(_ALPHA)} * (out_lon - {n(LON0)})"),
        ("lq", f"atan(sin(l) / ({n(math.sin(_B0))} * tan(b) + {n(math.cos(_B0))} * cos(l)))"),
        ("bq", f"asin({n(math.cos(_B0))} * sin(b) - {n(math.sin(_B0))} * cos(b) * cos(l))"),
        ("east", f"{n(_R)} * lq + {n(FALSE_EAST)}"),
        ("north", f"{n(_R / 2)} * ln((1 + sin(bq)) / (1 - sin(bq))) + {n(FALSE_NORTH)}"),
    ]


def _apply(df: DataFrame, steps: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    columns = df.columns
    for name, expression in steps:
        df = df.selectExpr("*", f"{expression} as {name}") if name not in df.columns else df
    return df.select(*columns, *keep)


def with_lonlat(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds lat and lon (degrees)."""
    return _apply(df, to_wgs84_steps(x, y), ["lat", "lon"])


def with_lv95(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds east and north (metres)."""
    return _apply(df, to_lv95_steps(lat, lon), ["east", "north"])


def as_sql(source: str, steps: list[tuple[str, str]], columns: str) -> str:
    """The same steps as nested ANSI queries over ``source``."""
    for name, expression in steps:
        source = f"SELECT *, {expression} AS {name} FROM ({source})"
    return f"SELECT {columns} FROM ({source})"
