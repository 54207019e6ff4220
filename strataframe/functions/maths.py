"""Arithmetic of series, units, penalties and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grams of a grade unit in a tonne, and grams of a sales unit.
GRADE_GRAMS = {"percent": 10_000.0, "ppm": 1.0, "g/t": 1.0, "ppb": 0.001, "kg/t": 1000.0}
SALES_GRAMS = {"gram": 1.0, "troy ounce": 31.1034768, "pound": 453.59237, "kilogram": 1000.0, "tonne": 1_000_000.0}
BEARINGS = {"N": 0.0, "NE": 45.0, "E": 90.0, "SE": 135.0, "S": 180.0, "SW": 225.0, "W": 270.0, "NW": 315.0}


def round_up_to_series(x: Column, steps: tuple[float, ...] = (1.0, 2.0, 5.0)) -> Column:
    """The least step times a power of ten that isn't below x; null for x <= 0."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    out = base * 10 * steps[0]
    for s in reversed(steps):
        out = F.when(x <= base * s * (1 + 1e-12), base * s).otherwise(out)
    return F.when(x > 0, out)


def metal_factor(grade_unit: str, sales_unit: str) -> float:
    """Sales units in a tonne at a grade of one."""
    return GRADE_GRAMS[grade_unit] / SALES_GRAMS[sales_unit]


def metal_factors(grade_unit: Column, sales_unit: Column) -> Column:
    """The same of columns; an unknown unit gives null."""
    of = lambda grams, unit: F.try_element_at(F.create_map(*[F.lit(x) for kv in grams.items() for x in kv]), unit)
    return of(GRADE_GRAMS, grade_unit) / of(SALES_GRAMS, sales_unit)


def series_count(start: float, stop: float, step: float) -> int | None:
    """Members of start, start + step, ... that end at stop."""
    if not step > 0 or stop < start:
        return None
    return int((stop - start) / step + 1 + 1e-9)


def bearing(direction: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in BEARINGS.items() for x in kv]), F.upper(direction))


def hinge(x: Column, lo: float | None, hi: float | None, weight: float = 1.0) -> Column:
    """Penalty outside [lo, hi], linear in the distance."""
    under = F.greatest(F.lit(0.0), F.lit(lo) - x) if lo is not None else F.lit(0.0)
    over = F.greatest(F.lit(0.0), x - F.lit(hi)) if hi is not None else F.lit(0.0)
    return (under + over) * weight


def spherical_covariance(h: Column, sill: float, nugget: float, reach: float) -> Column:
    """Covariance at distance h of a spherical variogram with a nugget."""
    r = h / F.lit(reach)
    return F.when(h <= 0, F.lit(sill)).when(h >= reach, F.lit(0.0)).otherwise((sill - nugget) * (1 - 1.5 * r + 0.5 * r * r * r))


def micrometres(x: Column) -> Column:
    return F.round(x * 1e6).cast("long")


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Bits of x and y in turn, x lowest."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), i).bitwiseAND(F.lit(1)), 2 * i))
        out = out.bitwiseOR(F.shiftleft(F.shiftright(y.cast("long"), i).bitwiseAND(F.lit(1)), 2 * i + 1))
    return out


def fixed_point_digits(total: float, most: int = 9, limit: float = 4.6e18) -> int:
    """Decimal digits that keep a total within 64 bits, `most` at most."""
    d = most
    while d > 0 and abs(total) * 10**d >= limit:
        d -= 1
    return d


def hourly(rate: Column, per_day: Column) -> Column:
    return F.when(per_day, rate / 24).otherwise(rate)


def hole_charge(diameter: Column, depth: Column, stemming: Column, density: Column) -> Column:
    return F.pi() * F.pow(diameter / 2, 2) * F.greatest(depth - stemming, F.lit(0.0)) * density


def budget(n: Column, percent: Column, least: int = 3) -> Column:
    """A percentage of n, or all of it where the percentage is null; `least` at least, and n at most unless that is less."""
    part = F.coalesce(F.round(n * percent / 100).cast("long"), n.cast("long"))
    return F.greatest(F.lit(least).cast("long"), F.least(n.cast("long"), part))
