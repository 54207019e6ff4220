"""Which values count: finite, not a no-data sentinel, not a column's declared default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two no-data sentinels, and how near a value must be to one.
SENTINELS = (-99.0, -999.0)
SENTINEL_TOLERANCE = 1e-8


def finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def is_sentinel(x: Column) -> Column:
    """Near -99 or -999, and nothing else: other negatives are values."""
    near = F.lit(False)
    for s in SENTINELS:
        near = near | (F.abs(x - F.lit(s)) < SENTINEL_TOLERANCE)
    return F.coalesce(near, F.lit(False))


def usable(x: Column, default: float | None = None) -> Column:
    """Finite, no sentinel, not the declared default."""
    ok = finite(x) & ~is_sentinel(x)
    return ok if default is None else ok & (x != F.lit(default))


def in_range(x: Column, lo: float | None = None, hi: float | None = None, lo_inclusive: bool = True, hi_inclusive: bool = True) -> Column:
    """Each end open, inclusive or exclusive by itself; a missing value fails."""
    ok = finite(x)
    if lo is not None:
        ok = ok & ((x >= lo) if lo_inclusive else (x > lo))
    if hi is not None:
        ok = ok & ((x <= hi) if hi_inclusive else (x < hi))
    return ok


def between_any_order(x: Column, a: float, b: float, default: float | None = None) -> Column:
    return usable(x, default) & x.between(min(a, b), max(a, b))


def has_label(x: Column, labels: list[str]) -> Column:
    """Membership in a set of labels; a missing label fails."""
    return F.coalesce(x.isin(*labels), F.lit(False))


def resolved(value: Column, constant: Column, kind: Column, found: Column, wanted: str) -> Column:
    """The typed value, or its constant's; null if the constant is gone or of another kind."""
    return F.when(constant.isNull(), value).when(kind == wanted, found)


def at_position(values: Column, fields: Column, field: Column) -> Column:
    """The value at the place where `field` stands among `fields`; null if it doesn't."""
    place = F.array_position(fields, field)
    return F.when(place > 0, F.try_element_at(values, place.cast("int")))


def label_of(value: Column, labels: Column) -> Column:
    """The label that a captured category value names; null if it is missing, negative or names none."""
    ok = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < F.size(labels))
    return F.when(ok, F.try_element_at(labels, F.when(ok, F.floor(value)).otherwise(0).cast("int") + 1))


def corrected(now: list[Column], logged: list[Column], was_logged: Column) -> Column:
    """Whether a row was changed since it was logged; one that kept no log wasn't."""
    differs = F.lit(False)
    for a, b in zip(now, logged, strict=True):
        differs = differs | ~a.eqNullSafe(b)
    return was_logged & differs


def ramp(value: Column, stops: list[tuple[float, tuple[float, ...]]]) -> list[Column]:
    """Channels of a colour ramp of ascending stops: linear between them, held at both ends; null for a missing value."""
    out = []
    for channel in range(len(stops[0][1])):
        c = F.lit(float(stops[-1][1][channel]))
        for (a, low), (b, high) in reversed(list(zip(stops, stops[1:]))):
            t = F.least(F.greatest((value - a) / (b - a), F.lit(0.0)), F.lit(1.0))
            c = F.when(value <= b, low[channel] + (high[channel] - low[channel]) * t).otherwise(c)
        out.append(F.when(value.isNotNull() & ~F.isnan(value), c))
    return out


def inserted(items: Column, position: Column, item: Column) -> Column:
    """items with one more at a 0-based position, clamped to the end; null (refused) if it is a member already."""
    at = F.least(F.greatest(position, F.lit(0)), F.size(items)).cast("int")
    return F.when(~F.array_contains(items, item), F.concat(F.slice(items, F.lit(1), at), F.array(item), F.slice(items, at + 1, F.size(items))))


def moved(items: Column, source: Column, target: Column) -> Column:
    """items with the one at `source` taken out and put in at `target` (0-based); null if either isn't there."""
    n = F.size(items)
    ok = (source >= 0) & (source < n) & (target >= 0) & (target < n)
    a, b = F.when(ok, source).otherwise(0).cast("int"), F.when(ok, target).otherwise(0).cast("int")
    rest = F.concat(F.slice(items, F.lit(1), a), F.slice(items, a + 2, n))
    return F.when(ok, F.concat(F.slice(rest, F.lit(1), b), F.slice(items, a + 1, F.lit(1)), F.slice(rest, b + 1, n)))
