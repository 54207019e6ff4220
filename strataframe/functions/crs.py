"""Coordinate systems: projections, datums and site grids, and conversions planned over published transformations."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values

#: Semi-major axis and inverse flattening.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "ANS": (6378160.0, 298.25)}
#: Datums and their ellipsoids.
DATUMS = {"WGS84": "WGS84", "GDA94": "GRS80", "GDA2020": "GRS80", "AGD84": "ANS", "AGD66": "ANS"}
#: Published transformations: from, to, name, accuracy in metres, and metres, arc seconds and parts per million of the
#: coordinate frame rotation (null: the frames agree to within the accuracy).
SHIFTS = [
    ("GDA94", "GDA2020", "EPSG:8048 GDA94 to GDA2020 (1)", 0.01, (0.06155, -0.01087, -0.04019, -0.0394924, -0.0327221, -0.0328979, -0.009994)),
    ("AGD84", "GDA94", "EPSG:1280 AGD84 to GDA94 (2)", 1.0, (-117.763, -51.510, 139.061, -0.292, -0.443, -0.277, -0.191)),
    ("AGD66", "GDA94", "EPSG:15979 AGD66 to GDA94 (12)", 3.0, (-117.808, -51.536, 137.784, -0.303, -0.446, -0.234, -0.29)),
    ("WGS84", "GDA94", "EPSG:1150 GDA94 to WGS 84 (1)", 3.0, None),
]
#: Geographic systems by code, and the first and last zone of families of transverse Mercator systems by what is added to the zone.
GEOGRAPHIC = {4326: "WGS84", 4283: "GDA94", 7844: "GDA2020", 4203: "AGD84", 4202: "AGD66"}
ZONES = [(32600, "WGS84", False, 1, 60), (32700, "WGS84", True, 1, 60), (28300, "GDA94", True, 48, 58), (7800, "GDA2020", True, 46, 59), (20300, "AGD84", True, 48, 58), (20200, "AGD66", True, 48, 58)]
#: The transverse Mercator series of the sixth order, as fractions by power of the third flattening, from the order itself on.
ALPHA = [["1/2", "-2/3", "5/16", "41/180", "-127/288", "7891/37800"], ["13/48", "-3/5", "557/1440", "281/630", "-1983433/1935360"], ["61/240", "-103/140", "15061/26880", "167603/181440"], ["49561/161280", "-179/168", "6601661/7257600"], ["34729/80640", "-3418889/1995840"], ["212378941/319334400"]]
BETA = [["1/2", "-2/3", "37/96", "-1/360", "-81/512", "96199/604800"], ["1/48", "1/15", "-437/1440", "46/105", "-1118711/3870720"], ["17/480", "-37/840", "-209/4480", "5569/90720"], ["4397/161280", "-11/504", "-830251/7257600"], ["4583/161280", "-108847/3991680"], ["20648693/638668800"]]


@dataclass(frozen=True)
class System:
    """A geographic (degrees: x longitude, y latitude) or transverse Mercator system on a datum."""

    datum: str
    meridian: float | None = None
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0

    def ellipsoid(self) -> tuple[float, float]:
        a, inverse = ELLIPSOIDS[DATUMS[self.datum]]
        return a, 1 / inverse


@dataclass(frozen=True)
class SiteGrid:
    """A site's own numbering laid over a system: site = origin' + scale * R(turn) (parent - origin), heights unchanged."""

    parent: System | SiteGrid
    origin: tuple[float, float]
    site_origin: tuple[float, float] = (0.0, 0.0)
    turn: float = 0.0
    scale: float = 1.0


def system(code: int) -> System:
    """The system of a registered code; another is an error."""
    if code in GEOGRAPHIC:
        return System(GEOGRAPHIC[code])
    for base, datum, south, first, last in ZONES:
        if first <= code - base <= last:
            return System(datum, -183.0 + 6 * (code - base), north=10_000_000.0 if south else 0.0)
    raise ValueError(f"EPSG:{code} isn't registered")


def datum_path(source: str, target: str) -> list[tuple[tuple, bool]]:
    """The shortest chain of published transformations between two datums, each with whether it runs forwards; none is an error."""
    paths, seen = [(source, [])], {source}
    while paths:
        at, path = paths.pop(0)
        if at == target:
            return path
        for shift in SHIFTS:
            for here, there, forward in ((shift[0], shift[1], True), (shift[1], shift[0], False)):
                if here == at and there not in seen:
                    seen.add(there)
                    paths.append((there, [*path, (shift, forward)]))
    raise ValueError(f"no published transformation leads from {source} to {target}")


@dataclass
class Plan:
    """What a conversion will do: steps (names of published transformations), their worst accuracy (null: exact), whether it changes anything, and whether it is a flat change of grids."""

    steps: list[str] = field(default_factory=list)
    accuracy: float | None = None
    identity: bool = False
    flat: bool = False


def _base(s: System | SiteGrid) -> tuple[System, list[SiteGrid]]:
    grids = []
    while isinstance(s, SiteGrid):
        grids.append(s)
        s = s.parent
    return s, grids


def plan(source: System | SiteGrid, target: System | SiteGrid) -> Plan:
    """Look before converting; systems that no published chain joins are an error."""
    (a, grids), (b, others) = _base(source), _base(target)
    path = datum_path(a.datum, b.datum)
    moved = any(shift[4] for shift, _ in path)
    same = (a.meridian, a.scale, a.east, a.north, a.ellipsoid()) == (b.meridian, b.scale, b.east, b.north, b.ellipsoid())
    return Plan([shift[2] for shift, _ in path], max((shift[3] for shift, _ in path), default=None), same and not moved and grids == others, same and not moved)


def _series(n: float, table: list[list[str]]) -> list[float]:
    value = lambda text: int(text.split("/")[0]) / int(text.split("/")[1])
    return [sum(value(c) * n ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(table, 1)]


def _meridian_radius(a: float, f: float) -> tuple[float, float]:
    n = f / (2 - f)
    return n, a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


def _waves(xi: str, eta: str, terms: list[float], sign: float) -> tuple[Column, Column]:
    x, e = F.col(xi), F.col(eta)
    for j, c in enumerate(terms, 1):
        x = x + F.lit(sign * c) * F.sin(F.col(xi) * (2 * j)) * F.cosh(F.col(eta) * (2 * j))
        e = e + F.lit(sign * c) * F.cos(F.col(xi) * (2 * j)) * F.sinh(F.col(eta) * (2 * j))
    return x, e


def _to_plane(df: DataFrame, s: System) -> DataFrame:
    """__lon, __lat (radians) to __x, __y."""
    if s.meridian is None:
        return df.withColumns({"__x": F.degrees("__lon"), "__y": F.degrees("__lat")})
    a, f = s.ellipsoid()
    n, radius = _meridian_radius(a, f)
    e = math.sqrt(f * (2 - f))
    lon = F.col("__lon") - math.radians(s.meridian)
    df = df.withColumns({"__t": F.sinh(F.atanh(F.sin("__lat")) - e * F.atanh(e * F.sin("__lat"))), "__l": F.atan2(F.sin(lon), F.cos(lon))})
    df = df.withColumns({"__xi": F.atan2(F.col("__t"), F.cos("__l")), "__eta": F.asinh(F.sin("__l") / F.hypot(F.col("__t"), F.cos("__l")))})
    xi, eta = _waves("__xi", "__eta", _series(n, ALPHA), 1.0)
    return df.withColumns({"__x": F.lit(s.east) + eta * (s.scale * radius), "__y": F.lit(s.north) + xi * (s.scale * radius)})


def _from_plane(df: DataFrame, s: System) -> DataFrame:
    """__x, __y to __lon, __lat (radians)."""
    if s.meridian is None:
        return df.withColumns({"__lon": F.radians("__x"), "__lat": F.radians("__y")})
    a, f = s.ellipsoid()
    n, radius = _meridian_radius(a, f)
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    df = df.withColumns({"__u": (F.col("__y") - s.north) / (s.scale * radius), "__v": (F.col("__x") - s.east) / (s.scale * radius)})
    xi, eta = _waves("__u", "__v", _series(n, BETA), -1.0)
    df = df.withColumns({"__xi": xi, "__eta": eta})
    # the tangent of the conformal latitude, and from it by Newton's steps that of the latitude
    df = df.withColumn("__c", F.sin("__xi") / F.hypot(F.sinh("__eta"), F.cos("__xi"))).withColumn("__tau", F.col("__c"))
    for _ in range(4):
        tau, root = F.col("__tau"), F.sqrt(1 + F.col("__tau") * F.col("__tau"))
        df = df.withColumn("__sigma", F.sinh(e * F.atanh(e * tau / root)))
        conformal = tau * F.sqrt(1 + F.col("__sigma") * F.col("__sigma")) - F.col("__sigma") * root
        df = df.withColumn("__f", conformal)
        step = (F.col("__c") - F.col("__f")) / F.sqrt(1 + F.col("__f") * F.col("__f")) * (1 + (1 - e2) * tau * tau) / ((1 - e2) * root)
        df = df.withColumn("__tau", tau + step)
    turn = F.atan2(F.sinh("__eta"), F.cos("__xi")) + math.radians(s.meridian)
    return df.withColumns({"__lon": F.atan2(F.sin(turn), F.cos(turn)), "__lat": F.atan("__tau")})


def _matrix(h: tuple) -> list[list[float]]:
    rx, ry, rz = (math.radians(v / 3600) for v in h[3:6])
    k = 1 + h[6] * 1e-6
    return [[k, k * rz, -k * ry], [-k * rz, k, k * rx], [k * ry, -k * rx, k]]


def _inverse(m: list[list[float]]) -> list[list[float]]:
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum(m[0][j] * minor(0, j) for j in range(3))
    return [[minor(j, i) / det for j in range(3)] for i in range(3)]


def _shifted(df: DataFrame, h: tuple, forward: bool) -> DataFrame:
    """__gx, __gy, __gz moved to the other frame; backwards by the exact inverse."""
    g = [F.col(f"__g{c}") for c in "xyz"]
    m, t = _matrix(h), h[:3]
    if not forward:
        g, m, t = [c - v for c, v in zip(g, t, strict=True)], _inverse(m), (0.0, 0.0, 0.0)
    return df.withColumns({f"__g{c}": sum((g[j] * m[i][j] for j in range(3)), F.lit(float(t[i]))) for i, c in enumerate("xyz")})


def geocentric(df: DataFrame, ellipsoid: tuple[float, float]) -> DataFrame:
    """__lon, __lat, __h to __gx, __gy, __gz."""
    a, f = ellipsoid
    e2 = f * (2 - f)
    df = df.withColumn("__n", F.lit(a) / F.sqrt(1 - e2 * F.sin("__lat") * F.sin("__lat")))
    flat = (F.col("__n") + F.col("__h")) * F.cos("__lat")
    return df.withColumns({"__gx": flat * F.cos("__lon"), "__gy": flat * F.sin("__lon"), "__gz": (F.col("__n") * (1 - e2) + F.col("__h")) * F.sin("__lat")})


def _geodetic(df: DataFrame, ellipsoid: tuple[float, float]) -> DataFrame:
    """__gx, __gy, __gz to __lon, __lat, by a fixed point that is exact to nanometres after five steps."""
    a, f = ellipsoid
    e2 = f * (2 - f)
    df = df.withColumn("__p", F.hypot("__gx", "__gy")).withColumn("__lat", F.atan2(F.col("__gz"), F.col("__p") * (1 - e2)))
    for _ in range(5):
        n = F.lit(a) / F.sqrt(1 - e2 * F.sin("__lat") * F.sin("__lat"))
        df = df.withColumn("__lat", F.atan2(F.col("__gz") + e2 * n * F.sin("__lat"), F.col("__p")))
    return df.withColumn("__lon", F.atan2(F.col("__gy"), F.col("__gx")))


def _on_grid(df: DataFrame, grid: SiteGrid, back: bool) -> DataFrame:
    c, s = math.cos(math.radians(grid.turn)), math.sin(math.radians(grid.turn))
    start, end, k = (grid.site_origin, grid.origin, 1 / grid.scale) if back else (grid.origin, grid.site_origin, grid.scale)
    s = -s if back else s
    dx, dy = F.col("__x") - start[0], F.col("__y") - start[1]
    return df.withColumns({"__x": F.lit(end[0]) + (dx * c - dy * s) * k, "__y": F.lit(end[1]) + (dx * s + dy * c) * k})


def convert(df: DataFrame, source: System | SiteGrid, target: System | SiteGrid, columns: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """df with its coordinates moved from one system to another; heights stay as they are.

    A conversion that changes nothing returns the very same numbers; one between grids of a projection stays flat. Else
    points go off the site's grid, to the ellipsoid, through the published chain of frames (the height takes part, but
    comes back unchanged), and down again. Missing or non-finite coordinates give null. All of it is column
    expressions; systems that no chain joins are an error before any row is read.
    """
    p = plan(source, target)
    if p.identity:
        return df
    (a, grids), (b, others) = _base(source), _base(target)
    x, y, z = columns
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    out = df.withColumns({"__x": F.when(ok, F.col(x).cast("double")), "__y": F.when(ok, F.col(y).cast("double")), "__h": F.col(z).cast("double")})
    for grid in grids:
        out = _on_grid(out, grid, back=True)
    if not p.flat:
        out = _from_plane(out, a)
        chain = [(shift[4], forward) for shift, forward in datum_path(a.datum, b.datum) if shift[4]]
        if chain:
            out = geocentric(out, a.ellipsoid())
            for h, forward in chain:
                out = _shifted(out, h, forward)
            out = _geodetic(out, b.ellipsoid())
        out = _to_plane(out, b)
    for grid in reversed(others):
        out = _on_grid(out, grid, back=False)
    return out.withColumns({x: F.col("__x"), y: F.col("__y")}).select(*df.columns)
