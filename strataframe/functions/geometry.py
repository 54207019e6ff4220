"""Plane and space geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def orient2d(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a triangle; positive if it turns left."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def shoelace(ring: Column) -> Column:
    """Unsigned area of a ring given as array<struct<x,y>>, closed or not."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(crosses, F.lit(0.0), lambda a, x: a + x)) / 2


def perimeter(ring: Column) -> Column:
    nxt = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    sides = F.zip_with(ring, nxt, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(sides, F.lit(0.0), lambda a, x: a + x)


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd point in polygon; holes are further rings, combined by exclusive or."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    hits = F.zip_with(ring, nxt, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"])))
    return F.aggregate(hits, F.lit(False), lambda a, h: a != h)


def direction(azimuth: Column, dip: Column) -> list[Column]:
    """Unit vector of an azimuth (degrees from north, clockwise) and a dip (degrees, negative down)."""
    a, d = F.radians(azimuth), F.radians(dip)
    return [F.sin(a) * F.cos(d), F.cos(a) * F.cos(d), F.sin(d)]


def orientation(dx: Column, dy: Column, dz: Column) -> list[Column]:
    """Azimuth in [0, 360) and dip of a vector."""
    azimuth = F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))
    return [azimuth, F.degrees(F.atan2(dz, F.hypot(dx, dy)))]


def similarity(x: Column, y: Column, scale: float, degrees: float, tx: float, ty: float) -> list[Column]:
    """Scale, rotate and shift in plan."""
    c, s = F.cos(F.radians(F.lit(degrees))) * scale, F.sin(F.radians(F.lit(degrees))) * scale
    return [c * x - s * y + tx, s * x + c * y + ty]


def similarity_inverse(x: Column, y: Column, scale: float, degrees: float, tx: float, ty: float) -> list[Column]:
    c, s = F.cos(F.radians(F.lit(degrees))) / scale, F.sin(F.radians(F.lit(degrees))) / scale
    return [c * (x - tx) + s * (y - ty), c * (y - ty) - s * (x - tx)]


def box_volume(dx: Column, dy: Column, dz: Column, det: float = 1.0) -> Column:
    return dx * dy * dz * abs(det)


def tetra_volume(a: Column, b: Column, c: Column) -> Column:
    """Signed volume under the origin of a triangle of struct<x,y,z>."""
    return (a["x"] * (b["y"] * c["z"] - b["z"] * c["y"]) - a["y"] * (b["x"] * c["z"] - b["z"] * c["x"]) + a["z"] * (b["x"] * c["y"] - b["y"] * c["x"])) / 6


def crosses(za: Column, zb: Column, level: Column) -> Column:
    """Half-open: an edge crosses a level that its lower end reaches and its upper end exceeds."""
    return ((za <= level) & (level < zb)) | ((zb <= level) & (level < za))


def boxes_meet(lo1: list[Column], hi1: list[Column], lo2: list[Column], hi2: list[Column]) -> Column:
    ok = F.lit(True)
    for a, b, c, d in zip(lo1, hi1, lo2, hi2, strict=True):
        ok = ok & (a <= d) & (c <= b)
    return ok


def rotated(local: list[Column], origin: list[Column], degrees: Column) -> list[Column]:
    """World position of a local one: turned clockwise from north about the vertical, then moved to the origin."""
    a = F.radians(degrees)
    x, y, z = local
    return [origin[0] + x * F.cos(a) + y * F.sin(a), origin[1] - x * F.sin(a) + y * F.cos(a), origin[2] + z]


def rotated_half_sizes(size: list[Column], degrees: Column) -> list[Column]:
    """Half the sizes of the upright box around a box turned about the vertical."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return [(size[0] * c + size[1] * s) / 2, (size[0] * s + size[1] * c) / 2, size[2] / 2]


def local_to_world(local: list[Column], origin: list[float], axes: list[list[float]]) -> list[Column]:
    """World position of a local one in a frame turned any way: axes are the local x, y and z in the world."""
    return [F.lit(float(origin[k])) + sum((local[a] * float(axes[a][k]) for a in range(3)), F.lit(0.0)) for k in range(3)]


def turned_half_sizes(size: list[Column], axes: list[list[float]]) -> list[Column]:
    """Half the sizes of the upright box around a box of a turned frame."""
    return [sum((size[a] * abs(float(axes[a][k])) for a in range(3)), F.lit(0.0)) / 2 for k in range(3)]


def corners(centre: list[Column], size: list[Column], axes: list[list[float]]) -> Column:
    """The eight corners of a box of a turned frame, as an array of struct x, y, z; the local x changes fastest."""
    out = []
    for i in range(8):
        half = [size[a] * (0.5 if i >> a & 1 else -0.5) for a in range(3)]
        at = [centre[k] + sum((half[a] * float(axes[a][k]) for a in range(3)), F.lit(0.0)) for k in range(3)]
        out.append(F.struct(*[c.alias(n) for c, n in zip(at, "xyz", strict=True)]))
    return F.array(*out)


def symmetric_eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, largest first, in closed form."""
    off = xy * xy + xz * xz + yz * yz
    mean = (xx + yy + zz) / 3
    a, b, c = xx - mean, yy - mean, zz - mean
    p = F.sqrt((a * a + b * b + c * c + 2 * off) / 6)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))).otherwise(F.lit(1.0))
    phi = F.acos(r) / 3
    first = mean + 2 * p * F.cos(phi)
    last = mean + 2 * p * F.cos(phi + 2 * F.pi() / 3)
    return [first, 3 * mean - first - last, last]


def overlap_tolerance(dx: Column, dy: Column) -> Column:
    """The plan area below which an overlap of a surface of this extent is rounding."""
    extent = F.greatest(F.abs(dx), F.abs(dy))
    return F.greatest(extent * extent * 1e-14, F.lit(1e-10))


def slope_at(azimuth: Column, pairs: list[tuple[float, float]]) -> Column:
    """The slope at an azimuth in degrees, linear and circular between pairs (azimuth, slope); one pair holds everywhere."""
    ordered = sorted((a % 360.0, s) for a, s in pairs)
    if len(ordered) == 1:
        return F.lit(float(ordered[0][1]))
    at = F.pmod(azimuth, F.lit(360.0))
    out = None
    for k, (a, s) in enumerate(ordered):
        b, low = ordered[k - 1]
        width = (a - b) % 360.0
        t = F.pmod(at - b, F.lit(360.0)) / width if width else F.lit(0.0)
        here = low + (s - low) * t
        out = F.when(at <= a, here) if out is None else out.when(at <= a, here)
    b, low = ordered[-1]
    a, s = ordered[0]
    return out.otherwise(low + (s - low) * (F.pmod(at - b, F.lit(360.0)) / ((a - b) % 360.0)))


#: Metres of an arc that a piece aims at, and the least and most pieces of an arc.
ARC_LENGTH, ARC_LEAST, ARC_MOST = 0.15, 16, 4096


def arc_points(start: Column, end: Column, bulge: Column) -> Column:
    """The points of an arc from start to end (struct x, y, z) but the first, as an array: bulge is the tangent of a quarter of its sweep.

    A bulge of 0, or a chord without length in plan, is the end alone. Heights go evenly.
    """
    dx, dy = end["x"] - start["x"], end["y"] - start["y"]
    chord = F.hypot(dx, dy)
    straight = (F.abs(bulge) <= 2.220446049250313e-16) | (chord <= 2.220446049250313e-16) | bulge.isNull()
    safe, length = F.when(~straight, bulge), F.when(~straight, chord)
    sweep, radius = F.atan(safe) * 4, length * (1 + safe * safe) / (F.abs(safe) * 4)
    away = (1 - safe * safe) / (safe * 4)
    cx, cy = (start["x"] + end["x"]) / 2 - dy * away, (start["y"] + end["y"]) / 2 + dx * away
    n = F.greatest(F.lit(ARC_LEAST), F.least(F.lit(ARC_MOST), F.ceil(radius * F.abs(sweep) / ARC_LENGTH))).cast("int")
    own = {"n": n, "sweep": sweep, "cx": cx, "cy": cy, "vx": start["x"] - cx, "vy": start["y"] - cy, "z": start["z"], "rise": end["z"] - start["z"]}

    def inner(a: Column) -> Column:
        def at(k: Column) -> Column:
            t = k / a["n"]
            c, s = F.cos(a["sweep"] * t), F.sin(a["sweep"] * t)
            return F.struct((a["cx"] + a["vx"] * c - a["vy"] * s).alias("x"), (a["cy"] + a["vx"] * s + a["vy"] * c).alias("y"), (a["z"] + a["rise"] * t).alias("z"))

        return F.transform(F.sequence(F.lit(1), a["n"] - 1), at)

    # what holds for the whole arc is bound to a lambda's variable: an expression in `at` would be worked out again for every point
    arc = F.transform(F.array(F.struct(*[c.alias(name) for name, c in own.items()])), inner)[0]
    last = F.array(F.struct(end["x"].alias("x"), end["y"].alias("y"), end["z"].alias("z")))
    return F.when(straight, last).otherwise(F.concat(arc, last))
