"""Surfaces in plan: overlaps of triangles, contour chains, arrangements of cut lines, and rays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from . import lists
from .solids import BLOCK, CORNERS, clipped
from .spatial import cell


def _corner(how, axis: str, points: str = "abc") -> Column:
    return how(*[F.col(p + axis) for p in points])


def _box() -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """The plan box of a triangle: least and greatest x, and y."""
    return (_corner(F.least, "x"), _corner(F.greatest, "x")), (_corner(F.least, "y"), _corner(F.greatest, "y"))


def _dealt(df: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], size: float, prefix: str) -> DataFrame:
    """df once for each plan cell that its box reaches, as gx, gy, with the box's first cell as <prefix>x, <prefix>y."""
    first = [cell(lo, size) for lo, _ in (x, y)]
    last = [cell(hi, size) for _, hi in (x, y)]
    out = df.withColumns({f"{prefix}x": first[0], f"{prefix}y": first[1]})
    return out.withColumn("gx", F.explode(F.sequence(first[0], last[0]))).withColumn("gy", F.explode(F.sequence(first[1], last[1])))


# triangles over triangles


def triangle_overlaps(upper: DataFrame, lower: DataFrame, size: float, least: float = 1e-9) -> DataFrame:
    """(upper, lower, area, above, below, low, high) of each pair of triangles whose plans overlap by more than `least`.

    upper(face, ax..cz), lower likewise. above and below are the volumes between them where `upper` is the higher
    and the lower one; low and high the least and greatest height of `upper` over `lower`. Both sides are dealt to the
    plan cells of their boxes and meet by cell; a pair counts in the first cell that both reach, so once. Upright
    triangles have no plan. Overlaps are clipped by batch in numpy.
    """
    plan = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    side = lambda df, p: _dealt(df.select("face", *[F.col(c).cast("double").alias(c) for c in CORNERS]).where(plan != 0), *_box(), size, p)
    u, v = side(upper, "u"), side(lower, "v")
    v = v.withColumnsRenamed({c: f"o{c}" for c in ("face", *CORNERS)})
    j = u.join(v, ["gx", "gy"]).where((F.col("gx") == F.greatest("ux", "vx")) & (F.col("gy") == F.greatest("uy", "vy")))
    for axis in "xy":
        other = ("oa", "ob", "oc")
        lo = lambda ps: F.least(*[F.col(p + axis) for p in ps])  # noqa: E731, B023
        hi = lambda ps: F.greatest(*[F.col(p + axis) for p in ps])  # noqa: E731, B023
        j = j.where((lo("abc") < hi(other)) & (lo(other) < hi("abc")))
    kinds = [df.schema["face"].dataType.simpleString() for df in (upper, lower)]
    names = ["upper", "lower", "area", "above", "below", "low", "high"]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                get = lambda p: np.stack([b.column(p + c).to_numpy(zero_copy_only=False) for c in CORNERS], 1).reshape(-1, 3, 3)  # noqa: E731, B023
                figures = overlap(get(""), get("o"))
                keep = pa.array(figures[:, 0] > least)
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (b.column(0), b.column(1), *map(pa.array, figures.T.copy()))], names)

    picked = j.select("face", "oface", *CORNERS, *[f"o{c}" for c in CORNERS])
    return picked.mapInArrow(run, f"upper {kinds[0]}, lower {kinds[1]}, " + ", ".join(f"{n} double" for n in names[2:]))


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(area, above, below, low, high) of pairs of triangles (rows, 3, 3)."""
    origin = a[:, :1] * [1, 1, 0]
    a, b = a - origin, b - origin
    turn = np.cross(b[:, 1, :2] - b[:, 0, :2], b[:, 2, :2] - b[:, 0, :2])
    poly, n = a, np.full(len(a), 3)
    for k in range(3):
        p, q = b[:, k, :2], b[:, (k + 1) % 3, :2]
        e = (q - p) * np.sign(turn)[:, None]
        inside = e[:, None, 0] * (poly[:, :, 1] - p[:, None, 1]) - e[:, None, 1] * (poly[:, :, 0] - p[:, None, 0])
        poly, n = clipped(poly, n, inside)
    # heights over b's plane
    u, v = b[:, 1] - b[:, 0], b[:, 2] - b[:, 0]
    det = u[:, 0] * v[:, 1] - v[:, 0] * u[:, 1]
    d = poly - b[:, :1]
    s = (d[:, :, 0] * v[:, None, 1] - v[:, None, 0] * d[:, :, 1]) / det[:, None]
    t = (u[:, None, 0] * d[:, :, 1] - d[:, :, 0] * u[:, None, 1]) / det[:, None]
    gap = poly.copy()
    gap[:, :, 2] = d[:, :, 2] - s * u[:, None, 2] - t * v[:, None, 2]
    real = np.arange(gap.shape[1]) < n[:, None]
    area, _ = _moment(gap, n)
    up, n_up = clipped(gap, n, gap[:, :, 2])
    down, n_down = clipped(gap, n, -gap[:, :, 2])
    low = np.where(real, gap[:, :, 2], np.inf).min(1, initial=np.inf)
    high = np.where(real, gap[:, :, 2], -np.inf).max(1, initial=-np.inf)
    return np.stack([area, _moment(up, n_up)[1], -_moment(down, n_down)[1], low, high], 1)


def _moment(poly: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plan area of each polygon, and the integral of its third coordinate over it."""
    first = poly[:, :1]
    q, r = poly[:, 1:-1] - first, poly[:, 2:] - first
    area = np.where(np.arange(2, poly.shape[1]) < n[:, None], (q[..., 0] * r[..., 1] - r[..., 0] * q[..., 1]) / 2, 0.0)
    sign = np.sign(area.sum(1))
    return np.abs(area.sum(1)), (area * (first[..., 2] + (q[..., 2] + r[..., 2]) / 3)).sum(1) * sign


# contours


def chain_segments(segments: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(chain, level, place, x, y, closed): the points of the lines that segments(level, x1, y1, x2, y2) make, in order.

    Ends meet where they are equal after rounding to `tolerance`. Where more than two meet, they go on in pairs, in
    order of their other ends; an odd one ends there. An open chain starts at its lesser end, a ring at its least point
    and towards the lesser neighbour; a ring's first point isn't repeated. Segments without length are left out; of
    equal ones each counts. chain is a number that only tells chains apart.

    Which end follows which is a list of directed segments, ranked by pointer jumping: no chain meets in one task.
    """
    q = lambda c: F.round(F.col(c) / tolerance).cast("long")
    s = segments.select("level", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    s = s.withColumns({"p1": F.struct(q("x1").alias("x"), q("y1").alias("y")), "p2": F.struct(q("x2").alias("x"), q("y2").alias("y"))}).where("p1 != p2")
    s = staged(s.withColumn("seg", F.monotonically_increasing_id()), "chain-segments")
    end = lambda i, p, other: F.struct(F.lit(i).alias("i"), F.col(p).alias("at"), F.col(other).alias("other"))
    ends = s.select("seg", "level", F.explode(F.array(end(0, "p1", "p2"), end(1, "p2", "p1"))).alias("e")).select("seg", "level", "e.*")
    nth = F.row_number().over(Window.partitionBy("level", "at").orderBy("other", "seg", "i")) - 1
    paired = ends.withColumn("nth", nth).withColumn("pair", F.floor(F.col("nth") / 2))
    mate = paired.select(F.col("level").alias("l"), F.col("at").alias("a"), F.col("pair").alias("p"), F.col("nth").alias("n"), F.col("seg").alias("mate"), F.col("i").alias("mi"))
    met = paired.join(mate, (F.col("level") == F.col("l")) & (F.col("at") == F.col("a")) & (F.col("pair") == F.col("p")) & (F.col("nth") != F.col("n")), "left")
    # element 2 * seg + i starts at end i; the one before it leaves by its mate's end, so it starts at that one's other end
    links = met.select((F.col("seg") * 2 + F.col("i")).alias("elem"), (F.col("mate") * 2 + 1 - F.col("mi")).alias("prev"), "at", "other")
    links = staged(links.select("elem", "prev", F.struct("at", "other", "elem").alias("key")), "chain-links")
    placed = staged(lists.ranked(links), "chain-places").withColumn("seg", F.shiftright("elem", 1))
    # every line is there in both directions: the one whose head has the least key stays; only heads need their keys
    heads = placed.where("rank = 0").select(F.col("head").alias("__head")).join(links.select("elem", F.col("key").alias("head_key")), F.col("__head") == F.col("elem")).drop("elem")
    both = placed.groupBy("head").agg(F.min("seg").alias("chain"), F.max("rank").alias("last")).join(heads, F.col("head") == F.col("__head"))
    best = both.groupBy("chain").agg(F.min(F.struct("head_key", "head", "last")).alias("b")).select("chain", F.col("b.head").alias("__of"), F.col("b.last").alias("last"))
    mine = placed.join(best, F.col("head") == F.col("__of")).join(s.select(F.col("seg").alias("__seg"), "level", "x1", "y1", "x2", "y2"), F.col("seg") == F.col("__seg"))
    forward = F.col("elem") % 2 == 0
    start = F.struct(F.col("rank").alias("place"), F.when(forward, F.col("x1")).otherwise(F.col("x2")).alias("x"), F.when(forward, F.col("y1")).otherwise(F.col("y2")).alias("y"))
    finish = F.struct((F.col("rank") + 1).alias("place"), F.when(forward, F.col("x2")).otherwise(F.col("x1")).alias("x"), F.when(forward, F.col("y2")).otherwise(F.col("y1")).alias("y"))
    points = F.when(~F.col("closed") & (F.col("rank") == F.col("last")), F.array(start, finish)).otherwise(F.array(start))
    return mine.select("chain", "level", "closed", F.explode(points).alias("p")).select("chain", "level", "p.place", "p.x", "p.y", "closed")


# arrangements


def _crossings(segments: DataFrame, size: float, tolerance: float) -> DataFrame:
    """(seg, t): where each of segments(seg, x1, y1, x2, y2) is met by another, as a share of its length."""
    box = lambda a, b: (F.least(a, b), F.greatest(a, b))
    d = _dealt(segments, box("x1", "x2"), box("y1", "y2"), size, "u")
    o = _dealt(segments, box("x1", "x2"), box("y1", "y2"), size, "v").withColumnsRenamed({c: f"o{c}" for c in ("seg", "x1", "y1", "x2", "y2")})
    j = d.join(o, ["gx", "gy"]).where((F.col("seg") != F.col("oseg")) & (F.col("gx") == F.greatest("ux", "vx")) & (F.col("gy") == F.greatest("uy", "vy")))
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    wx, wy = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    det, length, other = dx * ey - dy * ex, F.hypot(dx, dy), F.hypot(ex, ey)
    apart = F.abs(det) > 1e-12 * length * other
    t, u = (wx * ey - wy * ex) / F.when(apart, det), (wx * dy - wy * dx) / F.when(apart, det)
    within = lambda x, n: (x >= -tolerance / n) & (x <= 1 + tolerance / n)
    cross = F.when(apart & within(t, length) & within(u, other), F.array(t))
    # on one line: the ends of the other that lie on this one
    near = F.abs(wx * dy - wy * dx) <= tolerance * length
    along = lambda x, y: ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / (length * length)
    ends = F.when(~apart & near, F.array(along(F.col("ox1"), F.col("oy1")), along(F.col("ox2"), F.col("oy2"))))
    hits = j.select("seg", F.explode(F.coalesce(cross, ends, F.array().cast("array<double>"))).alias("t"))
    return hits.where("t >= 0 AND t <= 1")


def arrangement(segments: DataFrame, size: float, tolerance: float = 1e-6) -> DataFrame:
    """(face, place, x, y, area) of the faces that segments(x1, y1, x2, y2) cut the plane into: corners in order, anticlockwise, and each face's area.

    Segments are cut where others cross or touch them, ends within `tolerance` are one, and equal pieces count once.
    A face's edges are a cycle: at each corner it goes on with the next edge clockwise. Outlines seen from outside
    run clockwise, have an area under 0 and are left out, as are trees of edges that enclose nothing; so a piece of
    ground with a separate outline inside keeps its whole area. face is a number that only tells faces apart.

    Segments meet by plan cell; edges around a corner are put in order by angle; cycles are labelled by pointer jumping.
    """
    s = segments.select(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).where("x1 != x2 OR y1 != y2")
    s = staged(s.withColumn("seg", F.monotonically_increasing_id()), "cut-lines")
    ends = s.select("seg", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    cuts = ends.unionByName(_crossings(s, size, tolerance)).join(s.withColumnRenamed("seg", "__s"), F.col("seg") == F.col("__s"))
    q = lambda a, b: F.round((F.col(a) + (F.col(b) - F.col(a)) * F.col("t")) / tolerance).cast("long")
    cuts = cuts.select("seg", "t", F.struct(q("x1", "x2").alias("x"), q("y1", "y2").alias("y")).alias("at")).groupBy("seg", "at").agg(F.min("t").alias("t"))
    after = F.lead("at").over(Window.partitionBy("seg").orderBy("t", "at"))
    pieces = cuts.select("at", after.alias("to")).where("to IS NOT NULL")
    edges = pieces.select(F.least("at", "to").alias("u"), F.greatest("at", "to").alias("v")).distinct()
    edges = staged(edges.withColumn("edge", F.monotonically_increasing_id()), "arrangement-edges")
    half = lambda i, a, b: F.struct((F.col("edge") * 2 + i).alias("elem"), F.col(a).alias("from"), F.col(b).alias("to"))
    halves = edges.select(F.explode(F.array(half(0, "u", "v"), half(1, "v", "u"))).alias("h")).select("h.*")
    angle = F.atan2(F.col("to.y") - F.col("from.y"), F.col("to.x") - F.col("from.x"))
    around = Window.partitionBy("from").orderBy("angle", "elem")
    turned = halves.withColumn("angle", angle)
    # arriving at a corner by the twin of h, the face goes on with the edge before h in angle; so h's predecessor is the twin of the edge after h
    following = F.coalesce(F.lead("elem").over(around), F.first("elem").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    links = turned.select("elem", "from", following.alias("__next"))
    links = links.withColumn("prev", F.col("__next").bitwiseXOR(F.lit(1))).withColumn("key", F.struct("from", "elem"))
    links = staged(links.select("elem", "prev", "from", "key"), "arrangement-links")
    placed = staged(lists.ranked(links).join(links.select("elem", "from"), "elem").join(halves.select(F.col("elem").alias("__e"), "to"), F.col("elem") == F.col("__e")), "arrangement-faces")
    cross = (F.col("from.x") * F.lit(tolerance)) * (F.col("to.y") * F.lit(tolerance)) - (F.col("to.x") * F.lit(tolerance)) * (F.col("from.y") * F.lit(tolerance))
    areas = placed.groupBy("head").agg((F.sum(cross) / 2).alias("area")).where(F.col("area") > tolerance * tolerance)
    return placed.join(areas, "head").select(F.col("head").alias("face"), F.col("rank").alias("place"), (F.col("from.x") * F.lit(tolerance)).alias("x"), (F.col("from.y") * F.lit(tolerance)).alias("y"), "area")


# rays


def ray_hits(rays: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """(ray, face, t, x, y, z): the first triangle that each of rays(ray, ox, oy, oz, dx, dy, dz) meets, at o + t d with t from 0 to 1.

    triangles(face, ax..cz); ties go to the lesser face. A ray visits the plan cells under it, column by column, and
    meets there the triangles whose boxes reach the cell and its own box, by batch in numpy; the first hit is a minimum over all cells, so it is exact. A ray
    along a triangle's plane doesn't hit it; one without direction, or with a missing number, hits nothing.
    """
    finite = F.lit(True)
    for c in ("ox", "oy", "oz", "dx", "dy", "dz"):
        finite = finite & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    r = rays.where(finite & ((F.col("dx") != 0) | (F.col("dy") != 0) | (F.col("dz") != 0)))
    x = (F.least(F.col("ox"), F.col("ox") + F.col("dx")), F.greatest(F.col("ox"), F.col("ox") + F.col("dx")))
    r = r.withColumn("gx", F.explode(F.sequence(cell(x[0], size), cell(x[1], size))))
    # the part of the ray over a column of cells, a little widened
    share = lambda edge: F.when(F.col("dx") != 0, (edge - F.col("ox")) / F.when(F.col("dx") != 0, F.col("dx")))
    a, b = share(F.col("gx") * F.lit(size)), share((F.col("gx") + 1) * F.lit(size))
    t0 = F.coalesce(F.greatest(F.lit(0.0), F.least(a, b) - 1e-9), F.lit(0.0))
    t1 = F.coalesce(F.least(F.lit(1.0), F.greatest(a, b) + 1e-9), F.lit(1.0))
    y0, y1 = F.col("oy") + F.col("dy") * t0, F.col("oy") + F.col("dy") * t1
    r = r.withColumn("gy", F.explode(F.sequence(cell(F.least(y0, y1), size), cell(F.greatest(y0, y1), size))))
    t = _dealt(triangles.select("face", *[F.col(c).cast("double").alias(c) for c in CORNERS]), *_box(), size, "v")
    j = r.join(t, ["gx", "gy"])
    for axis in "xyz":  # boxes that are apart, by more than rounding, before any triangle is worked out
        lo, hi, slack = _corner(F.least, axis), _corner(F.greatest, axis), F.lit(1e-9) * (1 + F.abs(F.col(f"o{axis}")) + F.abs(F.col(f"d{axis}")))
        ends = [F.col(f"o{axis}"), F.col(f"o{axis}") + F.col(f"d{axis}")]
        wide = slack + F.lit(1e-9) * (hi - lo)
        j = j.where((F.least(*ends) <= hi + wide) & (lo - wide <= F.greatest(*ends)))
    numbers = [p + c for p in "od" for c in "xyz"] + CORNERS
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((rays, "ray"), (triangles, "face"))]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                t, hit = met([b.column(c).to_numpy(zero_copy_only=False) for c in numbers])
                keep = pa.array(hit)
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (b.column(0), b.column(1), pa.array(t), *(b.column(p + c) for p in "od" for c in "xyz"))], ["ray", "face", "t", *numbers[:6]])

    found = j.select("ray", "face", *[F.col(c).cast("double").alias(c) for c in numbers]).mapInArrow(run, f"ray {kinds[0]}, face {kinds[1]}, t double, " + ", ".join(f"{c} double" for c in numbers[:6]))
    where = [(F.col(f"o{c}") + F.col("t") * F.col(f"d{c}")).alias(c) for c in "xyz"]
    return found.groupBy("ray").agg(F.min(F.struct("t", "face", *where)).alias("h")).select("ray", "h.face", "h.t", "h.x", "h.y", "h.z")


def met(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where along rays the planes of their triangles are met, and whether within both; columns are o, d, a, b, c by x, y, z."""
    o, d, a, b, c = (columns[k : k + 3] for k in range(0, 15, 3))
    less = lambda m, n: [x - y for x, y in zip(m, n, strict=True)]
    cross = lambda m, n: [m[1] * n[2] - m[2] * n[1], m[2] * n[0] - m[0] * n[2], m[0] * n[1] - m[1] * n[0]]
    dot = lambda m, n: m[0] * n[0] + m[1] * n[1] + m[2] * n[2]
    e1, e2, s = less(b, a), less(c, a), less(o, a)
    normal, m = cross(e1, e2), cross(s, d)
    det = -dot(d, normal)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        t, u, v = dot(s, normal) / det, dot(e2, m) / det, -dot(e1, m) / det
        return t, (det != 0) & (t >= 0) & (t <= 1) & (u >= -1e-12) & (v >= -1e-12) & (u + v <= 1 + 1e-12)
