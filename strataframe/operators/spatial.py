"""Grids, neighbours, kriging and surfaces, by bucketed equi-joins."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import spherical_covariance  # noqa: F401
from ..session import staged


def cell(x: Column, size: float, origin: Column | float = 0.0) -> Column:
    o = F.lit(origin) if isinstance(origin, (int, float)) else origin
    return F.floor((x - o) / size).cast("long")


def cell_means(points: DataFrame, size: float, value: str = "z", digits: int = 9) -> DataFrame:
    """(cx, cy, n, mean): sums are in fixed point, so that their order doesn't matter."""
    v = F.round(F.col(value) * 10**digits).cast("decimal(38,0)")
    g = points.groupBy(cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"))
    return g.select("cx", "cy", "n", (F.col("s").cast("double") / 10**digits / F.col("n")).alias("mean"))


def _neighbours(df: DataFrame, names: list[str], reach: int = 1) -> DataFrame:
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"d{i}") for i, o in enumerate(off)]) for off in itertools.product(range(-reach, reach + 1), repeat=len(names))])
    d = df.withColumn("__o", F.explode(offsets))
    return d.withColumns({n: F.col(n) + F.col(f"__o.d{i}") for i, n in enumerate(names)}).drop("__o")


def neighbour_counts(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, neighbours): other points in the own and the 26 neighbouring voxels; the grid starts at the data's minimum.

    Voxels are counted first, and counts are sent to neighbours: at most 27 rows a voxel, however many points it has.
    """
    low = points.agg(*[F.min(c).alias(f"__{c}") for c in "xyz"])
    p = points.crossJoin(F.broadcast(low)).withColumns({f"c{c}": cell(F.col(c), radius, F.col(f"__{c}")) for c in "xyz"})
    names = ["cx", "cy", "cz"]
    counts = p.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    around = _neighbours(counts, names).groupBy(*names).agg(F.sum("n").alias("around"))
    return p.join(around, names).select(key, (F.col("around") - 1).alias("neighbours"))


def plan_spacing(points: DataFrame, size: float) -> DataFrame:
    """One row: sqrt(occupied cells * cell area / points)."""
    g = points.groupBy(cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sqrt(F.count(F.lit(1)) * size * size / F.sum("n")).alias("spacing"))


#: How often the cells of `nearest` are halved at most.
HALVINGS = 24


def nearest(targets: DataFrame, samples: DataFrame, radius: float, k: int, dims: str = "xyz") -> DataFrame:
    """(target, sample, d2, place): the k nearest samples within radius, ties by sample id; bins meet by an equi-join.

    Bins are cells of the radius, halved up to HALVINGS times. A target's are the smallest whose own cell has k samples:
    the k nearest are then no further than the k-th of these, so it asks the cells within that reach, which are two
    away at most; if no cell has k, it asks those within the radius. So a target meets samples by their number and not by
    their density, and what is found is exact. Of samples of one place only the k of least id can be among the nearest.
    """
    names = [f"c{c}" for c in dims]
    scale = lambda level: F.lit(float(radius)) / F.pow(F.lit(2.0), level)
    cells = lambda df, points, level: df.withColumns({n: F.floor(F.col(p) / scale(level)).cast("long") for n, p in zip(names, points, strict=True)})
    s = samples.withColumnsRenamed({c: f"s{c}" for c in dims})
    # -0.0 and 0.0 are one place
    s = s.withColumn("__same", F.row_number().over(Window.partitionBy(*[F.col(f"s{c}") + 0.0 for c in dims]).orderBy("sample"))).where(F.col("__same") <= k).drop("__same")
    s = staged(s, "nearest-samples")
    every = F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("level")
    full = cells(s.select(*[f"s{c}" for c in dims], every), [f"s{c}" for c in dims], F.col("level")).groupBy("level", *names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    asked = cells(targets.select("target", *dims, every), dims, F.col("level")).join(full, ["level", *names], "left_semi")
    finest = asked.groupBy(F.col("target").alias("__target"), *[F.col(c).alias(f"__{c}") for c in dims]).agg(F.max("level").alias("level"))
    same = F.col("target").eqNullSafe(F.col("__target"))
    for c in dims:
        same = same & (F.col(c) == F.col(f"__{c}"))
    once = lambda df, found: df.join(found, same, "left").drop("__target", *[f"__{c}" for c in dims])
    t = staged(once(targets, finest).withColumn("level", F.coalesce("level", F.lit(0))), "nearest-targets")
    used = t.agg(F.collect_set("level").alias("levels"))
    s = cells(s.crossJoin(F.broadcast(used)).withColumn("level", F.explode("levels")).drop("levels"), [f"s{c}" for c in dims], F.col("level"))
    d2 = F.lit(0.0)
    for c in dims:
        d2 = d2 + (F.col(c) - F.col(f"s{c}")) * (F.col(c) - F.col(f"s{c}"))
    # by number, so that few bytes of packed rows aren't put together into few tasks
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meet = lambda df: df.repartition(tasks, "level", *names).join(s.repartition(tasks, "level", *names), ["level", *names]).withColumn("d2", d2)
    # the k-th of the own cell
    w = Window.partitionBy("target", *dims).orderBy("d2")
    far = meet(cells(t, dims, F.col("level"))).withColumn("__n", F.row_number().over(w)).where(F.col("__n") == k)
    t = once(t, far.select(F.col("target").alias("__target"), *[F.col(c).alias(f"__{c}") for c in dims], F.col("d2").alias("far")))
    # a square that is too small for a double is nought
    t = t.withColumn("far", F.least(F.lit(radius * radius), "far")).withColumn("reach", F.sqrt("far") * (1 + 1e-9) + 1e-150)
    # of the cells around, those that the reach gets to
    near = t
    for c, n in zip(dims, names, strict=True):
        low, high = (F.floor((F.col(c) + side * F.col("reach")) / scale(F.col("level"))) for side in (-1, 1))
        near = near.withColumn(n, F.explode(F.sequence(low, high)))
    away = F.lit(0.0)
    for c, n in zip(dims, names, strict=True):
        low = F.col(n) * scale(F.col("level"))
        gap = F.greatest(F.lit(0.0), low - F.col(c), F.col(c) - low - scale(F.col("level")))
        away = away + gap * gap
    near = near.where(away <= F.col("reach") * F.col("reach") * (1 + 1e-9) + 1e-12 * radius * radius)
    hit = meet(near).where("d2 <= far")
    w = Window.partitionBy("target").orderBy("d2", "sample")
    return hit.drop("level", "reach", "far").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("place", F.col("place").cast("long"))


def covariance(h: np.ndarray, sill: float, nugget: float, reach: float) -> np.ndarray:
    r = h / reach
    return np.where(h <= 0, sill, np.where(h >= reach, 0.0, (sill - nugget) * (1 - 1.5 * r + 0.5 * r**3)))


def krige(targets: DataFrame, samples: DataFrame, radius: float, k: int, least: int, sill: float, nugget: float, reach: float) -> DataFrame:
    """(target, n, estimate): ordinary kriging from the nearest samples; null with fewer than `least` or a singular system.

    Neighbours are found relationally; one small dense system a target is solved in Arrow batches.
    """
    found = nearest(targets, samples, radius, k).select("target", F.struct("sx", "sy", "sz", "v", F.col("d2")).alias("s"))
    lists = found.groupBy("target").agg(F.collect_list("s").alias("s"))

    def solve(batches):
        import pyarrow as pa

        for b in batches:
            n, est = [], []
            for s in b.column(1).to_pylist():
                n.append(len(s))
                e = None
                if len(s) >= least:
                    p = np.array(sorted((x["d2"], x["sx"], x["sy"], x["sz"], x["v"]) for x in s))
                    m = len(p)
                    h = np.linalg.norm(p[:, None, 1:4] - p[None, :, 1:4], axis=2)
                    a = np.ones((m + 1, m + 1))
                    a[:m, :m] = covariance(h, sill, nugget, reach) + np.eye(m) * 1e-10
                    a[m, m] = 0
                    try:
                        w = np.linalg.solve(a, np.r_[covariance(np.sqrt(p[:, 0]), sill, nugget, reach), 1.0])[:m]
                        e = float(w @ p[:, 4]) if np.isfinite(w).all() else None
                    except np.linalg.LinAlgError:
                        e = None
                est.append(e)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(est, pa.float64())], ["target", "n", "estimate"])

    return lists.mapInArrow(solve, "target long, n long, estimate double")


def open_faces(cells: DataFrame, names: list[str]) -> DataFrame:
    """(cell, open): faces of a cell that no other cell touches."""
    n = len(names)
    steps = [tuple((s if i == j else 0) for j in range(n)) for i in range(n) for s in (-1, 1)]
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"d{i}") for i, o in enumerate(off)]) for off in steps])
    asked = cells.select(*names, F.explode(offsets).alias("o")).select(*names, *[(F.col(c) + F.col(f"o.d{i}")).alias(f"n_{c}") for i, c in enumerate(names)])
    there = cells.select(*[F.col(c).alias(f"n_{c}") for c in names]).distinct().withColumn("hit", F.lit(1))
    return asked.join(there, [f"n_{c}" for c in names], "left").groupBy(*names).agg((F.lit(2 * n) - F.count("hit")).alias("open"))


def bands(low: float, high: float, height: float) -> list[tuple[float, float]]:
    """Bench floors and tops upwards, the last one cut short."""
    out, at = [], low
    while at < high - 1e-9:
        out.append((at, min(at + height, high)))
        at += height
    return out


def bands_between(low: Column, high: Column, height: Column) -> Column:
    """The same of columns: an array of struct base, top; none without a height over 0 or room for a bench."""
    n = F.ceil((high - low) / F.when(height > 0, height) - 1e-9).cast("int")
    at = lambda i: low + i * height
    one = lambda i: F.struct(at(i).alias("base"), F.least(at(i + 1), high).alias("top"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<struct<base:double,top:double>>"))


def levels_between(lo: Column, hi: Column, steps: list[float]) -> Column:
    """An array of the levels of any of the steps within [lo, hi], ascending, each once."""
    def of(step: float) -> Column:
        first, last = F.ceil(lo / step - 1e-9).cast("int"), F.floor(hi / step + 1e-9).cast("int")
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: F.round(k * step, 9))).otherwise(F.array().cast("array<double>"))

    return F.array_sort(F.array_distinct(F.concat(*[of(s) for s in steps])))


def contour_levels(lo: float, hi: float, minor: float, major: float) -> list[float]:
    """Levels of either interval within [lo, hi], once each."""
    out = set()
    for step in (minor, major):
        k = int(np.ceil(lo / step - 1e-9))
        while k * step <= hi + 1e-9:
            out.add(round(k * step, 9))
            k += 1
    return sorted(out)


def contour_segments(triangles: DataFrame, levels: list[float]) -> DataFrame:
    """(face, level, x1, y1, x2, y2) of triangles(face, a, b, c) of struct<x,y,z>; crossings are half-open.

    The levels within a triangle's z range follow from its bounds, so a triangle meets no other level.
    """
    lv = F.filter(F.array(*map(F.lit, levels)), lambda v: (v >= F.least("a.z", "b.z", "c.z")) & (v < F.greatest("a.z", "b.z", "c.z")))
    t = triangles.withColumn("level", F.explode(lv))

    def cut(p: str, q: str) -> Column:
        zp, zq = F.col(f"{p}.z"), F.col(f"{q}.z")
        hit = ((zp <= F.col("level")) & (F.col("level") < zq)) | ((zq <= F.col("level")) & (F.col("level") < zp))
        r = (F.col("level") - zp) / F.when(zq != zp, zq - zp)
        return F.when(hit, F.struct((F.col(f"{p}.x") + (F.col(f"{q}.x") - F.col(f"{p}.x")) * r).alias("x"), (F.col(f"{p}.y") + (F.col(f"{q}.y") - F.col(f"{p}.y")) * r).alias("y")))

    ends = F.filter(F.array(cut("a", "b"), cut("b", "c"), cut("c", "a")), lambda e: e.isNotNull())
    t = t.withColumn("e", ends).where(F.size("e") == 2)
    return t.select("face", "level", F.col("e")[0]["x"].alias("x1"), F.col("e")[0]["y"].alias("y1"), F.col("e")[1]["x"].alias("x2"), F.col("e")[1]["y"].alias("y2"))


def column_heights(points: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """(point, z): the highest surface over each point; triangles are dealt to the plan cells of their box.

    Each place of points is looked up once, and points get the heights of their places by an equi-join, so that points
    are neither sorted by cell nor held with triangles. Points are dealt by id to all tasks of a shuffle, however well they pack.
    """
    a, b, c = (lambda v: F.col(f"a.{v}")), (lambda v: F.col(f"b.{v}")), (lambda v: F.col(f"c.{v}"))
    span = lambda v: F.sequence(cell(F.least(a(v), b(v), c(v)), size), cell(F.greatest(a(v), b(v), c(v)), size))
    t = triangles.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    points = points.select("point", "x", "y")
    places = points.select("x", "y").distinct().withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
    # by number, so that few bytes of packed rows aren't put together into few tasks
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = places.repartition(tasks, "cx", "cy").join(t.repartition(tasks, "cx", "cy"), ["cx", "cy"])
    det = (b("y") - c("y")) * (a("x") - c("x")) + (c("x") - b("x")) * (a("y") - c("y"))
    u = ((b("y") - c("y")) * (F.col("x") - c("x")) + (c("x") - b("x")) * (F.col("y") - c("y"))) / F.when(det != 0, det)
    v = ((c("y") - a("y")) * (F.col("x") - c("x")) + (a("x") - c("x")) * (F.col("y") - c("y"))) / F.when(det != 0, det)
    inside = (u >= -1e-12) & (v >= -1e-12) & (u + v <= 1 + 1e-12)
    heights = j.where(inside).groupBy("x", "y").agg(F.max(u * a("z") + v * b("z") + (1 - u - v) * c("z")).alias("z"))
    return points.join(heights, ["x", "y"]).select("point", "z").repartition(tasks, "point").groupBy("point").agg(F.max("z").alias("z"))


def points_in_rings(points: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """(point, ring) where a point lies in ring(ring, verts array<struct<x,y>>); rings are dealt to the cells of their box."""
    from ..functions.geometry import in_ring

    span = lambda v: F.sequence(cell(F.array_min(F.col(f"verts.{v}")), size), cell(F.array_max(F.col(f"verts.{v}")), size))
    r = rings.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    p = points.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
    return p.join(r, ["cx", "cy"]).where(in_ring(F.col("verts"), F.col("x"), F.col("y"))).select("point", "ring")


def points_in_faces(points: DataFrame, faces: DataFrame, size: float) -> DataFrame:
    """(point, face) where a point lies in face(face, rings array<array<struct<x,y>>>): in an odd number of its rings, so rings inside others are holes.

    Faces are dealt to the plan cells of the box of all their rings, and tested against the places of points in that
    box, each place once: points of one place are in the same faces, and get them by an equi-join.
    """
    from ..functions.geometry import in_ring

    every = F.flatten("rings")
    box = {f"{end}{v}": how(F.transform(every, lambda p: p[v])) for v in "xy" for end, how in (("lo", F.array_min), ("hi", F.array_max))}  # noqa: B023
    f = faces.select("face", "rings").withColumns(box)
    f = f.withColumn("cx", F.explode(F.sequence(cell(F.col("lox"), size), cell(F.col("hix"), size)))).withColumn("cy", F.explode(F.sequence(cell(F.col("loy"), size), cell(F.col("hiy"), size))))
    p = points.select("point", "x", "y")
    places = p.select("x", "y").distinct().withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
    odd = F.aggregate("rings", F.lit(False), lambda a, ring: a != in_ring(ring, F.col("x"), F.col("y")))
    near = places.join(f, ["cx", "cy"]).where("x BETWEEN lox AND hix AND y BETWEEN loy AND hiy")
    return p.join(near.where(odd).select("x", "y", "face"), ["x", "y"]).select("point", "face")


def position_means(points: DataFrame) -> DataFrame:
    """(x, y, n, z): finite points of exactly equal place as one, with the mean of their heights; -0.0 is 0.0."""
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    return points.where(finite).groupBy((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("z"))
