"""The share of a block inside closed meshes, by signed column integrals; and the reserves that follow from it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A fraction further than this outside 0 to 1 is a fault of the mesh.
OUTSIDE = 1e-7
#: Pairs whose polygons are clipped together.
BLOCK = 8192

CORNERS = [p + c for p in "abc" for c in "xyz"]


def clipped(poly: np.ndarray, n: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of many convex polygons where a linear value is 0 or more.

    poly is (rows, corners, 3), of which row i has the first n[i]; value (rows, corners) belongs to the corners.
    """
    rows, most = value.shape
    here = np.arange(most)
    real = here < n[:, None]
    after = np.where(here + 1 < n[:, None], here + 1, 0)
    q, b = np.take_along_axis(poly, after[:, :, None], 1), np.take_along_axis(value, after, 1)
    crosses = real & (((value > 0) & (b < 0)) | ((value < 0) & (b > 0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(crosses, value / (value - b), 0.0)
    both = np.stack([poly, poly + (q - poly) * t[:, :, None]], 2).reshape(rows, 2 * most, 3)
    kept = np.stack([real & (value >= 0), crosses], 2).reshape(rows, 2 * most)
    n = kept.sum(1)
    turn = np.argsort(~kept, 1, kind="stable")[:, : max(1, n.max(initial=0))]
    return np.take_along_axis(both, turn[:, :, None], 1), n


def columns_over(poly: np.ndarray, n: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The signed integral over each plan polygon of its height above `base`: exact, as height is linear on it."""
    first = poly[:, :1]
    q, r = poly[:, 1:-1] - first, poly[:, 2:] - first
    area = (q[..., 0] * r[..., 1] - r[..., 0] * q[..., 1]) / 2
    area = np.where(np.arange(2, poly.shape[1]) < n[:, None], area, 0.0)
    height = first[..., 2] + (q[..., 2] + r[..., 2]) / 3 - base[:, None]
    return (area * height).sum(1)


def column_volumes(lo: np.ndarray, hi: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """The signed volume of each box lo..hi (rows, 3) under its triangle (rows, 3, 3): positive where it faces up.

    Over a closed mesh with outward faces these sum to the volume of the box inside it, without sampling.
    """
    poly, n = triangles, np.full(len(triangles), 3)
    for axis in (0, 1):
        poly, n = clipped(poly, n, poly[:, :, axis] - lo[:, None, axis])
        poly, n = clipped(poly, n, hi[:, None, axis] - poly[:, :, axis])
    above, many = clipped(poly, n, poly[:, :, 2] - hi[:, None, 2])
    above = above.copy()
    above[:, :, 2] = hi[:, None, 2]
    # a face that lies level with the top is above, and not between as well
    level = (np.where(np.arange(poly.shape[1]) < n[:, None], poly[:, :, 2], np.inf) >= hi[:, None, 2]).all(1)
    between, some = clipped(poly, np.where(level, 0, n), hi[:, None, 2] - poly[:, :, 2])
    between, some = clipped(between, some, between[:, :, 2] - lo[:, None, 2])
    return columns_over(above, many, lo[:, 2]) + columns_over(between, some, lo[:, 2])


def rotated(df: DataFrame, points: Sequence[str], rotation: Sequence[Sequence[float]], origin: Sequence[float]) -> DataFrame:
    """df with the points (prefixes of x, y, z columns) in the frame of a model: rotation (rows: the model's axes) about origin."""
    for p in points:
        away = [F.col(p + c) - F.lit(float(o)) for c, o in zip("xyz", origin, strict=True)]
        df = df.withColumns({p + c: sum((away[k] * F.lit(float(axis[k])) for k in range(3)), F.lit(0.0)) for c, axis in zip("xyz", rotation, strict=True)})
    return df


def mesh_problems(faces: DataFrame) -> DataFrame:
    """(piece, problem) of pieces that aren't closed (`open`: an edge isn't run once each way) or face inward (`inward`).

    Edges meet by their end points, pre-aggregated, so no task holds a mesh.
    """
    point = lambda p: F.struct(*[(F.col(p + c) + F.lit(0.0)).alias(c) for c in "xyz"])
    edge = lambda p, q: F.struct(F.least(point(p), point(q)).alias("u"), F.greatest(point(p), point(q)).alias("v"), F.when(point(p) < point(q), 1).otherwise(-1).alias("way"))
    edges = faces.select("piece", F.explode(F.array(edge("a", "b"), edge("b", "c"), edge("c", "a"))).alias("e")).where("e.u != e.v")
    loose = edges.groupBy("piece", "e.u", "e.v").agg(F.sum("e.way").alias("way")).where("way != 0").select("piece", F.lit("open").alias("problem")).distinct()
    cross = [F.col(f"b{i}") * F.col(f"c{j}") - F.col(f"b{j}") * F.col(f"c{i}") for i, j in ("yz", "zx", "xy")]
    volume = F.col("ax") * cross[0] + F.col("ay") * cross[1] + F.col("az") * cross[2]
    inward = faces.groupBy("piece").agg(F.sum(volume).alias("v")).where("v < 0").join(loose, "piece", "left_anti")
    return loose.unionByName(inward.select("piece", F.lit("inward").alias("problem")))


def piece_fractions(blocks: DataFrame, faces: DataFrame, cell: float, least: float = 1e-9, rotation: Sequence[Sequence[float]] | None = None, origin: Sequence[float] = (0.0, 0.0, 0.0), check: bool = True) -> DataFrame:
    """(block, piece, fraction): the share of each block's volume inside each closed piece, where there is any.

    blocks(block, x0, y0, z0, x1, y1, z1) in the frame of their model, which may be turned any way by `rotation`
    about `origin`; faces(piece, ax, ay, az, bx, by, bz, cx, cy, cz), outward, in the world. Both sides are dealt
    into cubic cells of the model's frame and meet by cell; a pair counts in the first cell that both reach. Faces
    that stand upright there or lie wholly below a block add nothing, nor do those of a piece wholly above it, whose
    columns cancel: a face reaches from the least height of its piece to its own greatest. Only pairs whose plans overlap reach the integral, by batch
    in numpy; their signed volumes are summed, pre-aggregated. Blocks without volume have no fraction.

    A piece that is open or faces inward is an error (with `check`; see mesh_problems), and so is a fraction
    further than 1e-7 outside 0 to 1, as of a mesh that runs through itself.
    """
    if check:
        found = mesh_problems(faces).limit(5).collect()
        if found:
            raise ValueError("check mesh orientation and closure of " + ", ".join(f"{r['piece']} ({r['problem']})" for r in found))

    def dealt(df: DataFrame, lo: list[str], hi: list[str], prefix: str) -> DataFrame:
        for axis, a, b in zip("xyz", lo, hi, strict=True):
            first, last = (F.floor(F.col(c) / cell).cast("long") for c in (a, b))
            df = df.withColumn(f"{prefix}{axis}", first).withColumn(f"c{axis}_", F.explode(F.sequence(first, last)))
        return df

    corner = lambda f, c: f(*[F.col(f"{p}{c}") for p in "abc"])
    f = faces.select("piece", *[F.col(c).cast("double").alias(c) for c in CORNERS])
    if rotation is not None:
        f = rotated(f, "abc", rotation, origin)
    plan = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    # the least height of a piece, pre-aggregated, so that no task holds a mesh
    low = f.groupBy(F.col("piece").alias("__piece")).agg(F.min(corner(F.least, "z")).alias("pz0"))
    f = f.where(plan != 0).join(low, F.col("piece").eqNullSafe(F.col("__piece"))).drop("__piece")
    f = f.select("*", corner(F.least, "x").alias("fx0"), corner(F.greatest, "x").alias("fx1"), corner(F.least, "y").alias("fy0"), corner(F.greatest, "y").alias("fy1"), corner(F.greatest, "z").alias("fz1"))
    boxes = blocks.where("x1 > x0 AND y1 > y0 AND z1 > z0")
    j = dealt(boxes, ["x0", "y0", "z0"], ["x1", "y1", "z1"], "u").join(dealt(f, ["fx0", "fy0", "pz0"], ["fx1", "fy1", "fz1"], "v"), ["cx_", "cy_", "cz_"])
    j = j.where("cx_ = greatest(ux, vx) AND cy_ = greatest(uy, vy) AND cz_ = greatest(uz, vz) AND fx0 < x1 AND x0 < fx1 AND fy0 < y1 AND y0 < fy1 AND fz1 > z0 AND pz0 < z1")
    numbers = ["x0", "y0", "z0", "x1", "y1", "z1", *CORNERS]
    types = [blocks.schema["block"].dataType.simpleString(), faces.schema["piece"].dataType.simpleString()]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in numbers], 1)
                # near the block's own corner, so that coordinates far from 0 don't cancel
                lo, size, tri = rows[:, :3], rows[:, 3:6] - rows[:, :3], rows[:, 6:].reshape(-1, 3, 3) - rows[:, None, :3]
                part = column_volumes(np.zeros_like(lo), size, tri) / size.prod(1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(part)], ["block", "piece", "part"])

    parts = j.select("block", "piece", *[F.col(c).cast("double").alias(c) for c in numbers]).mapInArrow(run, f"block {types[0]}, piece {types[1]}, part double")
    total = parts.groupBy("block", "piece").agg(F.sum("part").alias("part"))
    wrong = F.concat(F.lit("invalid overlap fraction "), F.col("part").cast("string"), F.lit("; check mesh orientation and closure"))
    sure = F.when(F.col("part").between(-OUTSIDE, 1 + OUTSIDE), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("part")))).otherwise(F.raise_error(wrong))
    return total.select("block", "piece", sure.alias("fraction")).where(F.col("fraction") > least)


def covered(blocks: DataFrame, fractions: DataFrame, columns: list[str]) -> DataFrame:
    """(block, piece, share, volume, and the blocks' own columns): what metrics.partials takes, with share=share.

    volume is the block's own; share the part of it inside the piece.
    """
    own = blocks.select("block", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0"))).alias("volume"), *columns)
    return fractions.withColumnRenamed("fraction", "share").join(own, "block")


def over_budget(fractions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(block, total): blocks of which pieces take more than the whole between them, so pieces overlap there."""
    out = fractions.groupBy("block").agg(F.sum("fraction").alias("total"))
    return out.where(F.col("total") > 1 + tolerance)


def box_faces(pieces: DataFrame) -> DataFrame:
    """The twelve outward faces of pieces(piece, x0, y0, z0, x1, y1, z1)."""
    ring = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    sides = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
    face = lambda s: F.struct(*[F.col(f"{c}{ring[v][k]}").cast("double").alias(f"{p}{c}") for p, v in zip("abc", s, strict=True) for k, c in enumerate("xyz")])
    return pieces.select("piece", F.explode(F.array(*[face(s) for s in sides])).alias("f")).select("piece", "f.*")
