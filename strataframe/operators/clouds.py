"""Point features by voxel at several scales, and a forest that votes on them."""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import _neighbours, cell

#: Voxel edges of the scales, points that a neighbourhood needs for a shape, and what stands for none.
SCALES, SHAPE_POINTS, NO_SHAPE = (1.0, 2.0, 4.0, 8.0), 4, -1.0
PER_SCALE = ("linearity", "planarity", "scattering", "verticality", "off_plane", "over_low", "under_high")
SUMS = ("n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz")
#: Fixed values of the forest's file: its head, the mark of a leaf, most classes.
MAGIC, LEAF, MOST_CLASSES = b"IRF1", 255, 8


def voxel_moments(points: DataFrame, scale: float) -> DataFrame:
    """(cx, cy, cz, SUMS, low, high) of each occupied voxel, about the voxel's own corner.

    points(x, y, z) whose voxels start at 0. About its corner a voxel's sums stay exact however far the cloud
    lies from the origin; they are moved when voxels meet.
    """
    away = {f"u{c}": F.col(c) - F.col(f"c{c}") * scale for c in "xyz"}
    p = points.withColumns({f"c{c}": cell(F.col(c), scale) for c in "xyz"}).withColumns(away)
    u = lambda a, b: F.sum(F.col(f"u{a}") * F.col(f"u{b}")).alias(f"s{a}{b}")
    return p.groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"u{c}").alias(f"s{c}") for c in "xyz"], *[u(a, b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")], F.min("z").alias("low"), F.max("z").alias("high"))


def neighbourhoods(moments: DataFrame, scale: float) -> DataFrame:
    """(cx, cy, cz, SUMS, low, high) of each occupied voxel and the 26 around it, about the voxel's corner.

    Each voxel sends its sums to its neighbours, moved by whole voxels: at most 27 rows a voxel, however many
    points it has, and they are added before and after the shuffle.
    """
    sent = _neighbours(moments.withColumns({f"o{c}": F.col(f"c{c}") for c in "xyz"}), ["cx", "cy", "cz"])
    d = {c: (F.col(f"o{c}") - F.col(f"c{c}")) * F.lit(float(scale)) for c in "xyz"}
    first = {f"s{c}": F.col(f"s{c}") + F.col("n") * d[c] for c in "xyz"}
    second = {f"s{a}{b}": F.col(f"s{a}{b}") + d[a] * F.col(f"s{b}") + d[b] * F.col(f"s{a}") + F.col("n") * d[a] * d[b] for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    moved = sent.select("cx", "cy", "cz", "n", *[v.alias(k) for k, v in (first | second).items()], "low", "high")
    around = moved.groupBy("cx", "cy", "cz").agg(*[F.sum(c).alias(c) for c in SUMS], F.min("low").alias("low"), F.max("high").alias("high"))
    # only voxels that hold points need a shape
    return around.join(moments.select("cx", "cy", "cz"), ["cx", "cy", "cz"], "left_semi")


def covariances(around: DataFrame) -> DataFrame:
    """(cx, cy, cz, n, mx, my, mz, xx, xy, xz, yy, yz, zz, low, high): means about the voxel's corner, and the covariance."""
    mean = lambda c: F.col(f"s{c}") / F.col("n")
    return around.select("cx", "cy", "cz", "n", *[mean(c).alias(f"m{c}") for c in "xyz"], *[(F.col(f"s{a}{b}") / F.col("n") - mean(a) * mean(b)).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")], "low", "high")


_SHAPE = "linearity double, planarity double, scattering double, nx double, ny double, nz double"


def shapes(covariance: DataFrame) -> DataFrame:
    """covariances with linearity, planarity, scattering and the upward unit normal; -1 and a null normal with fewer than 4 points or no spread."""
    columns = covariance.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in covariance.schema) + ", " + _SHAPE

    def run(batches):
        import pyarrow as pa

        for b in batches:
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: E731, B023
            m = np.stack([np.stack([get(min(a, c) + max(a, c)) for c in "xyz"], -1) for a in "xyz"], -1)
            values, vectors = np.linalg.eigh(m) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            small, middle, large = np.maximum(values, 0).T
            normal = vectors[:, :, 0]
            normal = np.where(normal[:, 2:] < 0, -normal, normal)
            ok = (get("n") >= SHAPE_POINTS) & (large > 1e-12)
            safe = np.where(ok, large, 1.0)
            ratios = [np.where(ok, x, NO_SHAPE) for x in ((large - middle) / safe, (middle - small) / safe, small / safe)]
            extra = [pa.array(x) for x in ratios] + [pa.array(normal[:, k], mask=~ok) for k in range(3)]
            yield pa.record_batch([*b.columns, *extra], [*columns, "linearity", "planarity", "scattering", "nx", "ny", "nz"])

    return covariance.mapInArrow(run, schema)


def point_features(points: DataFrame, scales: Sequence[float] = SCALES) -> DataFrame:
    """points(point, x, y, z, ...) with seven features a scale, named `<feature>_<scale's place>`.

    The eigenvalue ratios of the own voxel and the 26 around it; one less the normal's upward part; the height off the
    fitted plane along its normal, over the lowest and under the highest point around, in voxels. Voxels start at the
    cloud's least coordinates. Points with a missing or non-finite coordinate are left out; equal points fare alike;
    no points give none.

    A scale's neighbourhoods are summed by voxel and joined to points by voxel, so points aren't compared with each
    other and a dense voxel is a sum. The voxel join splits a crowded voxel's points among tasks (they are the larger side).
    """
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = points.where(finite)
    low = kept.agg(*[F.min(c).alias(c) for c in "xyz"]).first()
    moved = kept.withColumns({f"__{c}": F.col(c) for c in "xyz"}).withColumns({c: F.col(c) - F.lit(low[c] if low[c] is not None else 0.0) for c in "xyz"})
    base, out = moved.select("x", "y", "z"), moved
    for k, scale in enumerate(scales):
        s = shapes(covariances(neighbourhoods(voxel_moments(base, scale), scale)))
        s = s.select(*[F.col(f"c{c}").alias(f"__v{c}") for c in "xyz"], *[F.col(c).alias(f"__{c}") for c in ("mx", "my", "mz", "nx", "ny", "nz", "low", "high")], *[F.col(c).alias(f"{c}_{k}") for c in PER_SCALE[:3]])
        out = out.withColumns({f"__k{c}": cell(F.col(c), scale) for c in "xyz"})
        on = (F.col("__kx") == F.col("__vx")) & (F.col("__ky") == F.col("__vy")) & (F.col("__kz") == F.col("__vz"))
        j = out.join(s, on)
        off = sum(((F.col(c) - F.col(f"__k{c}") * F.lit(float(scale)) - F.col(f"__m{c}")) * F.col(f"__n{c}") for c in "xyz"), F.lit(0.0)) / scale
        more = {f"verticality_{k}": F.coalesce(1 - F.col("__nz"), F.lit(NO_SHAPE)), f"off_plane_{k}": F.coalesce(off, F.lit(NO_SHAPE)), f"over_low_{k}": (F.col("z") - F.col("__low")) / scale, f"under_high_{k}": (F.col("__high") - F.col("z")) / scale}
        out = j.withColumns(more).select(*out.columns, *[f"{c}_{k}" for c in PER_SCALE])
    names = [f"{c}_{k}" for k in range(len(scales)) for c in PER_SCALE]
    return out.withColumns({c: F.col(f"__{c}") for c in "xyz"}).select(*points.columns, *names)


def eigen_frames(rows: DataFrame, columns: Sequence[str] = ("xx", "xy", "xz", "yy", "yz", "zz")) -> DataFrame:
    """rows with `values` (array, largest first) and `vectors` (array of three unit vectors) of the symmetric matrix in six columns; null where one is missing or not finite. A vector's largest part is positive."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", values array<double>, vectors array<array<double>>"
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            six = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1) if b.num_rows else np.zeros((0, 6))
            ok = np.isfinite(six).all(1)
            m = np.where(ok[:, None], six, 0.0)[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(m) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            turned = vectors.transpose(0, 2, 1)[:, ::-1]
            most = np.take_along_axis(turned, np.abs(turned).argmax(2)[:, :, None], 2)
            turned = turned * np.where(most < 0, -1.0, 1.0)
            out = [[x if good else None for good, x in zip(ok.tolist(), part.tolist(), strict=True)] for part in (values[:, ::-1], turned)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[0], pa.list_(pa.float64())), pa.array(out[1], pa.list_(pa.list_(pa.float64())))], [*names, "values", "vectors"])

    return rows.mapInArrow(run, schema)


class Forest:
    """Trees as one table of nodes: feature (or LEAF), threshold, left, right, with a row of class weights for each leaf."""

    def __init__(self, features: int, classes: int, trees: list[tuple[np.ndarray, np.ndarray]]):
        self.features, self.classes = features, classes
        at, base = 0, 0
        nodes, leaves, self.roots = [], [], []
        for tree, rows in trees:
            mine = tree.astype([("feature", "i8"), ("left", "i8"), ("right", "i8"), ("threshold", "f4")])
            leaf = mine["feature"] == LEAF
            mine["left"] += np.where(leaf, base, at)
            mine["right"] += at
            self.roots.append(at)
            nodes.append(mine)
            leaves.append(rows)
            at, base = at + len(mine), base + len(rows)
        self.nodes = np.concatenate(nodes) if nodes else np.zeros(0, [("feature", "i8"), ("left", "i8"), ("right", "i8"), ("threshold", "f4")])
        self.leaves = np.concatenate(leaves) if leaves else np.zeros((0, classes), np.int64)
        self.depth = max((len(t) for t, _ in trees), default=0)

    @classmethod
    def parse(cls, data: bytes) -> Forest:
        """Read the little-endian binary: head, feature and class counts (u8), trees (u16); a tree: nodes and leaves (u16), nodes of u8, u16, u16, f32, leaves of a u8 a class.

        A file that is cut short or goes on, an unknown head, no or too many classes, an empty tree, and a node that
        points beyond its tree, its leaves or the features are errors.
        """
        at = 0

        def take(n: int) -> bytes:
            nonlocal at
            if at + n > len(data):
                raise ValueError("the classifier is cut short")
            at += n
            return data[at - n : at]

        if take(4) != MAGIC:
            raise ValueError("unknown classifier format")
        features, classes, count = struct.unpack("<BBH", take(4))
        if not 1 <= classes <= MOST_CLASSES:
            raise ValueError(f"{classes} classes")
        trees = []
        for _ in range(count):
            n, m = struct.unpack("<HH", take(4))
            nodes = np.frombuffer(take(9 * n), [("feature", "u1"), ("left", "<u2"), ("right", "<u2"), ("threshold", "<f4")])
            leaves = np.frombuffer(take(m * classes), np.uint8).reshape(m, classes).astype(np.int64)
            leaf = nodes["feature"] == LEAF
            if not n or (nodes["left"][leaf] >= m).any() or (nodes["feature"][~leaf] >= features).any() or (np.maximum(nodes["left"], nodes["right"])[~leaf] >= n).any():
                raise ValueError("a tree is empty or a node points nowhere")
            trees.append((nodes, leaves))
        if at != len(data):
            raise ValueError("the classifier goes on after its end")
        return cls(features, classes, trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The class with most votes for each row of float32 features (ties: the smaller class); a tree that leads round adds none."""
        x = x.astype(np.float32)
        votes = np.zeros((len(x), self.classes), np.int64)
        for root in self.roots:
            at = np.full(len(x), root)
            going = np.arange(len(x))
            for _ in range(self.depth):
                node = self.nodes[at[going]]
                going = going[node["feature"] != LEAF]
                if not len(going):
                    break
                node = self.nodes[at[going]]
                at[going] = np.where(x[going, node["feature"]] <= node["threshold"], node["left"], node["right"])
            end = self.nodes[at]
            done = np.flatnonzero(end["feature"] == LEAF)
            votes[done] += self.leaves[end["left"][done]]
        return votes.argmax(1)


def map_features(df: DataFrame, columns: Sequence[str], apply: Callable[[np.ndarray], np.ndarray], name: str, kind: str) -> DataFrame:
    """df with `name`: what `apply` makes of each row's columns, given as float64 rows by batch."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` {kind}"
    names = df.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1) if b.num_rows else np.zeros((0, len(columns)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(apply(x))], [*names, name])

    return df.mapInArrow(run, schema)


def classify(features: DataFrame, columns: Sequence[str], forest: Forest) -> DataFrame:
    """features with `cls`, the forest's vote on the columns; the forest, 65,535 trees and nodes a tree at most by its format, is broadcast."""
    if len(columns) != forest.features:
        raise ValueError(f"the classifier takes {forest.features} features, not {len(columns)}")
    shared = features.sparkSession.sparkContext.broadcast(forest)
    return map_features(features, columns, lambda x: shared.value.predict(x), "cls", "long")
