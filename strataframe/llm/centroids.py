"""Centroid clustering of integer vectors by Exponion search: bounds kept between rounds, balls around the current centroid."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, staged, unused

#: Components are clamped to +-2**27, so that squared distances of 64 of them stay within a long.
LIMIT = 1 << 27
#: Bounds are distances in doubles; they are widened by this share, so that rounding never hides a nearer centroid or a tie.
SLACK = 1e-12
#: Vectors worked on together; a block takes BLOCK * dims * 8 bytes a few times over.
BLOCK = 4096


class Centres:
    """Integer centroids with the distance lists that the search goes by.

    dist[a] are the distances from centroid a to all, sorted; order[a] the centroids in that order (a itself
    apart, at an infinite distance). near[a] is the least of them.
    """

    def __init__(self, points: np.ndarray, before: Centres | None = None):
        self.points, k = points, len(points)
        gap = np.sqrt(np.array([squared(points, c) for c in points], np.float64).reshape(k, k))
        np.fill_diagonal(gap, np.inf)
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.dist = np.take_along_axis(gap, self.order, 1)
        self.near = self.dist[:, 0] if k else np.zeros(0)
        # how far each has moved since the last round, and how far the farthest-moved of the others has
        self.moved = np.zeros(k) if before is None else np.sqrt(((points - before.points) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        top = np.sort(self.moved)[::-1]
        self.others = np.where(np.arange(k) == np.argmax(self.moved), top[1] if k > 1 else 0.0, top[0]) if k else np.zeros(0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one centroid."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign_all(x: np.ndarray, centres: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number), upper bound on its distance, lower bound on that of the second nearest; no bounds yet."""
    best, first, second = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.inf)
    for j, c in enumerate(centres.points):
        d = squared(x, c)
        less = d < first
        second = np.where(less, np.where(first == np.iinfo(np.int64).max, np.inf, np.sqrt(first)), np.minimum(second, np.sqrt(d)))
        best[less], first = j, np.where(less, d, first)
    return best, np.sqrt(first) * (1 + SLACK), second * (1 - SLACK)


def exponion(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids and bounds after the centroids moved, and the distances that this took.

    at, upper and lower are those of the last round. A vector whose upper bound is under its lower bound, or
    under half the way to the centroid nearest to its own, keeps its centroid. Of the others the upper bound is
    made exact, and tried again. For the rest only centroids within 2 * upper + (the way to the nearest centroid)
    of the own one can be nearest or second nearest; those are a prefix of its sorted list. The ball includes
    its edge, so a tie with a smaller number is seen.
    """
    at, upper, lower = at.copy(), upper + centres.moved[at], np.maximum(0.0, lower - centres.others[at] * (1 + SLACK))
    half = centres.near * 0.5 * (1 - SLACK)
    open_ = np.flatnonzero(upper >= np.maximum(lower, half[at]))
    exact = np.zeros(len(open_), np.int64)
    for a in np.unique(at[open_]):
        mine = at[open_] == a
        exact[mine] = squared(x[open_[mine]], centres.points[a])
    upper[open_] = np.sqrt(exact) * (1 + SLACK)
    left = upper[open_] >= np.maximum(lower[open_], half[at[open_]])
    taken, open_, exact = len(open_), open_[left], exact[left]
    own = at[open_]
    for a in np.unique(own):
        rows = np.flatnonzero(own == a)
        radius = (2 * upper[open_[rows]] + centres.near[a]) * (1 + SLACK)
        reach = np.searchsorted(centres.dist[a], radius, "right")
        reach = np.minimum(reach, len(centres.points) - 1)
        turn = np.argsort(-reach, kind="stable")
        rows, reach = rows[turn], reach[turn]
        best, first, second = np.full(len(rows), a), exact[rows], np.full(len(rows), np.iinfo(np.int64).max)
        vectors = x[open_[rows]]
        for p in range(int(reach[0]) if len(reach) else 0):
            n = int(np.searchsorted(-reach, -p, "left"))  # the rows whose ball reaches past the p-th of the list
            j = int(centres.order[a, p])
            d = squared(vectors[:n], centres.points[j])
            taken += n
            less = (d < first[:n]) | ((d == first[:n]) & (j < best[:n]))
            second[:n] = np.where(less, first[:n], np.minimum(second[:n], d))
            first[:n], best[:n] = np.where(less, d, first[:n]), np.where(less, j, best[:n])
        to = open_[rows]
        at[to], upper[to] = best, np.sqrt(first) * (1 + SLACK)
        lower[to] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second)) * (1 - SLACK)
    return at, upper, lower, taken


def integers(column, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow list column have `dims` components, none null or non-finite, and those as integers."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column.filter(pa.array(good)))
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(values).all(1)
    good[np.flatnonzero(good)[~finite]] = False
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values[finite])
    return good, np.clip(scaled, -LIMIT, LIMIT).astype(np.int64)


def _lists(x: np.ndarray):
    import pyarrow as pa

    n, dims = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dims + 1, dims, dtype=np.int32) if dims else np.zeros(n + 1, np.int32)), pa.array(x.ravel().astype(np.int64)))


_STATE = "kind string, cluster int, upper double, lower double, n long, v array<long>"


def _round(rows: DataFrame, centres: Centres, path: str, fresh: bool, dims: int) -> None:
    """One assignment of rows(vec_id, v, and unless fresh cluster, upper, lower): rows with new bounds, and each task's sums, to `path`."""
    id_type = rows.schema["vec_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        import pyarrow as pa

        m, names = shared.value, ["vec_id", "kind", "cluster", "upper", "lower", "n", "v"]
        sums, counts, kind = np.zeros((len(m.points), dims), np.int64), np.zeros(len(m.points), np.int64), None
        for whole in batches:
            kind = whole.column(0).type
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                n = b.num_rows
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dims)
                if fresh:
                    at, upper, lower = assign_all(x, m)
                else:
                    at, upper, lower, _ = exponion(x, *(b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)), m)
                for a in np.unique(at):
                    sums[a] += x[at == a].sum(0)
                counts += np.bincount(at, minlength=len(counts))
                yield pa.record_batch([b.column(0), pa.array(["row"] * n), pa.array(at, pa.int32()), pa.array(upper), pa.array(lower), pa.nulls(n, pa.int64()), b.column(1)], names)
        some = np.flatnonzero(counts)
        if len(some):
            k, none = len(some), pa.nulls(len(some), pa.float64())
            yield pa.record_batch([pa.nulls(k, kind), pa.array(["sum"] * k), pa.array(some, pa.int32()), none, none, pa.array(counts[some]), _lists(sums[some])], names)

    rows.mapInArrow(run, f"vec_id {id_type}, {_STATE}").write.partitionBy("kind").parquet(path)


def _sums(spark, path: str, schema) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact componentwise sums of each cluster that has some: at most k rows reach the driver."""
    parts = spark.read.schema(schema).parquet(path).where("kind = 'sum'")
    flat = parts.select("cluster", "n", F.posexplode("v").alias("i", "x"))
    flat = flat.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = flat.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["cluster"]: (r["n"], [int(e["x"]) for e in r["v"]]) for r in out.collect()}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's rounds on integer vectors, each assignment by Exponion search. Returns (rows, centroids).

    vectors needs vec_id and embedding; other columns are ignored. Rows with exactly `dims` components, none
    null or non-finite, take part; a component x becomes floor(scale * x), clamped to +-2**27. The first
    centroids are the k rows with the least lowercase-hex sha256 of `seed:vec_id` (a null id as the empty text;
    ties by id and components), in that order; with fewer rows than k, all of them. Each round assigns every row
    to its nearest centroid (ties: smaller number) and puts each centroid that has rows at their exact
    componentwise floor(sum / count); then rows are assigned once more.

    rows has vec_id, v (the integers) and cluster, one a row that takes part; centroids is k x dims.
    Repeated rows fare alike. An empty table, or one without rows that take part, gives none.

    A row carries its bounds from round to round in a table in the shared folder, which each task reads, brings
    up to date and writes again together with its own sums; no round shuffles vectors. The last but one table is
    emptied once the next is written, so that two of them lie on disk at a time. Only k centroids and k sums reach the
    driver. Equal rows cost no task more than others do, as nothing is grouped by value.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def prepare(batches):
        import pyarrow as pa

        for b in batches:
            good, x = integers(b.column(1), dims, scale)
            yield pa.record_batch([b.column(0).filter(pa.array(good)), _lists(x)], ["vec_id", "v"])

    ready = staged(rows.mapInArrow(prepare, f"vec_id {id_type}, v array<long>"), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = ready.select(name.alias("name"), "vec_id", "v").orderBy("name", "vec_id", "v").limit(k).collect()
    centres = Centres(np.array([r["v"] for r in first], np.int64).reshape(len(first), dims))
    if not first:
        return ready.withColumn("cluster", F.lit(None).cast("int")), centres.points
    base, table, last = f"{shared_dir(spark)}/exponion-{uuid.uuid4().hex}", ready, None
    schema = f"vec_id {id_type}, {_STATE}"
    for r in range(rounds + 1):
        path = f"{base}/{r}"
        columns = ["vec_id", "v"] if r == 0 else ["vec_id", "v", "cluster", "upper", "lower"]
        _round(table.select(*columns), centres, path, r == 0, dims)
        if last:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(last)
        table, last = spark.read.schema(schema).parquet(path).where("kind = 'row'"), path
        if r < rounds:
            sums, points = _sums(spark, path, schema), centres.points.copy()
            for a, (n, total) in sums.items():
                points[a] = [x // n for x in total]
            centres = Centres(points, centres)
    return table.select("vec_id", "v", "cluster"), centres.points


def digest(clustered: DataFrame, points: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia and inertia (distance summed), centroid_sha256 of each clustered row.

    Sums that exceed a long are null. The centroids (k of them) are literals of the plan.
    """
    k = len(points)
    names = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    spark = clustered.sparkSession
    shared = spark.sparkContext.broadcast(points)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
            d = x - shared.value[at] if k else x
            yield pa.record_batch([b.column(0), b.column(2), pa.array(np.einsum("ij,ij->i", d, d), pa.int64())], ["vec_id", "cluster", "distance"])

    id_type = clustered.schema["vec_id"].dataType.simpleString()
    out = clustered.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")
    total = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    sums = {r["cluster"]: int(r["d"]) for r in total.collect()}
    long = lambda x: x if x < 1 << 63 else None
    each = [(a, long(sums.get(a, 0)), long(sum(sums.values())), names[a]) for a in range(k)]
    own = unused("__cluster", out)
    per = spark.createDataFrame(each, f"{own} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per), F.col("cluster") == F.col(own)).drop(own)
