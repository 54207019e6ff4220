"""Spatial queries: parts are points of a lattice, embeddings points of space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import profile as P
from ..operators import spatial as S
from ..plans.closure import solve_many
from .registry import query, table


def cloud(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


_C = "c AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


@query(f"""WITH {_C}, o AS (SELECT *, floor((x - (SELECT min(x) FROM c)) / 0.15)::BIGINT AS i, floor((y - (SELECT min(y) FROM c)) / 0.15)::BIGINT AS j, floor((z - (SELECT min(z) FROM c)) / 0.15)::BIGINT AS k FROM c)
SELECT a.vec_id, count(*) - 1 AS neighbours FROM o a JOIN o b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY a.vec_id""")
def voxel_noise(spark, d):
    return S.neighbour_counts(cloud(spark, d), "vec_id", 0.15)


@query(f"WITH {_C} SELECT floor(x / 0.2)::BIGINT AS cx, floor(y / 0.2)::BIGINT AS cy, count(*) AS n, round(avg(z), 6) AS mean FROM c GROUP BY cx, cy")
def grid_cell_mean(spark, d):
    return S.cell_means(cloud(spark, d), 0.2).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_C} SELECT round(sqrt(count(DISTINCT (floor(x / 0.1), floor(y / 0.1))) * 0.1::DOUBLE * 0.1::DOUBLE / count(*)), 6) AS spacing FROM c")
def plan_spacing(spark, d):
    return S.plan_spacing(cloud(spark, d), 0.1).select(F.round("spacing", 6).alias("spacing"))


@query(f"""WITH {_C}, p AS (SELECT a.vec_id AS target, b.vec_id AS sample, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
  FROM c a JOIN c b ON b.vec_id <> a.vec_id)
SELECT target, sample, place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d2, sample) AS place FROM p WHERE d2 <= 0.25) WHERE place <= 8""")
def topk_nearest(spark, d):
    c = cloud(spark, d).where("vec_id IS NOT NULL")
    t = c.withColumnRenamed("vec_id", "target")
    s = c.withColumnRenamed("vec_id", "sample")
    near = S.nearest(t, s, 0.5, 9).where("sample != target")
    from pyspark.sql.window import Window

    return near.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("d2", "sample")).cast("long")).where("place <= 8").select("target", "sample", "place")


@query()
def ordinary_kriging(spark, d):
    c = cloud(spark, d)
    samples = c.select(F.col("vec_id").alias("sample"), "x", "y", "z", F.col("vec_id").cast("double").alias("v"))
    grid = spark.range(64).select(F.col("id").alias("target"), ((F.col("id") % 4) * 0.1 - 0.15).alias("x"), (F.floor(F.col("id") / 4) % 4 * 0.1 - 0.15).alias("y"), (F.floor(F.col("id") / 16) * 0.1 - 0.15).alias("z"))
    return S.krige(grid, samples, 0.5, 16, 3, 1.0, 0.1, 0.8).withColumn("estimate", F.round("estimate", 6))


@query(f"WITH {_C} SELECT vec_id, round(2 * (cos(radians(30)) * x - sin(radians(30)) * y) + 100, 6) AS x, round(2 * (sin(radians(30)) * x + cos(radians(30)) * y) - 50, 6) AS y, 0.0::DOUBLE AS back FROM c")
def similarity_transform(spark, d):
    x, y = G.similarity(F.col("x"), F.col("y"), 2.0, 30.0, 100.0, -50.0)
    bx, by = G.similarity_inverse(x, y, 2.0, 30.0, 100.0, -50.0)
    return cloud(spark, d).select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.abs(F.round(F.hypot(bx - F.col("x"), by - F.col("y")), 6)).alias("back"))


@query(f"WITH {_C} SELECT vec_id, round((degrees(atan2(x, y)) + 360) % 360, 4) AS azimuth, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS dip FROM c")
def direction_angles(spark, d):
    a, dip = G.orientation(F.col("x"), F.col("y"), F.col("z"))
    return cloud(spark, d).select("vec_id", F.round(a, 4).alias("azimuth"), F.round(dip, 4).alias("dip"))


@query("""WITH p AS (SELECT s_suppkey AS pit, (s_suppkey % 100)::DOUBLE AS low, (s_suppkey % 100)::DOUBLE + 5 + s_suppkey % 61 AS high, 2.5::DOUBLE * (1 + s_suppkey % 3) AS h FROM supplier)
SELECT pit, bench::BIGINT AS bench, low + bench * h AS base, least(low + (bench + 1) * h, high) AS top FROM (SELECT *, unnest(range(0, ceil((high - low) / h)::BIGINT)) AS bench FROM p)""")
def bench_flitch_series(spark, d):
    k = F.col("s_suppkey")
    pits = table(spark, d, "supplier").select(k.alias("pit"), (k % 100).cast("double").alias("low"), ((k % 100).cast("double") + 5 + k % 61).alias("high"), (F.lit(2.5) * (1 + k % 3)).alias("h"))
    return pits.select("pit", F.posexplode(S.bands_between(F.col("low"), F.col("high"), F.col("h"))).alias("bench", "b")).select("pit", F.col("bench").cast("long").alias("bench"), "b.base", "b.top")


@query("""WITH p AS (SELECT p_partkey, p_size * 0.3::DOUBLE + 0.0523 AS lo, p_size * 0.3::DOUBLE + 0.0523 + p_partkey % 6 AS hi FROM part),
l AS (SELECT p_partkey, unnest(range(ceil(lo / 0.5)::BIGINT, floor(hi / 0.5)::BIGINT + 1)) * 0.5::DOUBLE AS level FROM p UNION ALL SELECT p_partkey, unnest(range(ceil(lo / 2)::BIGINT, floor(hi / 2)::BIGINT + 1)) * 2.0::DOUBLE FROM p UNION ALL
  SELECT p_partkey, unnest(range(ceil(lo / 0.75)::BIGINT, floor(hi / 0.75)::BIGINT + 1)) * 0.75::DOUBLE FROM p)
SELECT DISTINCT p_partkey, level FROM l""")
def contour_levels(spark, d):
    lo = F.col("p_size") * 0.3 + 0.0523
    p = table(spark, d, "part").select("p_partkey", F.explode(S.levels_between(lo, lo + F.col("p_partkey") % 6, [0.5, 2.0, 0.75])).alias("level"))
    return p


def triangles(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    v = lambda dx, dy, z: F.struct((F.col("p_partkey") % 20 + dx).cast("double").alias("x"), (F.floor(F.col("p_partkey") / 20) + dy).cast("double").alias("y"), z.cast("double").alias("z"))
    return p.select(F.col("p_partkey").alias("face"), v(0, 0, F.col("p_size")).alias("a"), v(1, 0, F.col("p_size") % 7 + 1).alias("b"), v(0, 1, F.col("p_retailprice") % 13).alias("c"))


_TR = """t AS (SELECT p_partkey AS face, p_partkey % 20 AS x, p_partkey // 20 AS y, p_size AS za, p_size % 7 + 1 AS zb, p_retailprice % 13 AS zc FROM part), l AS (SELECT unnest([5.0, 10.0, 20.0]) AS level),
e AS (SELECT face, level, x::DOUBLE AS x0, y::DOUBLE AS y0, za AS z0, x + 1.0 AS x1, y::DOUBLE AS y1, zb AS z1 FROM t, l UNION ALL SELECT face, level, x + 1.0, y, zb, x, y + 1.0, zc FROM t, l UNION ALL SELECT face, level, x, y + 1.0, zc, x, y, za FROM t, l),
k AS (SELECT face, level, x0 + (x1 - x0) * ((level - z0) / (z1 - z0)) AS x, y0 + (y1 - y0) * ((level - z0) / (z1 - z0)) AS y FROM e WHERE (z0 <= level AND level < z1) OR (z1 <= level AND level < z0))"""


@query(f"WITH {_TR} SELECT face, level::DOUBLE AS level, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 6) AS length FROM k GROUP BY face, level HAVING count(*) = 2")
def contour_segments(spark, d):
    s = S.contour_segments(triangles(spark, d), [5.0, 10.0, 20.0])
    return s.select("face", "level", F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 6).alias("length"))


@query("""SELECT p_partkey, round(0.5 * p_size * (p_partkey % 9 + 1), 6)::DOUBLE AS area, round(p_size + (p_partkey % 9 + 1) + sqrt(p_size * p_size + (p_partkey % 9 + 1) * (p_partkey % 9 + 1)), 6) AS perimeter FROM part""")
def shoelace_area(spark, d):
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 9 + 1).cast("double")
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(5.0), F.lit(2.0)), (F.lit(5.0) + w, F.lit(2.0)), (F.lit(5.0) + w, F.lit(2.0) + h))])
    return table(spark, d, "part").select("p_partkey", F.round(G.shoelace(ring), 6).alias("area"), F.round(G.perimeter(ring), 6).alias("perimeter"))


@query(f"WITH {_C}, r(ring, x0, y0, x1, y1) AS (VALUES ('a', -0.2, -0.2, 0.1, 0.15), ('b', 0.0, 0.0, 0.4, 0.3)) SELECT vec_id AS point, ring FROM c JOIN r ON x > x0 AND x < x1 AND y > y0 AND y < y1")
def point_in_polygon(spark, d):
    boxes = [("a", -0.2, -0.2, 0.1, 0.15), ("b", 0.0, 0.0, 0.4, 0.3)]
    rings = spark.createDataFrame([(n, [(a, b), (c, b), (c, e), (a, e)]) for n, a, b, c, e in boxes], "ring string, verts array<struct<x:double,y:double>>")
    return S.points_in_rings(cloud(spark, d).withColumnRenamed("vec_id", "point"), rings, 0.1)


def lattice(spark, d):
    p = table(spark, d, "part")
    return p.select((F.col("p_partkey") % 10).alias("i"), (F.floor(F.col("p_partkey") / 10) % 10).alias("j"), (F.floor(F.col("p_partkey") / 100)).alias("k")).where("NOT (i = 3 AND j = 3)").distinct()


_L = "l AS (SELECT DISTINCT p_partkey % 10 AS i, p_partkey // 10 % 10 AS j, p_partkey // 100 AS k FROM part WHERE NOT (p_partkey % 10 = 3 AND p_partkey // 10 % 10 = 3))"


@query(f"""WITH {_L}, n AS (SELECT a.i, a.j, a.k, count(b.i) AS n FROM l a LEFT JOIN l b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 GROUP BY ALL) SELECT i, j, k, 6 - n AS open FROM n""")
def boundary_faces(spark, d):
    return S.open_faces(lattice(spark, d), ["i", "j", "k"])


@query("SELECT true AS regular, (max(p_partkey % 10) + 1)::BIGINT AS n_x, (max(p_partkey // 10 % 10) + 1)::BIGINT AS n_y FROM part")
def uniform_grid(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 10 * 7.5 + 100).alias("x"), (F.floor(F.col("p_partkey") / 10) % 10 * 2.5 - 40).alias("y"), F.lit(7.5).alias("dx"), F.lit(2.5).alias("dy"))
    return P.regular_grid(p, ["x", "y"], ["dx", "dy"])


@query("""WITH b AS (SELECT p_partkey, p_partkey % 40 AS c FROM part), k AS (SELECT c, max(p_partkey) AS p_partkey FROM b GROUP BY c)
SELECT i AS cell, p_partkey AS block FROM range(50) t(i) LEFT JOIN k ON c = i""")
def block_of_cell(spark, d):
    b = table(spark, d, "part").groupBy((F.col("p_partkey") % 40).alias("cell")).agg(F.max("p_partkey").alias("block"))
    return spark.range(50).withColumnRenamed("id", "cell").join(b, "cell", "left")


@query()
def nested_shells(spark, d):
    # pits of 100 parts, each at two prices: scenario is 2 * pit + price
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("pit"), (F.col("p_partkey") % 100).alias("block"), "p_size")
    grid = spark.range(2).withColumnRenamed("id", "price").crossJoin(p)
    grid = grid.select((F.col("pit") * 2 + F.col("price")).alias("scenario"), "block", (F.col("p_size") * (F.col("price") + 2)).cast("long").alias("revenue"), (F.col("block") % 7 * 12 + 20).cast("long").alias("cost"))
    return solve_many(grid, (5, 5, 4), [0.6, 0.8, 1.0])


@query("""WITH c AS (SELECT p_partkey % 40 AS i, p_partkey // 40 AS j FROM part), o AS (SELECT o_orderkey AS point, (o_custkey % 40) + 0.125::DOUBLE + o_orderkey % 3 * 0.25 AS x, (o_orderkey % 60) + 0.0625::DOUBLE + o_custkey % 3 * 0.25 AS y FROM orders)
SELECT point, round(2 * x + 3 * y + 1 + (floor(x)::INT + floor(y)::INT) % 2 * 5.0::DOUBLE, 6) AS z FROM o JOIN c ON c.i = floor(x) AND c.j = floor(y)""")
def surface_heights(spark, d):
    """Two triangles a part's cell, every other cell five higher; heights over the orders' places."""
    k = F.col("p_partkey")
    i, j = k % 40, F.floor(k / 40)
    v = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (2 * x + 3 * y + 1 + (i + j) % 2 * 5.0).cast("double").alias("z"))
    halves = F.array(F.struct(v(i, j).alias("a"), v(i + 1, j).alias("b"), v(i, j + 1).alias("c")), F.struct(v(i + 1, j).alias("a"), v(i + 1, j + 1).alias("b"), v(i, j + 1).alias("c")))
    tri = table(spark, d, "part").select(F.explode(halves).alias("t")).select("t.*")
    o = table(spark, d, "orders")
    pts = o.select(F.col("o_orderkey").alias("point"), (F.col("o_custkey") % 40 + 0.125 + F.col("o_orderkey") % 3 * 0.25).alias("x"), (F.col("o_orderkey") % 60 + 0.0625 + F.col("o_custkey") % 3 * 0.25).alias("y"))
    return S.column_heights(pts, tri, 2.0).withColumn("z", F.round("z", 6))
