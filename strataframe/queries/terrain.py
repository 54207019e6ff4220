"""Terrain of the orders: customers and order numbers are places, prices heights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import clouds as CL
from ..operators import quadtree as Q
from ..operators import surfaces as SU
from .registry import query, table


def ground(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 97 + F.col("o_orderkey") % 10 / 10.0).cast("double").alias("x"), (F.col("o_orderkey") % 89).cast("double").alias("y"), (F.col("o_totalprice") / 1000).cast("double").alias("z"))


_CELLS = """g AS (SELECT (o_custkey % 97 + o_orderkey % 10 / 10.0)::DOUBLE AS x, (o_orderkey % 89)::DOUBLE AS y, (o_totalprice / 1000)::DOUBLE AS z FROM orders),
k AS (SELECT floor(x / 2)::BIGINT AS kx, floor(y / 2)::BIGINT AS ky, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM g GROUP BY 1, 2),
c AS (SELECT *, list_sum(list_transform(range(0, 31), lambda i: ((kx >> i) & 1) << (2 * i)))::BIGINT + list_sum(list_transform(range(0, 31), lambda i: ((ky >> i) & 1) << (2 * i + 1)))::BIGINT AS code FROM k)"""


@query(f"""WITH {_CELLS}, l AS (SELECT unnest(range(0, 7)) AS level),
m AS (SELECT level, code >> (2 * level) AS node, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, sum(x * z) AS sxz, sum(y * z) AS syz, sum(z * z) AS szz FROM c, l GROUP BY 1, 2),
v AS (SELECT *, sxx - sx * sx / n AS cxx, syy - sy * sy / n AS cyy, sxy - sx * sy / n AS cxy, sxz - sx * sz / n AS cxz, syz - sy * sz / n AS cyz, greatest(0, szz - sz * sz / n) AS czz FROM m),
r AS (SELECT *, cxx * cyy - cxy * cxy AS det FROM v)
SELECT level::INTEGER AS level, node::BIGINT AS code, n::BIGINT AS n, round(sz / n + 0.00000123, 5) AS mean, round(sxz + 0.00123, 2) AS sxz,
  round(CASE WHEN n < 2 THEN 0 WHEN n < 3 OR det <= 1e-6 * cxx * cyy THEN czz ELSE greatest(0, czz - (cyy * cxz - cxy * cyz) / det * cxz - (cxx * cyz - cxy * cxz) / det * cyz) END + 0.00123, 2) AS residual FROM r""")
def quadtree_levels(spark, d):
    nodes = Q.levels(Q.leaves(ground(spark, d), 2.0, 0.0, 0.0), depth=6)
    return nodes.select("level", "code", "n", F.round(F.col("sz") / F.col("n") + 0.00000123, 5).alias("mean"), F.round(F.col("sxz") + 0.00123, 2).alias("sxz"), F.round(F.col("residual") + 0.00123, 2).alias("residual"))


@query(f"""WITH {_CELLS} SELECT count(*)::BIGINT AS cells, round(avg(z), 5) AS mean, true AS within, true AS whole FROM c""")
def quadtree_cut(spark, d):
    """The cut's own rows have a plain version in the tests; here: it holds every cell once and keeps the budget."""
    cells = Q.leaves(ground(spark, d), 2.0, 0.0, 0.0)
    n = cells.count()
    got = Q.cut(cells, 300)
    return got.agg(F.sum("n").alias("cells"), F.round(F.sum(F.col("n") * F.col("z")) / F.sum("n"), 5).alias("mean"), (F.count(F.lit(1)) <= 300).alias("within"), (F.sum("n") == n).alias("whole"))


_HEAP = """p AS (SELECT o_orderkey AS point, (o_custkey % 53 / 4.0)::DOUBLE AS x, (o_orderkey % 61 / 5.0)::DOUBLE AS y, (o_totalprice / 50000)::DOUBLE AS z FROM orders),
q AS (SELECT point, x - min(x) OVER () AS x, y - min(y) OVER () AS y, z - min(z) OVER () AS z FROM p)"""


def heap(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("point"), (F.col("o_custkey") % 53 / 4.0).cast("double").alias("x"), (F.col("o_orderkey") % 61 / 5.0).cast("double").alias("y"), (F.col("o_totalprice") / 50000).cast("double").alias("z"))


@query(f"""WITH {_HEAP}, v AS (SELECT floor(x / 2)::BIGINT AS cx, floor(y / 2)::BIGINT AS cy, floor(z / 2)::BIGINT AS cz, x, y, z FROM q),
k AS (SELECT DISTINCT cx, cy, cz FROM v)
SELECT k.cx, k.cy, k.cz, count(*)::BIGINT AS n, round(avg(z) - k.cz * 2 + 0.00000123, 5) AS mz, round(covar_pop(x, x) + 0.00000123, 5) AS xx, round(covar_pop(x, z) + 0.00000123, 5) AS xz, round(covar_pop(z, z) + 0.00000123, 5) AS zz, round(max(z), 6) AS high
FROM k JOIN v ON v.cx BETWEEN k.cx - 1 AND k.cx + 1 AND v.cy BETWEEN k.cy - 1 AND k.cy + 1 AND v.cz BETWEEN k.cz - 1 AND k.cz + 1 GROUP BY k.cx, k.cy, k.cz""")
def voxel_covariances(spark, d):
    p = heap(spark, d)
    low = p.agg(*[F.min(c).alias(c) for c in "xyz"]).first()
    p = p.withColumns({c: F.col(c) - F.lit(low[c]) for c in "xyz"})
    c = CL.covariances(CL.neighbourhoods(CL.voxel_moments(p, 2.0), 2.0))
    return c.select("cx", "cy", "cz", "n", *[F.round(F.col(x) + 0.00000123, 5).alias(x) for x in ("mz", "xx", "xz", "zz")], F.round("high", 6).alias("high"))


@query()
def point_feature_rows(spark, d):
    """Seven features of each of four scales, and the vote of a small forest on them: steep, flat or mixed ground around a point."""
    names = [f"{c}_{k}" for k in range(4) for c in CL.PER_SCALE]
    rows = CL.point_features(heap(spark, d))
    voted = CL.classify(rows, names, small_forest())
    return voted.select("point", *[F.round(c, 4).alias(c) for c in names], "cls")


def small_forest() -> CL.Forest:
    """Three trees of one or two splits over verticality and planarity."""
    node = lambda *rows: np.array(list(rows), [("feature", "u1"), ("left", "u2"), ("right", "u2"), ("threshold", "f4")])
    leaf = lambda i: (CL.LEAF, i, 0, 0.0)
    weights = np.array([[200, 30, 25], [20, 200, 35], [60, 60, 135]])
    split = lambda feature, cut, left, right: (feature, left, right, cut)
    trees = [node(split(3, 0.4, 1, 2), leaf(0), leaf(1)), node(split(10, 0.5, 1, 2), leaf(0), split(8, 0.3, 3, 4), leaf(2), leaf(1)), node(split(22, 0.2, 1, 2), leaf(2), leaf(0))]
    return CL.Forest(28, 3, [(t, weights) for t in trees])


# surfaces

_RIGHT = """u AS (SELECT p_partkey AS k, p_partkey % 40 * 1.5::DOUBLE AS x, p_partkey // 40 * 1.25::DOUBLE AS y, 1.0::DOUBLE + p_size % 5 AS leg, p_size::DOUBLE AS z FROM part),
v AS (SELECT s_suppkey AS k, s_suppkey * 7 % 60 + 0.25::DOUBLE AS x, s_suppkey * 11 % 55 + 0.5::DOUBLE AS y, 2.0::DOUBLE + s_suppkey % 6 AS leg, 20.0::DOUBLE AS z FROM supplier)"""


def right_angled(df, key, x, y, leg, z):
    """Triangles with a right angle at (x, y), legs along the axes."""
    at = [(x, y), (x + leg, y), (x, y + leg)]
    return df.select(key.alias("face"), *[c.cast("double").alias(p + n) for p, (a, b) in zip("abc", at, strict=True) for n, c in zip("xyz", (a, b, z), strict=True)])


@query(f"""WITH {_RIGHT}, j AS (SELECT u.k AS a, v.k AS b, least(u.x + u.y + u.leg, v.x + v.y + v.leg) - greatest(u.x, v.x) - greatest(u.y, v.y) AS leg, u.z - v.z AS gap FROM u JOIN v ON u.x < v.x + v.leg AND v.x < u.x + u.leg AND u.y < v.y + v.leg AND v.y < u.y + u.leg)
SELECT a AS upper, b AS lower, round(leg * leg / 2, 6) AS area, round(greatest(gap, 0) * leg * leg / 2, 6) AS above, round(greatest(-gap, 0) * leg * leg / 2, 6) AS below FROM j WHERE leg > 1e-4""")
def triangle_overlaps(spark, d):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    upper = right_angled(table(spark, d, "part"), k, k % 40 * 1.5, F.floor(k / 40) * 1.25, F.lit(1.0) + F.col("p_size") % 5, F.col("p_size"))
    lower = right_angled(table(spark, d, "supplier"), s, s * 7 % 60 + 0.25, s * 11 % 55 + 0.5, F.lit(2.0) + s % 6, F.lit(20.0))
    t = SU.triangle_overlaps(upper, lower, 5.0)
    return t.select("upper", "lower", *[F.round(c, 6).alias(c) for c in ("area", "above", "below")])


@query("""WITH c AS (SELECT c_nationkey AS level, c_acctbal::DOUBLE AS y, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::BIGINT AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT level::BIGINT AS level, place, place::DOUBLE AS x, round(y, 4) AS y, false AS closed FROM c WHERE n > 1""")
def contour_chains(spark, d):
    """The customers of a nation as one line, given as segments in no order and either direction."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("double").alias("y"), (F.row_number().over(w) - 1).cast("double").alias("x"))
    c = c.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).where("px IS NOT NULL")
    flip = F.col("c_custkey") % 3 == 0
    ends = [F.when(flip, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("x1", "x", "px"), ("y1", "y", "py"), ("x2", "px", "x"), ("y2", "py", "y"))]
    chains = SU.chain_segments(c.select(F.col("c_nationkey").cast("long").alias("level"), *ends))
    return chains.select("level", F.col("place").cast("long").alias("place"), "x", F.round("y", 4).alias("y"), "closed")


@query("""WITH x AS (SELECT DISTINCT (o_custkey % 40 * 3 + o_custkey % 5)::DOUBLE AS p FROM orders), y AS (SELECT DISTINCT (s_suppkey % 37 * 2 + s_suppkey % 2 * 0.5)::DOUBLE AS p FROM supplier),
a AS (SELECT lead(p) OVER (ORDER BY p) - p AS wide FROM x), b AS (SELECT lead(p) OVER (ORDER BY p) - p AS high FROM y)
SELECT round(wide * high, 6) AS area, count(*) AS faces FROM a, b WHERE wide IS NOT NULL AND high IS NOT NULL GROUP BY 1""")
def arrangement_faces(spark, d):
    """A lattice of cuts: an upright line for each of the orders' places, a level one for each of the suppliers'."""
    o, s = F.col("o_custkey"), F.col("s_suppkey")
    x = table(spark, d, "orders").select((o % 40 * 3 + o % 5).cast("double").alias("x1")).distinct().select("x1", F.lit(-1.0).alias("y1"), F.col("x1").alias("x2"), F.lit(80.0).alias("y2"))
    y = table(spark, d, "supplier").select((s % 37 * 2 + s % 2 * 0.5).cast("double").alias("y1")).distinct().select(F.lit(-1.0).alias("x1"), "y1", F.lit(130.0).alias("x2"), F.col("y1").alias("y2"))
    faces = SU.arrangement(x.unionByName(y), 20.0).where("place = 0")
    return faces.groupBy(F.round("area", 6).alias("area")).agg(F.count(F.lit(1)).alias("faces"))


@query(f"""WITH {_RIGHT}, r AS (SELECT o_orderkey AS ray, (o_orderkey * 13 % 1200 / 20.0)::DOUBLE + 0.0123 AS x, (o_orderkey * 7 % 1250 / 20.0)::DOUBLE + 0.0071 AS y FROM orders),
h AS (SELECT ray, max((u.z, -u.k)) AS top FROM r JOIN u ON r.x >= u.x AND r.y >= u.y AND (r.x - u.x) + (r.y - u.y) <= u.leg GROUP BY ray)
SELECT ray, -top[2] AS face, round(top[1], 6) AS z FROM h""")
def ray_hits(spark, d):
    """Rays straight down from above each order's place."""
    k, o = F.col("p_partkey"), F.col("o_orderkey")
    faces = right_angled(table(spark, d, "part"), k, k % 40 * 1.5, F.floor(k / 40) * 1.25, F.lit(1.0) + F.col("p_size") % 5, F.col("p_size"))
    rays = table(spark, d, "orders").select(o.alias("ray"), (o * 13 % 1200 / 20.0 + 0.0123).alias("ox"), (o * 7 % 1250 / 20.0 + 0.0071).alias("oy"), F.lit(100.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-128.0).alias("dz"))
    return SU.ray_hits(rays, faces, 3.0).select("ray", "face", F.round("z", 6).alias("z"))
