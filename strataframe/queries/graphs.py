"""Networks: suppliers are holes tied to nearby keys; nations the nodes of a road graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import query, table


def ties(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"))
    both = s.select("a", F.explode(F.array(F.struct((F.col("a") + 3).alias("b"), (F.col("a") % 5 + 17).alias("ms")), F.struct((F.col("a") * 2 + 1).alias("b"), (F.col("a") % 7 + 42).alias("ms")))).alias("t")).select("a", "t.*")
    return both.join(s.withColumnRenamed("a", "b"), "b", "left_semi")


_T = """t AS (SELECT a, b, ms FROM (SELECT s_suppkey AS a, s_suppkey + 3 AS b, s_suppkey % 5 + 17 AS ms FROM supplier UNION ALL SELECT s_suppkey, s_suppkey * 2 + 1, s_suppkey % 7 + 42 FROM supplier)
  WHERE b IN (SELECT s_suppkey FROM supplier))"""
_F = f"""WITH RECURSIVE {_T}, e AS (SELECT a AS src, b AS dst, ms FROM t UNION ALL SELECT b, a, ms FROM t),
f(node, cost) USING KEY (node) AS (SELECT 1::BIGINT AS node, 0::BIGINT AS cost
  UNION SELECT e.dst, min(f.cost + e.ms) FROM f JOIN e ON f.node = e.src LEFT JOIN recurring.f AS r ON r.node = e.dst WHERE r.cost IS NULL OR f.cost + e.ms < r.cost GROUP BY e.dst)"""


def firing(spark, d):
    t = ties(spark, d).select("a", "b", F.col("ms").cast("double").alias("w"))
    start = spark.createDataFrame([(1, 0.0)], "node long, cost double")
    return t, G.shortest_paths(G.undirected(t), start)


@query(f"{_F} SELECT node, cost::DOUBLE AS cost FROM f")
def firing_times(spark, d):
    return firing(spark, d)[1]


@query(f"""{_F}, w AS (SELECT t.a, t.b, x.cost AS ta, y.cost AS tb FROM t LEFT JOIN f x ON x.node = a LEFT JOIN f y ON y.node = b)
SELECT a, b, CASE WHEN ta IS NULL OR tb IS NULL THEN 'dead' WHEN ta < tb THEN 'forward' WHEN ta > tb THEN 'backward' ELSE 'together' END AS flow FROM w""")
def tie_flow(spark, d):
    t, times = firing(spark, d)
    return G.tie_flow(t, times)


@query(f"WITH RECURSIVE {_T}, r AS (SELECT 2::BIGINT AS node UNION SELECT t.b FROM r JOIN t ON t.a = r.node) SELECT node FROM r")
def reachability(spark, d):
    edges = ties(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return G.reachable(edges, spark.createDataFrame([(2,)], "node long"))


_R = """r AS (SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst, n_nationkey % 4 + 1.0 AS km FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, n_nationkey % 3 + 2.5 FROM nation)"""


def roads(spark, d):
    n = F.col("n_nationkey")
    both = table(spark, d, "nation").select(n.cast("long").alias("src"), F.explode(F.array(F.struct(((n * 3 + 1) % 25).cast("long").alias("dst"), (n % 4 + 1.0).alias("km")), F.struct(((n + 7) % 25).cast("long").alias("dst"), (n % 3 + 2.5).alias("km")))).alias("e"))
    return both.select("src", "e.*")


@query(f"""WITH RECURSIVE {_R}, p AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS km UNION SELECT r.dst, (p.km + r.km)::DOUBLE FROM p JOIN r ON r.src = p.node WHERE p.km + r.km < 25),
q AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS km UNION SELECT r.src, (q.km + r.km)::DOUBLE FROM q JOIN r ON r.dst = q.node WHERE q.km + r.km < 25),
a AS (SELECT node, min(km) AS out_km FROM p GROUP BY node), b AS (SELECT node, min(km) AS back_km FROM q GROUP BY node)
SELECT node, out_km, back_km, round(out_km / 40 + back_km / 60, 6) AS cycle FROM a JOIN b USING (node)""")
def haul_shortest_path(spark, d):
    e = roads(spark, d).withColumnRenamed("km", "w")
    start = spark.createDataFrame([(0, 0.0)], "node long, cost double")
    out = G.shortest_paths(e, start).withColumnRenamed("cost", "out_km")
    back = G.shortest_paths(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), start).withColumnRenamed("cost", "back_km")
    return out.join(back, "node").select("node", "out_km", "back_km", F.round(F.col("out_km") / 40 + F.col("back_km") / 60, 6).alias("cycle"))


@query("""WITH r AS (SELECT n_nationkey AS road, n_nationkey AS src, (n_nationkey * 5) % 25 AS dst, (n_nationkey % 6) * 0.03 AS grade FROM nation WHERE n_nationkey % 3 <> 0),
deg AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM r UNION ALL SELECT dst FROM r) GROUP BY node)
SELECT 'dead end' AS kind, n_nationkey AS id FROM nation JOIN deg ON node = n_nationkey WHERE n = 1 UNION ALL
SELECT 'no road', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT node FROM deg) UNION ALL SELECT 'steep', road FROM r WHERE grade > 0.1""")
def network_issues(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    r = n.where("node % 3 != 0").select(F.col("node").alias("road"), F.col("node").alias("src"), (F.col("node") * 5 % 25).alias("dst"), ((F.col("node") % 6) * 0.03).alias("grade"))
    return G.network_issues(n, r, 0.1)
