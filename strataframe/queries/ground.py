"""Ground: systems of coordinates, references to blocks, heirs of blocks, and slots that are computed again only when they change."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import crs as C
from ..operators import identity as ID
from ..session import shared_folder
from ..sources import runs as RU
from .registry import query, table


def _plane_sql() -> str:
    """The forward projection of MGA zone 55, written out."""
    s = C.system(28355)
    a, f = s.ellipsoid()
    n, radius = C._meridian_radius(a, f)
    e = math.sqrt(f * (2 - f))
    wave = lambda fn, gn: " + ".join(f"({c!r}) * {fn}({2 * j} * xi) * {gn}({2 * j} * eta)" for j, c in enumerate(C._series(n, C.ALPHA), 1))
    return f"""p AS (SELECT c_custkey, 141.0::DOUBLE + c_custkey % 60 / 8.0 AS lon, -44.0::DOUBLE + c_custkey % 271 / 8.0 AS lat FROM customer),
q AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t, radians(lon - 147.0) AS l FROM p),
r AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM q),
m AS (SELECT *, 500000 + {s.scale * radius!r} * (eta + {wave("cos", "sinh")}) AS east, 10000000 + {s.scale * radius!r} * (xi + {wave("sin", "cosh")}) AS north FROM r)"""


@query(f"""WITH {_plane_sql()} SELECT c_custkey, round(east, 3) AS east, round(north, 3) AS north, round(lon, 6) AS lon, round(lat, 6) AS lat FROM m""")
def coordinate_conversion(spark, d):
    """Places to a grid and, through another frame and a site's grid, back again."""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select("c_custkey", (F.lit(141.0) + k % 60 / 8.0).cast("double").alias("x"), (F.lit(-44.0) + k % 271 / 8.0).cast("double").alias("y"), F.lit(0.0).alias("z"))
    geographic, grid, new = C.system(4283), C.system(28355), C.system(7855)
    site = C.SiteGrid(new, (480_000.0, 6_000_000.0), (10_000.0, 50_000.0), turn=12.5, scale=0.9998)
    there = C.convert(p, geographic, grid)
    back = C.convert(C.convert(there.withColumns({"east": F.col("x"), "north": F.col("y")}), grid, site), site, geographic)
    return back.select("c_custkey", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round("x", 6).alias("lon"), F.round("y", 6).alias("lat"))


_GROUND = """g AS (SELECT p_partkey AS block, (p_partkey % 7)::INT AS solid, 'a' || (p_partkey % 7) AS source, p_partkey % 5 * 5.0::DOUBLE AS base, p_partkey % 5 * 5.0::DOUBLE + 5 AS top,
  (p_partkey // 5 % 50) * 10.0::DOUBLE AS x0, (p_partkey // 250) * 10.0::DOUBLE AS y0, p_brand AS footprint, 500.0::DOUBLE AS volume FROM part)"""


def ground(spark, d):
    k = F.col("p_partkey")
    x, y = F.floor(k / 5) % 50 * 10.0, F.floor(k / 250) * 10.0
    corner = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    g = table(spark, d, "part").select(k.alias("block"), (k % 7).cast("int").alias("solid"), F.concat(F.lit("a"), k % 7).alias("source"), (k % 5 * 5.0).alias("base"), (k % 5 * 5.0 + 5).alias("top"), x.alias("x0"), y.alias("y0"), F.col("p_brand").alias("footprint"), F.lit(100.0).alias("area"), F.lit(500.0).alias("volume"), F.array(corner(0, 0), corner(10, 0), corner(10, 10), corner(0, 10)).alias("outline"))
    return g


@query(f"""WITH {_GROUND}, r AS (SELECT block AS ref, CASE WHEN block % 11 = 0 THEN 99 ELSE solid END AS solid, CASE WHEN block % 13 = 0 THEN 'old' ELSE source END AS source, CASE WHEN block % 17 = 0 THEN base + 1 ELSE base END AS base,
  CASE WHEN block % 19 = 0 THEN top + 1 ELSE top END AS top, x0 + 3 + CASE WHEN block % 23 = 0 THEN 100000 ELSE 0 END AS x, y0 + 4 AS y, CASE WHEN block % 29 = 0 THEN 'other' ELSE footprint END AS footprint,
  CASE WHEN block % 31 = 0 THEN 501.0 WHEN block % 37 <> 0 THEN 500.0 END AS volume FROM g),
s AS (SELECT solid, arg_min(source, block) AS source FROM g GROUP BY solid),
b AS (SELECT solid, base, arg_min(top, block) AS top FROM g GROUP BY solid, base),
j AS (SELECT r.*, s.source AS now_source, b.top AS now_top, g.block, g.footprint AS now_footprint, g.volume AS now_volume FROM r LEFT JOIN s ON s.solid = r.solid LEFT JOIN b ON b.solid = r.solid AND b.base = r.base
  LEFT JOIN g ON g.solid = r.solid AND g.base = r.base AND g.top = r.top AND r.x > g.x0 AND r.x < g.x0 + 10 AND r.y > g.y0 AND r.y < g.y0 + 10),
t AS (SELECT *, CASE WHEN now_source IS NULL THEN 'solid missing' WHEN now_source <> source THEN 'source changed' WHEN now_top IS NULL THEN 'flitch missing' WHEN block IS NULL AND now_top <> top THEN 'flitch top changed' WHEN block IS NULL THEN 'ground missing'
  WHEN now_footprint <> footprint THEN 'ground changed' WHEN now_volume IS DISTINCT FROM volume THEN 'volume changed' ELSE 'resolved' END AS status FROM j)
SELECT ref, status, CASE WHEN status = 'resolved' THEN block END AS block, CASE status WHEN 'flitch top changed' THEN top WHEN 'ground changed' THEN 100.0 WHEN 'volume changed' THEN volume END::DOUBLE AS was,
  CASE status WHEN 'flitch top changed' THEN now_top WHEN 'ground changed' THEN 100.0 WHEN 'volume changed' THEN now_volume END::DOUBLE AS now FROM t""")
def resolved_references(spark, d):
    """Every block as it was, a few of them changed in one way, against the present ground."""
    g = ground(spark, d)
    k = F.col("block")
    was = lambda n, other, column: F.when(k % n == 0, other).otherwise(F.col(column)).alias(column)
    refs = g.select(k.alias("ref"), was(11, F.lit(99), "solid"), was(13, F.lit("old"), "source"), was(17, F.col("base") + 1, "base"), was(19, F.col("top") + 1, "top"), (F.col("x0") + 3 + F.when(k % 23 == 0, 100_000.0).otherwise(0.0)).alias("x"), (F.col("y0") + 4).alias("y"), was(29, F.lit("other"), "footprint"), "area", F.when(k % 31 == 0, 501.0).when(k % 37 != 0, 500.0).alias("volume"))
    return ID.resolve(refs, g, 40.0)


@query(f"""WITH {_GROUND}, o AS (SELECT block, solid % 2 AS solid, x0, x0 + 10 AS x1, y0, y0 + 10 AS y1, base AS z0, top AS z1 FROM g),
n AS (SELECT s_suppkey AS block, (s_suppkey % 2)::INT AS solid, s_suppkey * 37 % 480 + 0.5::DOUBLE AS x0, s_suppkey * 37 % 480 + 13.5::DOUBLE AS x1, s_suppkey % 75 + 0.25::DOUBLE AS y0, s_suppkey % 75 + 12.0::DOUBLE AS y1, s_suppkey % 4 * 4.0::DOUBLE AS z0, s_suppkey % 4 * 4.0::DOUBLE + 7 AS z1 FROM supplier),
j AS (SELECT n.block, o.block AS old, (least(o.x1, n.x1) - greatest(o.x0, n.x0)) * (least(o.y1, n.y1) - greatest(o.y0, n.y0)) * (least(o.z1, n.z1) - greatest(o.z0, n.z0)) AS v, (n.x1 - n.x0) * (n.y1 - n.y0) * (n.z1 - n.z0) AS whole
  FROM o JOIN n ON o.solid = n.solid AND o.x0 < n.x1 AND n.x0 < o.x1 AND o.y0 < n.y1 AND n.y0 < o.y1 AND o.z0 < n.z1 AND n.z0 < o.z1)
SELECT block, old, round(v / whole, 7) AS share FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY round(v, 6) DESC, old) AS nth FROM j) WHERE nth = 1""")
def block_heirs(spark, d):
    g = ground(spark, d)
    old = g.select("block", (F.col("solid") % 2).alias("solid"), "x0", (F.col("x0") + 10).alias("x1"), "y0", (F.col("y0") + 10).alias("y1"), F.col("base").alias("z0"), F.col("top").alias("z1"))
    s = F.col("s_suppkey")
    new = table(spark, d, "supplier").select(s.alias("block"), (s % 2).cast("int").alias("solid"), (s * 37 % 480 + 0.5).alias("x0"), (s * 37 % 480 + 13.5).alias("x1"), (s % 75 + 0.25).alias("y0"), (s % 75 + 12.0).alias("y1"), (s % 4 * 4.0).alias("z0"), (s % 4 * 4.0 + 7).alias("z1"))
    return ID.heirs(old, new, 25.0).select("block", "old", F.round("share", 7).alias("share"))


@query("""SELECT 'C' || c_nationkey AS hole, count(*) AS readings, round(min(c_custkey), 3)::DOUBLE AS top, round(max(c_custkey), 3)::DOUBLE AS bottom, round(sum(c_acctbal::DOUBLE), 2) AS total
FROM customer WHERE c_nationkey % 5 = 0 GROUP BY 1""")
def hole_lookups(spark, d):
    """Customers by nation as the curve of a hole, written as delimited text, indexed, and a fifth of the holes looked up."""
    path = f"{shared_folder(spark)}/curves-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_nationkey").alias("hole"), F.col("c_custkey").alias("depth"), F.col("c_acctbal").cast("double").alias("gamma"))
    c.repartitionByRange(4, "hole").sortWithinPartitions("hole", "depth").write.option("header", True).csv(path)
    index = RU.index_runs(spark, path, "hole", "depth", split=16_384)
    wanted = [f"C{n}" for n in range(0, 25, 5)]
    got = RU.read_key(index, path, wanted, "hole", "depth", ["gamma"])
    return got.groupBy(F.col("key").alias("hole")).agg(F.count(F.lit(1)).alias("readings"), F.round(F.min("depth"), 3).alias("top"), F.round(F.max("depth"), 3).alias("bottom"), F.round(F.sum("value"), 2).alias("total"))
