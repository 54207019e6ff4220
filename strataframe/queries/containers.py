"""Project containers written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder
from ..sources import project as PR
from .registry import query, table

#: The model's first axis points north and its second one west; parents are 10 by 10 by 5.
ORIENT = {"origin": [1000.0, 2000.0, -50.0], "u": [0.0, 1.0, 0.0], "v": [-1.0, 0.0, 0.0], "w": [0.0, 0.0, 1.0]}


@query("""WITH b AS (SELECT *, p_partkey % 40 AS i, p_partkey // 40 % 40 AS j, p_partkey // 1600 AS k, 0.25::DOUBLE + p_size / 100.0::DOUBLE AS top FROM part)
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS "row", i::BIGINT AS i, j::BIGINT AS j, k::BIGINT AS k, round(i * 10 + 5.0::DOUBLE, 6) AS x0, round(k * 5 + 5 * top, 6) AS z1,
  round(1000 - (j * 10 + 5.0::DOUBLE), 6) AS x, round(2000 + i * 10 + 7.5::DOUBLE, 6) AS y, round(-50 + k * 5 + 2.5 * top, 6) AS z, p_brand AS brand, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS grade FROM b""")
def container_blocks(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part").select("*", (k % 40).alias("parent_u"), (F.floor(k / 40) % 40).alias("parent_v"), F.floor(k / 1600).alias("parent_w"))
    corners = {"corner_min_u": F.lit(0.5), "corner_min_v": F.lit(0.0), "corner_min_w": F.lit(0.0), "corner_max_u": F.lit(1.0), "corner_max_v": F.lit(1.0), "corner_max_w": F.lit(0.25) + F.col("p_size") / 100.0}
    blocks = part.withColumns(corners).withColumn("brand", F.col("p_brand")).withColumn("grade", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice").cast("double"))).orderBy("p_partkey")
    path = f"{shared_folder(spark)}/container-{uuid.uuid4().hex}"
    top = part.agg(F.max("parent_w")).first()[0]
    grid = {"type": "Regular", "size": [10.0, 10.0, 5.0], "count": [40, 40, int(top or 0) + 1]}
    element = PR.write_blocks(blocks, path, "parts", ORIENT, grid, ["brand", "grade"])
    PR.write_index(path, {"name": "parts", "elements": [element]})
    got = PR.read_blocks(spark, path, "parts")
    return got.select("row", "i", "j", "k", *[F.round(c, 6).alias(c) for c in ("x0", "z1", "x", "y", "z")], "brand", "grade")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal::DOUBLE AS z, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
SELECT a.c_nationkey AS hole, count(*) AS segments, round(sum(abs(b.z - a.z) + 1.0), 4) AS climb, round(max(b.z), 4) AS top FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND b.n = a.n + 1 GROUP BY 1""")
def container_traces(spark, d):
    """Customers of a nation as the points of a trace, in order; segments join neighbours."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("hole"), F.col("c_custkey"), F.col("c_acctbal").cast("double").alias("z"))
    order = Window.partitionBy("hole").orderBy("c_custkey")
    sizes = c.groupBy("hole").count()
    starts = sizes.select(F.col("hole").alias("of"), (F.sum("count").over(Window.orderBy("hole")) - F.col("count")).alias("start"))
    points = c.withColumn("n", F.row_number().over(order)).join(starts, F.col("hole") == F.col("of")).withColumn("at", F.col("start") + F.col("n") - 1)
    points = points.select("hole", "n", "at", F.col("hole").cast("double").alias("x"), F.col("n").cast("double").alias("y"), "z")
    path = f"{shared_folder(spark)}/container-{uuid.uuid4().hex}"
    segments = points.where("n > 1").select((F.col("at") - 1).alias("a"), F.col("at").alias("b"), F.col("hole").cast("string").alias("hole"))
    element = PR.write_cornered(points.orderBy("at"), segments.orderBy("b"), path, "traces", ["hole"])
    PR.write_index(path, {"name": "traces", "elements": [element]})
    got = PR.read_lines(spark, path, "traces")
    length = F.abs(F.col("bz") - F.col("az")) + F.abs(F.col("by") - F.col("ay"))
    return got.groupBy(F.col("hole").cast("bigint").alias("hole")).agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum(length), 4).alias("climb"), F.round(F.max("bz"), 4).alias("top"))
