"""Metrics over block rows: grade l_tax, tonnes l_quantity, categories l_returnflag and l_linestatus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import metrics as M
from .registry import query, table

TONNES = M.Metric("tonnes", "sum", "l_quantity")
GRADE = M.Metric("grade", "weighted", "l_tax", "l_quantity")
BLOCKS = M.Metric("blocks", "sum", 1.0)

def blocks(spark, d):
    """Tax 0 reads as blank and quantity 1 as missing, as no column has nulls."""
    rows = table(spark, d, "lineitem").select("l_tax", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_suppkey", "l_partkey")
    return rows.withColumns({"l_tax": F.nullif(F.col("l_tax"), F.lit(0.0)), "l_quantity": F.when(F.col("l_quantity") != 1, F.col("l_quantity"))})


_B = "SELECT nullif(l_tax, 0) AS g, CASE WHEN l_quantity = 1 THEN NULL ELSE l_quantity END AS t, * FROM lineitem"
_STATS = """round(sum(t), 6) AS tonnes, count(*) FILTER (t IS NULL) AS tonnes_missing, min(t) AS tonnes_min, max(t) AS tonnes_max,
  count(*) FILTER (g IS NOT NULL AND t IS NULL) AS grade_unusable, round(sum(g * t) / sum(t) FILTER (g IS NOT NULL), 6) AS grade,
  count(*) FILTER (g IS NULL) AS grade_missing, min(g) AS grade_min, max(g) AS grade_max"""
_ONES = "round(count(*)::DOUBLE, 6) AS blocks, 0::BIGINT AS blocks_missing, 1.0::DOUBLE AS blocks_min, 1.0::DOUBLE AS blocks_max"


@query(f"WITH b AS ({_B}) SELECT {_STATS}, {_ONES} FROM b")
def reserve_totals(spark, d):
    return M.totals(blocks(spark, d), [TONNES, GRADE, BLOCKS])


@query(f"""WITH b AS ({_B}), u AS (
  SELECT 'all' AS category, NULL AS label, * FROM b UNION ALL
  SELECT 'l_returnflag', l_returnflag, * FROM b UNION ALL SELECT 'l_linestatus', l_linestatus, * FROM b)
SELECT category, label, {_STATS} FROM u GROUP BY category, label""")
def reserve_by_category(spark, d):
    return M.category_totals(blocks(spark, d), [TONNES, GRADE], ["l_returnflag", "l_linestatus"])


@query(f"WITH b AS ({_B}) SELECT l_returnflag, {_STATS} FROM b GROUP BY l_returnflag")
def reserve_merge_partials(spark, d):
    parts = M.partials(blocks(spark, d), [TONNES, GRADE], ["l_returnflag", "l_suppkey"])
    return M.finalise(M.merge(parts, [TONNES, GRADE], ["l_returnflag"]), [TONNES, GRADE], ["l_returnflag"])


@query(f"""WITH b AS ({_B}) SELECT l_suppkey, round(sum(greatest(l_discount * 100 - 5, 0) * 0.25), 4) AS gain,
  count(*) FILTER (l_discount * 100 - 5 < 0) AS negatives FROM b GROUP BY l_suppkey""")
def reserve_prorated(spark, d):
    m = M.Metric("gain", "sum", F.col("l_discount") * 100 - 5)
    parts = M.partials(blocks(spark, d), [m], ["l_suppkey"], share=F.lit(0.25), negatives_as_zero=True)
    return parts.select("l_suppkey", F.round("gain__sum", 4).alias("gain"), F.col("gain__negative").alias("negatives"))


@query("""SELECT p_brand, round(sum(p_retailprice * v) / sum(v), 4) AS density, round(sum(v), 4) AS volume, count(*) AS density_blocks
FROM (SELECT *, p_size * (p_partkey % 7 + 1) * 0.5 AS v FROM part) GROUP BY p_brand""")
def reserve_volume_average(spark, d):
    parts = table(spark, d, "part").withColumn("v", F.col("p_size") * (F.col("p_partkey") % 7 + 1) * 0.5)
    acc = M.partials(parts, [M.Metric("density", "volume", "p_retailprice", "v")], ["p_brand"])
    return acc.select("p_brand", F.round(F.col("density__sum") / F.col("density__weight"), 4).alias("density"), F.round("density__weight", 4).alias("volume"), F.col("density__used").alias("density_blocks"))


@query("""WITH a(i, field, kind, weight) AS (VALUES (0, 'l_tax', 'weighted', 'l_quantity'), (1, 'l_shipmode', 'sum', NULL), (2, 'l_returnflag', 'sum', NULL), (3, 'l_discount', 'weighted', 'l_tax'), (4, 'l_linestatus', 'category', NULL), (5, 'l_tax', 'category', NULL), (6, 'l_discount', 'weighted', NULL), (7, 'l_discount', 'weighted', 'l_none')),
r(i, issue) AS (VALUES (0, NULL), (1, 'ColumnMissing'), (2, 'NotNumeric'), (3, 'WeightIsNoSum'), (4, NULL), (5, 'NotACategory'), (6, 'WeightMissing'), (7, 'WeightColumnMissing'))
SELECT p_partkey, field, issue FROM part JOIN a ON a.i = p_partkey % 8 JOIN r ON r.i = a.i""")
def metric_binding_issues(spark, d):
    """A metric asked for by each part, against the columns of lineitem."""
    columns = dict(table(spark, d, "lineitem").dtypes)
    asked = [("l_tax", "weighted", "l_quantity"), ("l_shipmode", "sum", None), ("l_returnflag", "sum", None), ("l_discount", "weighted", "l_tax"), ("l_linestatus", "category", None), ("l_tax", "category", None), ("l_discount", "weighted", None), ("l_discount", "weighted", "l_none")]
    row = F.element_at(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(k).alias("kind"), F.lit(w).cast("string").alias("weight")) for n, k, w in asked]), (F.col("p_partkey") % 8 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", row.alias("a")).select("p_partkey", "a.*")
    return p.select("p_partkey", "field", M.binding_issues(F.col("field"), F.col("kind"), F.col("weight"), columns, {"l_quantity"}).alias("issue"))


@query("""SELECT l_returnflag, count(*) AS blocks, round(sum(l_extendedprice), 2) AS price FROM lineitem
WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity <> 1 GROUP BY l_returnflag""")
def ore_filter_between(spark, d):
    rows = table(spark, d, "lineitem").where(V.between_any_order(F.col("l_discount"), 0.07, 0.03) & V.usable(F.col("l_quantity"), default=1.0))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


_SENT = "CASE WHEN l_quantity <= 2 THEN -99 WHEN l_quantity <= 4 THEN -999 WHEN l_quantity = 5 THEN 'nan'::DOUBLE WHEN l_quantity = 6 THEN NULL ELSE l_quantity - 40 END"


@query(f"""WITH v AS (SELECT l_linestatus, {_SENT} AS v FROM lineitem)
SELECT l_linestatus, min(v) FILTER (ok) AS lo, max(v) FILTER (ok) AS hi, count(*) FILTER (ok) AS used, count(*) FILTER (NOT ok) AS left_out
FROM (SELECT *, coalesce(v IS NOT NULL AND NOT isnan(v) AND v NOT IN (-99, -999), false) AS ok FROM v) GROUP BY l_linestatus""")
def sentinel_range_profile(spark, d):
    q = F.col("l_quantity")
    v = F.when(q <= 2, F.lit(-99.0)).when(q <= 4, F.lit(-999.0)).when(q == 5, F.lit(float("nan"))).when(q == 6, F.lit(None)).otherwise(q - 40)
    rows = table(spark, d, "lineitem").select("l_linestatus", v.alias("v"))
    ok = V.usable(F.col("v"))
    return rows.groupBy("l_linestatus").agg(F.min(F.when(ok, F.col("v"))).alias("lo"), F.max(F.when(ok, F.col("v"))).alias("hi"), F.count_if(ok).alias("used"), F.count_if(~ok).alias("left_out"))


@query("""SELECT p_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY p_type""")
def category_share(spark, d):
    return M.shares(table(spark, d, "part"), "p_type")


@query("""SELECT p_partkey, p_size, p_retailprice FROM part
WHERE p_size <= 30 AND 10 <= p_size AND p_retailprice <= 1200 AND 950 <= p_retailprice""")
def box_pruned_blocks(spark, d):
    from ..functions.geometry import boxes_meet

    parts = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    at = [F.col("p_size"), F.col("p_retailprice")]
    return parts.where(boxes_meet(at, at, [F.lit(10), F.lit(950.0)], [F.lit(30), F.lit(1200.0)]))


@query("""SELECT p.p_partkey, p.p_name FROM part p WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_discount = 0.1)""")
def row_subset(spark, d):
    chosen = table(spark, d, "lineitem").where("l_quantity >= 49 AND l_discount = 0.1").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(chosen, "p_partkey", "left_semi")


@query("""SELECT p_brand, p_partkey % 5 AS bench, count(*) AS blocks FROM part
WHERE NOT (p_partkey % 5 = 2 AND p_size < 10) GROUP BY p_brand, bench""")
def excluded_faces(spark, d):
    parts = table(spark, d, "part").withColumn("bench", F.col("p_partkey") % 5)
    rules = spark.createDataFrame([(2, 10)], "x_bench long, x_least int")
    kept = parts.join(F.broadcast(rules), (F.col("bench") == F.col("x_bench")) & (F.col("p_size") < F.col("x_least")), "left_anti")
    return kept.groupBy("p_brand", "bench").agg(F.count(F.lit(1)).alias("blocks"))
