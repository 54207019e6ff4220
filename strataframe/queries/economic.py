"""Block economics, nested shells and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import economics as E
from ..operators import ledger as L
from ..operators.profile import blend
from .interval import events
from .registry import query, table

METHODS = [(1, "mill", ["R", "A"], 0.02, 9.0, 0.9, 700.0), (2, "leach", None, 0.01, 0.06, 0.6, 250.0), (3, "sulphide", ["N"], 0.05, 9.0, 0.8, 900.0)]
_SCHEMA = "seq int, method string, accepts array<string>, lo double, hi double, recovery double, cost double"


def blocks(spark, d):
    li = table(spark, d, "lineitem")
    block = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))
    return li.select(block.alias("block"), "l_returnflag", "l_tax", "l_quantity", "l_suppkey")


_BL = "b AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS block, l_returnflag AS c, l_tax AS g, l_quantity AS t, l_suppkey FROM lineitem)"
_W, _P = 1.5, 50000.0
_V = f"""{_BL}, v0 AS (SELECT *, -t * {_W} AS w,
  CASE WHEN c IN ('R', 'A') AND g >= 0.02 AND g < 9 THEN t * (g * 0.9::DOUBLE * {_P} - 700 - {_W}) END AS v1,
  CASE WHEN g >= 0.01 AND g < 0.06 THEN t * (g * 0.6::DOUBLE * {_P} - 250 - {_W}) END AS v2,
  CASE WHEN c IN ('N') AND g >= 0.05 AND g < 9 THEN t * (g * 0.8::DOUBLE * {_P} - 900 - {_W}) END AS v3 FROM b),
v AS (SELECT *, greatest(w, coalesce(v1, w), coalesce(v2, w), coalesce(v3, w)) AS value FROM v0),
x AS (SELECT *, CASE WHEN w = value THEN 'waste' WHEN v1 = value THEN 'mill' WHEN v2 = value THEN 'leach' ELSE 'sulphide' END AS destination FROM v)"""


def valued(spark, d):
    b = blocks(spark, d)
    v = E.method_values(b, spark.createDataFrame(METHODS, _SCHEMA), "block", "l_returnflag", "l_tax", "l_quantity", _W, _P)
    return b, v


@query(f"WITH {_V} SELECT destination, count(*) AS blocks, round(sum(value), 2) AS value FROM x GROUP BY destination")
def method_admission_value(spark, d):
    _, v = valued(spark, d)
    return v.groupBy("destination").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.sum("value"), 2).alias("value"))


_SH = """s AS (SELECT l_suppkey % 8 AS shell, l_returnflag AS dest, l_quantity AS t, round(l_extendedprice * l_discount, 4) AS cost FROM lineitem WHERE NOT (l_suppkey % 8 = 3 AND l_returnflag = 'N')),
p AS (SELECT shell, dest, count(*) AS blocks, sum(t) AS tonnes, sum(cost) AS cost FROM s GROUP BY ALL),
f AS (SELECT shell, dest, coalesce(blocks, 0) AS blocks, coalesce(tonnes, 0) AS tonnes, coalesce(cost, 0) AS cost
  FROM (SELECT DISTINCT shell FROM p) CROSS JOIN (SELECT DISTINCT dest FROM p) LEFT JOIN p USING (shell, dest))"""


def shells(spark, d):
    s = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("shell"), F.col("l_returnflag").alias("dest"), "l_quantity", F.round(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("cost"))
    s = s.where("NOT (shell = 3 AND dest = 'N')")
    return E.shell_report(s, "shell", "dest", {"tonnes": F.sum("l_quantity"), "cost": F.sum("cost")})


@query(f"WITH {_SH} SELECT shell, dest, blocks, tonnes, round(cost, 2) AS cost FROM f")
def shell_report_incremental(spark, d):
    return shells(spark, d).select("shell", "dest", "blocks", "tonnes", F.round("cost", 2).alias("cost"))


@query(f"""WITH {_SH} SELECT shell, dest, (sum(blocks) OVER w)::BIGINT AS blocks, sum(tonnes) OVER w AS tonnes, round(sum(cost) OVER w, 2) AS cost FROM f
WINDOW w AS (PARTITION BY dest ORDER BY shell)""")
def shell_report_cumulative(spark, d):
    return shells(spark, d).select("shell", "dest", F.col("cum_blocks").alias("blocks"), F.col("cum_tonnes").alias("tonnes"), F.round("cum_cost", 2).alias("cost"))


@query(f"WITH {_SH} SELECT dest, sum(blocks)::BIGINT AS blocks, sum(tonnes) AS tonnes FROM f WHERE shell > 2 AND shell <= 5 GROUP BY dest")
def shell_pushback(spark, d):
    return E.pushback(shells(spark, d), "shell", "dest", 2, 5, ["blocks", "tonnes"])


@query(f"""WITH {_SH} SELECT shell, sum(tonnes) FILTER (dest = 'R') AS ore, sum(tonnes) FILTER (dest <> 'R') AS waste,
  round(CASE WHEN sum(tonnes) FILTER (dest = 'R') <> 0 THEN sum(tonnes) FILTER (dest <> 'R') / sum(tonnes) FILTER (dest = 'R') END, 6) AS strip FROM f GROUP BY shell""")
def strip_ratio(spark, d):
    ore, waste = F.sum(F.when(F.col("dest") == "R", F.col("tonnes"))), F.sum(F.when(F.col("dest") != "R", F.col("tonnes")))
    return shells(spark, d).groupBy("shell").agg(ore.alias("ore"), waste.alias("waste"), F.round(E.ratio(waste, ore), 6).alias("strip"))


@query(f"WITH {_SH} SELECT shell, dest, sum(tonnes) AS tonnes FROM f GROUP BY shell, dest UNION ALL SELECT shell, 'Total', sum(tonnes) FROM f GROUP BY shell")
def report_with_totals(spark, d):
    return E.with_totals(shells(spark, d).select("shell", "dest", "tonnes"), ["shell"], "dest", ["tonnes"])


_LOTS = """e AS (SELECT user_id, event_id, epoch_us(ts) AS us, round(value, 2) AS v, event_type FROM events),
l AS (SELECT user_id, event_id AS lot, v, sum(v) OVER w AS hi, coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM e WHERE event_type <> 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
o AS (SELECT user_id, event_id AS draw, v, sum(v) OVER w AS hi, coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM e WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query(f"""WITH {_LOTS} SELECT l.user_id, lot, draw, round(least(l.hi, o.hi) - greatest(l.lo, o.lo), 2) AS tonnes FROM l JOIN o ON l.user_id = o.user_id AND l.lo < o.hi AND o.lo < l.hi
WHERE least(l.hi, o.hi) - greatest(l.lo, o.lo) > 1e-6""")
def fifo_ledger(spark, d):
    e = events(spark, d).withColumn("v", F.round("value", 2))
    out = L.fifo(e.where("event_type != 'purchase'"), e.where("event_type = 'purchase'"), "user_id", "event_id", "v")
    return out.where("tonnes > 1e-6").withColumn("tonnes", F.round("tonnes", 2))


@query()
def lifo_ledger(spark, d):
    e = events(spark, d).select("user_id", F.col("event_id").alias("order"), (F.col("event_type") == "purchase").cast("int").alias("kind"), F.round("value", 2).alias("amount"))
    return L.lifo(e, "user_id").withColumn("tonnes", F.round("tonnes", 2))


@query("""WITH b AS (SELECT l_orderkey, l_quantity AS t, nullif(l_tax, 0) AS g, l_extendedprice AS m, l_returnflag AS c FROM lineitem)
SELECT l_orderkey, sum(t) AS t, round(CASE WHEN count(g) = count(*) THEN sum(g * t) / sum(t) END + 1.234e-8, 6) AS g, round(sum(m), 2) AS m, CASE WHEN min(c) = max(c) THEN min(c) END AS c FROM b GROUP BY l_orderkey""")
def opening_blend(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("t"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("g"), F.col("l_extendedprice").alias("m"), F.col("l_returnflag").alias("c"))
    out = blend(b, ["l_orderkey"], "t", ["g"], ["m"], ["c"])
    return out.withColumns({"g": F.round(F.col("g") + 1.234e-8, 6), "m": F.round("m", 2)})


@query("""SELECT s_suppkey, round(CASE WHEN s_suppkey % 13 - 4 >= 6 THEN 8.0 WHEN s_suppkey % 13 - 4 >= 2 THEN 17.0 WHEN s_suppkey % 13 - 4 >= -3 THEN 36.0 ELSE 36.0 END, 4)::DOUBLE AS free,
  least(CASE WHEN s_suppkey % 13 - 4 >= 6 THEN 8.0 WHEN s_suppkey % 13 - 4 >= 2 THEN 17.0 ELSE 36.0 END, 30.0, coalesce(nullif(s_suppkey % 3, 0) * 10.0, 30.0))::DOUBLE AS kph FROM supplier""")
def grade_speed(spark, d):
    g = (F.col("s_suppkey") % 13 - 4).cast("double")
    rows = [(-3.0, 36.0), (2.0, 17.0), (6.0, 8.0)]
    limit = F.nullif(F.col("s_suppkey") % 3, F.lit(0)) * 10.0
    return table(spark, d, "supplier").select("s_suppkey", E.speed_at(rows, g, 99.0).alias("free"), E.speed_at(rows, g, 30.0, limit).alias("kph"))


@query("""SELECT p_partkey, round((p_size / 10.0 + 0.2) / (p_partkey % 50 + 1), 8)::DOUBLE AS hours_per_tonne FROM part""")
def truck_coefficients(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(E.truck_hours_per_tonne(F.col("p_size") / 10.0, F.col("p_partkey") % 50 + 1, F.lit(0.2)), 8).alias("hours_per_tonne"))


@query("""WITH b AS (SELECT user_id, epoch_us(ts) AS us, event_id, CASE WHEN event_type = 'purchase' THEN -value * 3 ELSE value END AS c FROM events),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY us, event_id) AS bal, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM b)
SELECT 'negative balance' AS rule, count(*) FILTER (bal < -1e-9) AS violations FROM r UNION ALL SELECT 'time order', count(*) FILTER (us < prev) FROM r UNION ALL SELECT 'rate limit', count(*) FILTER (us - prev < 60000000) FROM r""")
def schedule_replay_checks(spark, d):
    from pyspark.sql.window import Window

    c = F.when(F.col("event_type") == "purchase", -F.col("value") * 3).otherwise(F.col("value"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    r = events(spark, d).withColumn("bal", F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("prev", F.lag("us").over(w))
    counts = r.agg(F.count_if(F.col("bal") < -1e-9).alias("negative balance"), F.count_if(F.col("us") < F.col("prev")).alias("time order"), F.count_if(F.col("us") - F.col("prev") < 60000000).alias("rate limit"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in counts.columns])).alias("x")).select("x.*")
