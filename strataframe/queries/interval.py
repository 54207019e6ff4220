"""Spans, calendars and step functions: each order digs from its date for a few hours."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as I
from .registry import query, table


#: Shares are often exact halves of the last digit; this keeps rounding off the tie in either engine.
OFF = 0.00123456789


def spans(spark, d, loader="o_custkey % 5"):
    """Hours from 1992-01-01: start by date, 1 to 72 hours long; loader is o_custkey % 5 unless another is given."""
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) * 24.0 + F.col("o_orderkey") % 24
    return table(spark, d, "orders").select("o_orderkey", F.expr(loader).alias("loader"), (F.col("o_custkey") % 7).alias("dest"), start.alias("start"), (start + F.col("o_orderkey") % 72 + 1).alias("end"), F.col("o_totalprice").alias("tonnes"), "o_orderpriority")


_SP = """s AS (SELECT o_orderkey, o_custkey % 5 AS loader, o_custkey % 7 AS dest, o_orderpriority, o_totalprice AS tonnes,
  date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 24.0::DOUBLE + o_orderkey % 24 AS a,
  date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 24.0::DOUBLE + o_orderkey % 24 + o_orderkey % 72 + 1 AS b FROM orders)"""
_DAYS = f"""{_SP}, p AS (SELECT *, unnest(range(floor(a / 24)::BIGINT, greatest(floor(a / 24)::BIGINT, ceil(b / 24)::BIGINT - 1) + 1)) AS period FROM s),
q AS (SELECT *, greatest(floor(a / 24)::BIGINT, ceil(b / 24)::BIGINT - 1) AS last FROM p),
h AS (SELECT *, CASE WHEN period < last THEN tonnes * (least(b, (period + 1) * 24) - greatest(a, period * 24)) / (b - a)
  ELSE tonnes - tonnes * greatest(0, last * 24 - a) / (b - a) END AS share FROM q)"""


@query(f"WITH {_DAYS} SELECT loader, period, round(sum(share) + 0.00123456789, 2) AS tonnes, count(*) AS n FROM h GROUP BY loader, period")
def span_apportion_daily(spark, d):
    out = I.apportion(spans(spark, d), "tonnes", 24.0)
    return out.groupBy("loader", "period").agg(F.round(F.sum("share") + OFF, 2).alias("tonnes"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SP} SELECT o_orderkey, greatest(0, 0) + count(*) AS hours, round(sum(tonnes * (least(b, h + 1) - greatest(a, h)) / (b - a)), 2) AS tonnes
FROM (SELECT *, unnest(range(floor(a)::BIGINT, ceil(b)::BIGINT)) AS h FROM s) GROUP BY o_orderkey""")
def hourly_receipts(spark, d):
    out = I.apportion(spans(spark, d), "tonnes", 1.0)
    return out.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("hours"), F.round(F.sum("share"), 2).alias("tonnes"))


@query(f"""WITH {_DAYS}, t AS (SELECT dest, period, sum(share) AS t FROM h GROUP BY dest, period),
e AS (SELECT max(b) AS e FROM s), spine AS (SELECT dest, unnest(range(0, (SELECT ceil(e / 24)::BIGINT FROM e) + 3)) AS period FROM (SELECT DISTINCT dest FROM s))
SELECT spine.dest, spine.period, CASE WHEN spine.period < (SELECT ceil(e / 24) FROM e) THEN round(coalesce(t, 0) + 0.00123456789, 2) END AS tonnes FROM spine LEFT JOIN t USING (dest, period)""")
def period_totals(spark, d):
    s = spans(spark, d)
    totals = I.apportion(s, "tonnes", 24.0).groupBy("dest", "period").agg(F.sum("share").alias("t"))
    end = s.agg(F.ceil(F.max("end") / 24).alias("n"))
    spine = s.select("dest").distinct().crossJoin(F.broadcast(end)).withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 2)))
    j = spine.join(totals, ["dest", "period"], "left")
    return j.select("dest", "period", F.when(F.col("period") < F.col("n"), F.round(F.coalesce("t", F.lit(0.0)) + OFF, 2)).alias("tonnes"))


@query(f"""WITH {_SP}, p(name, x, y) AS (VALUES ('first', 0.0, 12000.0), ('second', 12000.0, 40000.0), ('all', 0.0, 90000.0))
SELECT name, loader, dest, round(sum(tonnes * (least(b, y) - greatest(a, x)) / (b - a)), 2) AS tonnes, round(sum(least(b, y) - greatest(a, x)), 4) AS hours, count(*) AS movements
FROM s JOIN p ON a < y AND x < b GROUP BY name, loader, dest""")
def movements_report(spark, d):
    periods = spark.createDataFrame([("first", 0.0, 12000.0), ("second", 12000.0, 40000.0), ("all", 0.0, 90000.0)], "name string, r_start double, r_end double")
    j = I.overlap_join(spans(spark, d), periods, 4000.0)
    share = F.col("tonnes") * F.col("overlap") / (F.col("end") - F.col("start"))
    return j.groupBy("name", "loader", "dest").agg(F.round(F.sum(share), 2).alias("tonnes"), F.round(F.sum("overlap"), 4).alias("hours"), F.count(F.lit(1)).alias("movements"))


_WHOLE = """s AS (SELECT o_custkey AS loader, o_orderpriority,
  date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 24.0::DOUBLE + o_orderkey % 24 AS a,
  date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 24.0::DOUBLE + o_orderkey % 24 + o_orderkey % 72 + 1 AS b FROM orders),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY loader ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY loader ORDER BY a, b) AS run FROM m),
i AS (SELECT loader, min(a) AS s, max(b) AS e, count(*) AS n FROM r GROUP BY loader, run)"""


def whole(spark, d):
    """Every order's span, with one loader a customer: fine enough to leave gaps, so no order is left out."""
    return spans(spark, d, "o_custkey")


def time_accounting(s):
    length = F.col("end") - F.col("start")
    by = s.groupBy("loader").agg(*[F.round(F.sum(F.when(F.col("o_orderpriority") == p, length)), 4).alias(n) for n, p in (("urgent", "1-URGENT"), ("low", "5-LOW"))])
    busy = I.covered(s, ["loader"])
    left = 60000 - F.col("hours")
    return by.join(busy, "loader").select("loader", "urgent", "low", F.round("hours", 4).alias("busy"), F.when(left > 1e-6, F.round(left, 4)).otherwise(F.lit(0.0)).alias("no_work"))


@query(f"WITH {_WHOLE} SELECT loader, s AS start, e AS \"end\", n FROM i")
def coalesce_spans(spark, d):
    return I.coalesce_spans(whole(spark, d), ["loader"])


@query(f"WITH {_WHOLE} SELECT * FROM (SELECT loader, lag(e) OVER (PARTITION BY loader ORDER BY s) AS start, s AS \"end\" FROM i) WHERE start IS NOT NULL AND \"end\" - start > 1e-6")
def idle_gaps(spark, d):
    return I.gaps(whole(spark, d), ["loader"])


@query(f"WITH {_WHOLE} SELECT loader, round(sum(e - s), 4) AS hours FROM i GROUP BY loader")
def busy_union_hours(spark, d):
    return I.covered(whole(spark, d), ["loader"]).select("loader", F.round("hours", 4).alias("hours"))


@query(f"""WITH {_WHOLE}, t AS (SELECT loader, sum(e - s) AS busy FROM i GROUP BY loader),
d AS (SELECT loader, sum(b - a) FILTER (o_orderpriority = '1-URGENT') AS urgent, sum(b - a) FILTER (o_orderpriority = '5-LOW') AS low FROM m GROUP BY loader)
SELECT loader, round(urgent, 4) AS urgent, round(low, 4) AS low, round(busy, 4) AS busy, CASE WHEN 60000 - busy > 1e-6 THEN round(60000 - busy, 4) ELSE 0 END AS no_work FROM t JOIN d USING (loader)""")
def loader_time_accounting(spark, d):
    return time_accounting(whole(spark, d))


_EV = "e AS (SELECT user_id, event_id, epoch_us(ts) AS us, value, event_type FROM events)"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", "event_type")


_CHANGE = "CASE WHEN event_type = 'purchase' THEN -value * 2 ELSE value END"


@query(f"""WITH {_EV}, k AS (SELECT user_id, us, sum({_CHANGE}) AS c FROM e GROUP BY user_id, us),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY us) AS r FROM k)
SELECT user_id, us, round(greatest(r, 0), 3) AS balance FROM r""")
def inventory_balance(spark, d):
    e = events(spark, d).withColumn("c", F.when(F.col("event_type") == "purchase", -F.col("value") * 2).otherwise(F.col("value")))
    return I.balance(e, ["user_id"], "us", "c").select("user_id", "us", F.round("balance", 3).alias("balance"))


@query(f"""WITH {_EV}, k AS (SELECT user_id, us, sum({_CHANGE}) AS c FROM e GROUP BY user_id, us),
r AS (SELECT *, greatest(round(sum(c) OVER (PARTITION BY user_id ORDER BY us), 3), 0) AS r FROM k)
SELECT user_id, max(r) AS peak, min(us) FILTER (r = m) AS at FROM (SELECT *, max(r) OVER (PARTITION BY user_id) AS m FROM r) GROUP BY user_id""")
def inventory_peak(spark, d):
    knots = inventory_balance(spark, d)
    return knots.groupBy("user_id").agg(F.max("balance").alias("peak"), F.min_by("us", F.struct(-F.col("balance"), F.col("us"))).alias("at"))


@query(f"""WITH {_SP}, k AS (SELECT loader, a AS tm, 1 AS c FROM s UNION ALL SELECT loader, b, -1 FROM s), g AS (SELECT loader, tm, sum(c) AS c FROM k GROUP BY loader, tm)
SELECT loader, tm AS "at", (sum(c) OVER (PARTITION BY loader ORDER BY tm))::DOUBLE AS rate FROM g""")
def truck_use_steps(spark, d):
    return I.rate_knots(spans(spark, d), ["loader"], F.lit(1.0))


_STEPS = "(SELECT user_id, us, max(value) AS rate FROM e WHERE event_type = 'purchase' GROUP BY user_id, us)"


@query(f"WITH {_EV}, st AS {_STEPS} SELECT e.event_id, coalesce(st.rate, -1) AS rate FROM e ASOF LEFT JOIN st ON e.user_id = st.user_id AND e.us >= st.us")
def asof_rate(spark, d):
    e = events(spark, d)
    steps = e.where("event_type = 'purchase'").select("user_id", F.col("us").alias("since"), F.col("value").alias("rate"))
    return I.asof(e, steps, ["user_id"], "us", "since", ["rate"], {"rate": -1.0}).select("event_id", "rate")


@query("""WITH o AS (SELECT s_suppkey AS loader, s_suppkey % 4 AS period, (s_suppkey % 10) / 10.0::DOUBLE AS availability FROM supplier WHERE s_suppkey % 3 = 0),
sp AS (SELECT s_suppkey AS loader, s_nationkey, unnest(range(4)) AS period FROM supplier)
SELECT loader, period::BIGINT AS period, round(coalesce(o.availability, 0.8 - s_nationkey * 0.01::DOUBLE) * 0.9 * (100 + loader % 7) + 0.0000123, 6) AS rate FROM sp LEFT JOIN o USING (loader, period)""")
def calendar_effective_rate(spark, d):
    s = table(spark, d, "supplier")
    loader = F.col("s_suppkey").alias("loader")
    spine = s.select(loader, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("period"))
    defaults = s.select(loader, (F.lit(0.8) - F.col("s_nationkey") * 0.01).alias("availability"))
    over = s.where("s_suppkey % 3 = 0").select(loader, (F.col("s_suppkey") % 4).alias("period"), (F.col("s_suppkey") % 10 / 10.0).alias("availability"))
    e = I.effective(spine, defaults, over, "loader", "period", ["availability"])
    return e.select("loader", "period", F.round(F.col("availability") * 0.9 * (100 + F.col("loader") % 7) + 0.0000123, 6).alias("rate"))


@query("""WITH o AS (SELECT s_suppkey AS loader, s_suppkey % 6 AS period, (s_suppkey % 5)::DOUBLE AS units FROM supplier WHERE s_suppkey % 2 = 0),
sp AS (SELECT s_suppkey AS loader, 2.0::DOUBLE + s_nationkey % 4 AS units, 10.0::DOUBLE + s_suppkey % 30 AS since, 100.5::DOUBLE + s_suppkey % 40 AS upto, unnest(range(6)) AS period FROM supplier)
SELECT loader, round(sum(greatest(0, least(upto, (period + 1) * 24) - greatest(since, period * 24)) * coalesce(o.units, sp.units) * 0.85), 6) AS truck_hours FROM sp LEFT JOIN o USING (loader, period) GROUP BY loader""")
def available_truck_hours(spark, d):
    s = table(spark, d, "supplier")
    loader = F.col("s_suppkey").alias("loader")
    spine = s.select(loader, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("period"))
    defaults = s.select(loader, (F.lit(2.0) + F.col("s_nationkey") % 4).alias("units"))
    over = s.where("s_suppkey % 2 = 0").select(loader, (F.col("s_suppkey") % 6).alias("period"), (F.col("s_suppkey") % 5).cast("double").alias("units"))
    e = I.effective(spine, defaults, over, "loader", "period", ["units"])
    since, upto = F.lit(10.0) + F.col("loader") % 30, F.lit(100.5) + F.col("loader") % 40
    part = F.greatest(F.lit(0.0), F.least(upto, (F.col("period") + 1) * 24.0) - F.greatest(since, F.col("period") * 24.0))
    return e.groupBy("loader").agg(F.round(F.sum(part * F.col("units") * 0.85), 6).alias("truck_hours"))


@query(f"""WITH {_SP}, t AS (SELECT loader, o_orderkey, a, b FROM s), c AS (SELECT DISTINCT loader, tm FROM (SELECT loader, a AS tm FROM t UNION ALL SELECT loader, b FROM t)),
n AS (SELECT loader, tm, lead(tm) OVER (PARTITION BY loader ORDER BY tm) AS upto FROM c),
w AS (SELECT n.loader, n.tm, n.upto, arg_min(o_orderkey, (b - a) * 1e8 + o_orderkey) AS o FROM n JOIN t ON n.loader = t.loader AND a <= n.tm AND b >= n.upto WHERE n.upto IS NOT NULL GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(o) OVER q = o AND lag(upto) OVER q = tm THEN 0 ELSE 1 END AS new FROM w WINDOW q AS (PARTITION BY loader ORDER BY tm)),
g AS (SELECT *, sum(new) OVER (PARTITION BY loader ORDER BY tm) AS run FROM f)
SELECT loader, min(tm) AS start, max(upto) AS "end", any_value(o) AS winner FROM g GROUP BY loader, run""")
def elementary_sweep_winner(spark, d):
    return I.elementary_winner(spans(spark, d), ["loader"], "o_orderkey")


@query(f"""WITH {_SP}, k AS (SELECT loader, a AS tm FROM s UNION SELECT loader, b FROM s)
SELECT * FROM (SELECT loader, tm AS start, lead(tm) OVER (PARTITION BY loader ORDER BY tm) AS "end" FROM k) WHERE "end" IS NOT NULL""")
def build_intervals(spark, d):
    return I.build_intervals(spans(spark, d).select("loader", F.explode(F.array("start", "end")).alias("at")), keys=["loader"])


@query("""WITH r AS (SELECT p_partkey, (p_partkey % 50)::DOUBLE AS start, p_size / 4.0::DOUBLE AS length, CASE WHEN p_partkey % 3 <> 0 THEN 24.0::DOUBLE * (1 + p_partkey % 4) END AS every, CASE WHEN p_partkey % 4 = 1 THEN 100.0::DOUBLE + p_size END AS until FROM part)
SELECT p_partkey, start + k * coalesce(every, 0) AS start, least(start + k * coalesce(every, 0) + length, 240.0)::DOUBLE AS "end"
FROM (SELECT *, unnest(range(0, CASE WHEN coalesce(every, 0) > 0 THEN greatest(0, ceil((least(coalesce(until, 240), 240) - start) / every) - 1) ELSE 0 END::BIGINT + 1)) AS k FROM r WHERE start < least(coalesce(until, 240), 240))""")
def recurring_delays(spark, d):
    k = F.col("p_partkey")
    rules = table(spark, d, "part").select("p_partkey", (k % 50).cast("double").alias("start"), (F.col("p_size") / 4.0).alias("length"), F.when(k % 3 != 0, F.lit(24.0) * (1 + k % 4)).alias("every"), F.when(k % 4 == 1, F.lit(100.0) + F.col("p_size")).alias("until"))
    return I.occurrences(rules, 240.0).select("p_partkey", "start", "end")


@query(f"""WITH {_SP}, c(tm) AS (VALUES (5000.0), (20000.0), (20010.0)), t AS (SELECT o_orderkey, a, b FROM s),
k AS (SELECT o_orderkey, a AS tm FROM t UNION SELECT o_orderkey, b FROM t UNION SELECT o_orderkey, tm FROM t JOIN c ON tm > a AND tm < b)
SELECT * FROM (SELECT o_orderkey, tm AS start, lead(tm) OVER (PARTITION BY o_orderkey ORDER BY tm) AS "end" FROM k) WHERE "end" IS NOT NULL""")
def split_spans_at_cuts(spark, d):
    s = spans(spark, d).select("o_orderkey", "start", "end").withColumn("one", F.lit(1))
    cuts = spark.createDataFrame([(1, 5000.0), (1, 20000.0), (1, 20010.0)], "one int, at double")
    return I.split_at(s, cuts, ["one"]).select("o_orderkey", "start", "end")


@query(f"""WITH {_EV}, r AS (SELECT user_id, us, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM e)
SELECT user_id, event_id, event_type FROM r WHERE was IS NULL OR was <> event_type""")
def rate_change_points(spark, d):
    e = events(spark, d).withColumn("at", F.struct("us", "event_id"))
    return I.change_points(e, ["user_id"], "at", "event_type").select("user_id", "event_id", "event_type")


@query(f"""WITH {_DAYS}, t AS (SELECT dest, period, sum(share) AS t FROM h GROUP BY dest, period)
SELECT dest, period, round(sum(t) OVER (PARTITION BY dest ORDER BY period) + 0.00123456789, 2) AS received FROM t""")
def running_receipts(spark, d):
    totals = I.apportion(spans(spark, d), "tonnes", 24.0).groupBy("dest", "period").agg(F.sum("share").alias("t"))
    w = Window.partitionBy("dest").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return totals.select("dest", "period", F.round(F.sum("t").over(w) + OFF, 2).alias("received"))


@query(f"""WITH {_SP} SELECT loader, dest, round(sum(tonnes), 2) AS tonnes, round(sum(tonnes * (b - a)) / sum(tonnes), 4) AS mean_hours,
  round(sum(tonnes * dest) / sum(tonnes), 4) AS mean_dest FROM s GROUP BY loader, dest""")
def haul_summary(spark, d):
    s = spans(spark, d)
    t = F.sum("tonnes")
    return s.groupBy("loader", "dest").agg(F.round(t, 2).alias("tonnes"), F.round(F.sum(F.col("tonnes") * (F.col("end") - F.col("start"))) / t, 4).alias("mean_hours"), F.round(F.sum(F.col("tonnes") * F.col("dest")) / t, 4).alias("mean_dest"))


@query(f"""WITH {_DAYS}, t AS (SELECT dest, period, sum(share) AS t, sum(share * (o_orderkey % 10)) AS g FROM h GROUP BY dest, period)
SELECT dest, period, round(greatest(0, 4.2 - g / t) * 2.0 + greatest(0, g / t - 4.8) * 2.0, 4) AS penalty FROM t WHERE t > 0""")
def grade_target_penalty(spark, d):
    from ..functions.maths import hinge

    a = I.apportion(spans(spark, d), "tonnes", 24.0)
    t = a.groupBy("dest", "period").agg(F.sum("share").alias("t"), F.sum(F.col("share") * (F.col("o_orderkey") % 10)).alias("g")).where("t > 0")
    return t.select("dest", "period", F.round(hinge(F.col("g") / F.col("t"), 4.2, 4.8, 2.0), 4).alias("penalty"))
