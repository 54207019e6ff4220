"""The reports of a schedule whose deliveries are the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import reports as R
from .registry import query, table

#: Hours of the horizon, and what keeps rounding off ties.
HORIZON, OFF = 24.0 * 90, 0.00123456789

_D = """d AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'pile' || o_custkey % 4 ELSE 'pit' || o_custkey % 6 END AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'reclaim' ELSE 'dig' END AS activity,
  CASE o_orderkey % 5 WHEN 0 THEN 'dump' || o_custkey % 3 WHEN 1 THEN 'pile' || (o_custkey + 1) % 4 ELSE 'mill' || o_custkey % 2 END AS destination FROM (SELECT o_orderkey, o_custkey, o_totalprice AS tonnes, o_orderkey * 7 % 2000 + 0.5::DOUBLE AS a,
  o_orderkey * 7 % 2000 + 0.5::DOUBLE + o_orderkey % 61 AS b, 'agent' || o_custkey % 5 AS agent, 'truck' || o_orderkey % 3 AS truck, o_totalprice * (o_custkey % 9) / 100 AS au, o_totalprice / 220.0::DOUBLE AS truck_hours, o_totalprice * (o_custkey % 4) AS value,
  0.01::DOUBLE * (1 + o_orderkey % 3) AS spot_h, 0.05::DOUBLE AS load_h, 0.1::DOUBLE + o_custkey % 7 * 0.01 AS loaded_h, 0.02::DOUBLE AS dump_h, 0.08::DOUBLE + o_custkey % 5 * 0.01 AS empty_h, 2.0::DOUBLE + o_custkey % 11 AS loaded_km, (o_custkey % 13)::DOUBLE AS rise_m FROM orders)),
p AS (SELECT *, (least(b, (period + 1) * {h}) - greatest(a, period * {h})) AS inside FROM (SELECT *, unnest(range(floor(a / {h})::BIGINT, ceil(b / {h})::BIGINT)) AS period FROM d WHERE b > a)),
s AS (SELECT *, inside / (b - a) AS share FROM p)"""
_DAY, _WEEK = _D.replace("{h}", "24"), _D.replace("{h}", "168")


def deliveries(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda text, n: F.concat(F.lit(text), n)
    start = o * 7 % 2000 + 0.5
    number = lambda x: x.cast("double")
    return table(spark, d, "orders").select(
        o, start.alias("start"), (start + o % 61).alias("end"), name("agent", c % 5).alias("agent"), F.when(o % 3 == 0, "reclaim").otherwise("dig").alias("activity"),
        F.when(o % 3 == 0, name("pile", c % 4)).otherwise(name("pit", c % 6)).alias("source"), F.when(o % 5 == 0, name("dump", c % 3)).when(o % 5 == 1, name("pile", (c + 1) % 4)).otherwise(name("mill", c % 2)).alias("destination"),
        name("truck", o % 3).alias("truck"), F.col("o_totalprice").alias("tonnes"), (F.col("o_totalprice") * (c % 9) / 100).alias("au"), (F.col("o_totalprice") / 220.0).alias("truck_hours"), (F.col("o_totalprice") * (c % 4)).alias("value"),
        (F.lit(0.01) * (1 + o % 3)).alias("spot_h"), F.lit(0.05).alias("load_h"), (F.lit(0.1) + c % 7 * 0.01).alias("loaded_h"), F.lit(0.02).alias("dump_h"), (F.lit(0.08) + c % 5 * 0.01).alias("empty_h"), (F.lit(2.0) + c % 11).alias("loaded_km"), number(c % 13).alias("rise_m"),
    )


def rounded(df, digits: int = 3):
    return df.select(*[F.round(F.col(c) + OFF, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


_r = lambda x, name: f"round({x} + {OFF}, 3) AS {name}"


@query(f"""WITH {_WEEK} SELECT period, agent, activity, source, destination, {_r("sum(tonnes * share)", "tonnes")}, {_r("sum(truck_hours * share)", "truck_hours")}, {_r("sum(value * share)", "value")},
CASE WHEN sum(tonnes * share) > 1e-6 THEN {_r("sum(au * share) / sum(tonnes * share)", "au").removesuffix(" AS au")} END AS au FROM s GROUP BY ALL""")
def weekly_movements(spark, d):
    return rounded(R.movements(deliveries(spark, d), "week", ["au"]))


_PARTS = ("spot_h", "load_h", "loaded_h", "dump_h", "empty_h")


@query(f"""WITH {_DAY}, g AS (SELECT period, agent, activity, source, destination, sum(tonnes * share) AS t, {", ".join(f"sum({c} * tonnes * share) AS {c}" for c in (*_PARTS, "loaded_km", "rise_m"))} FROM s GROUP BY ALL)
SELECT period, agent, activity, source, destination, {_r("t", "tonnes")}, {", ".join(_r(f"{c} / t * 60", c.removesuffix("_h") + "_min") for c in _PARTS)}, {_r(f"({' + '.join(_PARTS)}) / t * 60", "cycle_min")}, {_r("loaded_km / t", "km")}, {_r("rise_m / t", "rise")}, {_r("loaded_km", "tonne_km")} FROM g""")
def daily_haulage(spark, d):
    return rounded(R.haulage(deliveries(spark, d), "day"))


@query(f"""WITH {_WEEK}, rates AS (SELECT 'agent' || i AS agent, i, 900.0::DOUBLE + i * 50 AS dig_tph, 700.0::DOUBLE AS reclaim_tph FROM range(7) t(i)),
dl AS (SELECT 'agent' || p_partkey % 7 AS agent, p_partkey * 11 % 2100 * 1.0::DOUBLE AS a, p_partkey * 11 % 2100 + 1.0::DOUBLE + p_partkey % 3 AS b FROM part),
cov AS (SELECT agent, a, b FROM d WHERE b > a UNION ALL SELECT agent, a, b FROM dl), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY agent ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM cov),
u AS (SELECT agent, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY agent ORDER BY a, b) AS run FROM m) GROUP BY agent, run),
ix AS (SELECT agent, CASE WHEN floor(a)::BIGINT % 2 = 0 THEN 'no_route' ELSE 'no_trucks' END AS reason, b AS ia, b + 0.25::DOUBLE AS ib FROM u),
per AS (SELECT unnest(range(0, 13)) AS period), cut AS (SELECT agent, period, sum(least(b, (period + 1) * 168) - greatest(a, period * 168)) AS h FROM u JOIN per ON a < (period + 1) * 168 AND b > period * 168 GROUP BY ALL),
dc AS (SELECT agent, period, sum(least(b, (period + 1) * 168) - greatest(a, period * 168)) AS h FROM dl JOIN per ON a < (period + 1) * 168 AND b > period * 168 GROUP BY ALL),
ic AS (SELECT agent, period, sum(least(ib, (period + 1) * 168) - greatest(ia, period * 168)) FILTER (reason = 'no_route') AS no_route, sum(least(ib, (period + 1) * 168) - greatest(ia, period * 168)) FILTER (reason = 'no_trucks') AS no_trucks FROM ix JOIN per ON ia < (period + 1) * 168 AND ib > period * 168 GROUP BY ALL),
w AS (SELECT agent, period, sum(tonnes * share) FILTER (activity = 'dig') AS dug, sum(tonnes * share) FILTER (activity = 'reclaim') AS reclaimed FROM s GROUP BY ALL)
SELECT rates.agent, per.period, {_r("coalesce(dug, 0)", "dug")}, {_r("coalesce(reclaimed, 0)", "reclaimed")}, {_r("coalesce(dug, 0) / dig_tph", "dig_h")}, {_r("coalesce(reclaimed, 0) / reclaim_tph", "reclaim_h")}, {_r("coalesce(dc.h, 0)", "delay_h")},
{_r("coalesce(no_route, 0)", "no_route")}, {_r("coalesce(no_trucks, 0)", "no_trucks")}, {_r(f"CASE WHEN least({HORIZON}, (per.period + 1) * 168) - per.period * 168 - coalesce(cut.h, 0) - coalesce(no_route, 0) - coalesce(no_trucks, 0) > 1e-6 THEN least({HORIZON}, (per.period + 1) * 168) - per.period * 168 - coalesce(cut.h, 0) - coalesce(no_route, 0) - coalesce(no_trucks, 0) ELSE 0 END", "no_work")}
FROM rates CROSS JOIN per LEFT JOIN w USING (agent, period) LEFT JOIN cut USING (agent, period) LEFT JOIN dc USING (agent, period) LEFT JOIN ic USING (agent, period)""")
def loader_hours(spark, d):
    """After each stretch of work or delay a quarter of an hour is idle for one of two reasons."""
    work = deliveries(spark, d)
    k = F.col("p_partkey")
    delays = table(spark, d, "part").select(F.concat(F.lit("agent"), k % 7).alias("agent"), (k * 11 % 2100 * 1.0).alias("start"), (k * 11 % 2100 + 1.0 + k % 3).alias("end"))
    busy = I.coalesce_spans(work.select("agent", "start", "end").unionByName(delays).where("start < end"), ["agent"])
    idle = busy.select("agent", F.col("end").alias("start"), (F.col("end") + 0.25).alias("end"), F.when(F.floor("start") % 2 == 0, "no_route").otherwise("no_trucks").alias("reason"))
    rates = spark.range(7).select(F.concat(F.lit("agent"), "id").alias("agent"), (F.lit(900.0) + F.col("id") * 50).alias("dig_tph"), F.lit(700.0).alias("reclaim_tph"))
    return rounded(R.loaders(work, delays, idle, rates, HORIZON, "week", ["no_route", "no_trucks"]))


@query(f"""WITH {_WEEK} SELECT period, 'rig' || o_custkey % 4 AS agent, CASE WHEN o_custkey % 2 = 0 THEN 'drill' ELSE 'charge' END AS activity, {_r("sum(tonnes / 100 * share)", "quantity")}, {_r("sum(inside)", "hours")} FROM s GROUP BY ALL""")
def drill_blast_hours(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = k * 7 % 2000 + 0.5
    work = o.select(start.alias("start"), (start + k % 61).alias("end"), F.concat(F.lit("rig"), c % 4).alias("agent"), F.when(c % 2 == 0, "drill").otherwise("charge").alias("activity"), (F.col("o_totalprice") / 100).alias("quantity"))
    return rounded(R.drill_blast(work, "week"))


@query(f"""WITH {_WEEK}, pl AS (SELECT 'pile' || i AS pile, 1e9::DOUBLE + i AS opening, 2e7::DOUBLE AS au FROM range(5) t(i)), sp AS (SELECT *, unnest(range(0, 13)) AS period FROM pl),
i AS (SELECT destination AS pile, period, sum(tonnes * share) AS t, sum(au * share) AS au FROM s GROUP BY ALL), o AS (SELECT source AS pile, period, sum(tonnes * share) AS t, sum(au * share) AS au FROM s GROUP BY ALL),
j AS (SELECT sp.pile, sp.period, sp.opening, sp.au AS start, coalesce(i.t, 0) AS rec, coalesce(o.t, 0) AS rcl, coalesce(i.au, 0) - coalesce(o.au, 0) AS qa FROM sp LEFT JOIN i USING (pile, period) LEFT JOIN o USING (pile, period)),
c AS (SELECT *, opening + sum(rec - rcl) OVER w AS closing, start + sum(qa) OVER w AS q FROM j WINDOW w AS (PARTITION BY pile ORDER BY period))
SELECT pile, period, round(closing - rec + rcl, 1) AS opening, round(rec, 1) AS received, round(rcl, 1) AS reclaimed, round(closing, 1) AS closing, CASE WHEN closing > 1e-6 THEN round(q / closing, 6) END AS au FROM c""")
def stockpile_balances(spark, d):
    piles = spark.range(5).select(F.concat(F.lit("pile"), "id").alias("pile"), (F.lit(1e9) + F.col("id")).alias("opening"), F.lit(2e7).alias("au"))
    out = R.stockpiles(deliveries(spark, d), piles, 13, "week", ["au"])
    return out.select("pile", "period", *[F.round(c, 1).alias(c) for c in ("opening", "received", "reclaimed", "closing")], F.round("au", 6).alias("au"))


@query(f"""WITH {_WEEK}, l AS (SELECT 'mill' || i AS crusher, day, CASE WHEN day % 30 <> 5 THEN 1000.0::DOUBLE + day END AS lim FROM range(3) t(i), range(91) u(day)),
b AS (SELECT crusher, day // 7 AS period, CASE WHEN count(lim) = 7 THEN sum(lim) END AS lim FROM l GROUP BY ALL), c AS (SELECT 'mill' || s_suppkey % 3 AS crusher, s_suppkey % 91 // 7 AS period, sum(s_acctbal) AS penalty FROM supplier GROUP BY ALL),
g AS (SELECT destination AS crusher, period, sum(tonnes * share) AS t, sum(au * share) AS au FROM s GROUP BY ALL)
SELECT b.crusher, b.period, {_r("coalesce(t, 0)", "received")}, {_r("lim", '"limit"')}, CASE WHEN t > 1e-6 THEN {_r("au / t", "au").removesuffix(" AS au")} END AS au, {_r("coalesce(penalty, 0)", "penalty")} FROM b LEFT JOIN g USING (crusher, period) LEFT JOIN c USING (crusher, period)""")
def crusher_report(spark, d):
    days = spark.range(91).withColumnRenamed("id", "day")
    limits = spark.range(3).crossJoin(days).select(F.concat(F.lit("mill"), "id").alias("crusher"), "day", F.when(F.col("day") % 30 != 5, F.lit(1000.0) + F.col("day")).alias("limit"))
    k = F.col("s_suppkey")
    penalties = table(spark, d, "supplier").select(F.concat(F.lit("mill"), k % 3).alias("crusher"), (k % 91).alias("day"), F.col("s_acctbal").alias("penalty"))
    return rounded(R.crushers(deliveries(spark, d), limits, penalties, 13, "week", ["au"]))


@query(f"""WITH {_DAY}, n AS (SELECT 'dump' || i AS dump, unnest(range(0, 90)) AS period FROM range(4) t(i)), g AS (SELECT destination AS dump, period, sum(tonnes * share) AS t FROM s GROUP BY ALL)
SELECT dump, period, {_r("coalesce(t, 0)", "received")}, {_r("sum(coalesce(t, 0)) OVER (PARTITION BY dump ORDER BY period)", "to_date")} FROM n LEFT JOIN g USING (dump, period)""")
def dump_report(spark, d):
    names = spark.range(4).select(F.concat(F.lit("dump"), "id").alias("dump"))
    return rounded(R.dumps(deliveries(spark, d), names, 90, "day"))


@query(f"""WITH {_WEEK}, f AS (SELECT 'truck' || i AS truck, day // 7 AS period, sum((4.0::DOUBLE + i + day % 3) * greatest(0, least({HORIZON}, (day + 1) * 24) - day * 24)) AS available FROM range(4) t(i), range(95) u(day) GROUP BY ALL),
g AS (SELECT truck, period, sum(tonnes * share) AS t, sum(truck_hours * share) AS used, sum(({" + ".join(_PARTS)}) * tonnes * share) AS c, sum(loaded_km * tonnes * share) AS km, sum(rise_m * tonnes * share) AS rise FROM s GROUP BY ALL)
SELECT truck, period, {_r("coalesce(used, 0)", "used")}, {_r("available", "available")}, {_r("coalesce(c / t * 60, 0)", "cycle_min")}, {_r("coalesce(km / t, 0)", "km")}, {_r("coalesce(rise / t, 0)", "rise")}, {_r("coalesce(km, 0)", "tonne_km")} FROM f LEFT JOIN g USING (truck, period)""")
def truck_report(spark, d):
    days = spark.range(95).withColumnRenamed("id", "day")
    fleet = spark.range(4).crossJoin(days).select(F.concat(F.lit("truck"), "id").alias("truck"), "day", (F.lit(4.0) + F.col("id") + F.col("day") % 3).alias("units"))
    return rounded(R.trucks(deliveries(spark, d), fleet, HORIZON, "week"))
