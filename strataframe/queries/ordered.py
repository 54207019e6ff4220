"""Ordered analytics over events: user is the hole, time in seconds or microseconds the depth."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import maths as M
from ..functions.text import natural_key
from ..operators import series as S
from .interval import _EV, events
from .registry import query, table


def intervals(spark, d):
    """from = time, to = the next event's, code = event_type with `view` blank."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, d)
    return e.select("user_id", "event_id", F.col("us").alias("from"), F.lead("us").over(w).alias("to"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("code"), "value")


_IV = f"""{_EV}, iv AS (SELECT user_id, event_id, us AS f, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS t, nullif(event_type, 'view') AS code, value FROM e)"""


@query(f"""WITH {_IV}, k AS (SELECT *, code IN ('click', 'purchase') AS m FROM iv WHERE code IS NOT NULL),
n AS (SELECT *, CASE WHEN m AND NOT coalesce(lag(m) OVER w, false) THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY f, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY f, event_id) AS run FROM n),
g AS (SELECT user_id, run, min(f) AS roof, max(t) AS floor FROM r WHERE m GROUP BY user_id, run)
SELECT user_id, roof, floor, runs FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS runs FROM g) WHERE run = 1""")
def run_pick_roof_floor(spark, d):
    runs = S.code_runs(intervals(spark, d), ["user_id"], ["from", "event_id"], "code", ["click", "purchase"])
    return runs.where("run = 1").select("user_id", "roof", "floor", "runs")


@query(f"""WITH {_EV}, o AS (SELECT user_id, event_id, us AS f, us + (value * 60000000)::BIGINT AS t FROM e),
n AS (SELECT *, lead(f) OVER (PARTITION BY user_id ORDER BY f, t) AS nf FROM o)
SELECT user_id, count(*) AS overlaps, max(t - nf) AS longest FROM n WHERE nf < t GROUP BY user_id""")
def adjacent_overlaps(spark, d):
    e = events(spark, d).select("user_id", F.col("us").alias("from"), (F.col("us") + F.round(F.col("value") * 60000000, 0).cast("long")).alias("to"))
    o = S.adjacent_overlaps(e, ["user_id"], 0)
    return o.groupBy("user_id").agg(F.count(F.lit(1)).alias("overlaps"), F.max(F.col("to") - F.col("next_from")).alias("longest"))


@query(f"""WITH {_EV}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w > 14400000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS g FROM n), c AS (SELECT *, count(*) OVER (PARTITION BY user_id, g) AS n FROM g),
m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM c) SELECT event_id, user_id FROM m WHERE n >= 3 OR most < 3""")
def drop_isolated(spark, d):
    return S.drop_isolated(events(spark, d), ["user_id"], "us", 14400 * 1_000_000, 3).select("event_id", "user_id")


@query(f"""WITH {_EV}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM e)
SELECT event_type, max(value) FILTER (r = floor((n - 1) * 0.01 + 0.5)) AS p01, max(value) FILTER (r = floor((n - 1) * 0.5 + 0.5)) AS p50, max(value) FILTER (r = floor((n - 1) * 0.99 + 0.5)) AS p99 FROM r GROUP BY event_type""")
def robust_percentiles(spark, d):
    return S.rank_percentile(events(spark, d), ["event_type"], "value", {"p01": 0.01, "p50": 0.5, "p99": 0.99})


_STEP = 21600


@query(f"""WITH {_EV}, z AS (SELECT user_id, us // 1000000 AS s, value FROM e), f AS (SELECT user_id, min(s) AS s0 FROM z GROUP BY user_id),
p AS (SELECT z.user_id, floor((s - s0) / {_STEP}.0 + 0.5)::BIGINT AS slot, abs(s - s0 - floor((s - s0) / {_STEP}.0 + 0.5) * {_STEP}) AS off, s, value FROM z JOIN f USING (user_id)),
b AS (SELECT user_id, slot, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY off, s, value) AS n FROM p) WHERE n = 1),
sp AS (SELECT user_id, unnest(range(min(slot), max(slot) + 1)) AS slot FROM b GROUP BY user_id)
SELECT user_id, slot, value FROM sp LEFT JOIN b USING (user_id, slot)""")
def resample_regular(spark, d):
    e = events(spark, d).select("user_id", F.floor(F.col("us") / 1_000_000).alias("s"), "value").groupBy("user_id", "s").agg(F.min("value").alias("value"))
    return S.regularise(e, ["user_id"], "s", "value", _STEP)


@query(f"""WITH {_EV}, z AS (SELECT us - (SELECT min(us) FROM e) AS x, event_type, value FROM e),
i AS (SELECT event_type, least(floor(x / 25920000000.0), 99)::BIGINT AS bucket, min(value) AS lo, max(value) AS hi,
  min((x, value)) AS first, max((x, value)) AS last FROM z WHERE x >= 0 AND x < 2592000000000 GROUP BY ALL),
f AS (SELECT event_type, bucket, lo, hi, (bucket + 0.5::DOUBLE) * 25920000000.0::DOUBLE AS m, last_value(last IGNORE NULLS) OVER q AS b, first_value(first IGNORE NULLS) OVER r AS a
  FROM (SELECT event_type, unnest(range(0, 100)) AS bucket FROM (SELECT DISTINCT event_type FROM i)) LEFT JOIN i USING (event_type, bucket)
  WINDOW q AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
n AS (SELECT *, CASE WHEN a IS NULL OR m - b[1] <= a[1] - m THEN b[2] ELSE a[2] END AS near FROM f)
SELECT event_type, bucket, coalesce(lo, near) AS lo, coalesce(hi, near) AS hi FROM n""")
def envelope_buckets(spark, d):
    e = events(spark, d)
    first = e.agg(F.min("us").alias("u0"))
    z = e.crossJoin(F.broadcast(first)).select("event_type", (F.col("us") - F.col("u0")).cast("double").alias("x"), "value")
    return S.envelope(z, ["event_type"], "x", "value", 0.0, 2592000000000.0, 100)


@query(f"""WITH {_EV}, z AS (SELECT event_type, floor((us - (SELECT min(us) FROM e)) / 3600000000.0)::BIGINT AS slot, value FROM e),
l AS (SELECT *, unnest(range(0, 5)) AS level FROM z)
SELECT event_type, level, floor(slot / 2 ** level)::BIGINT AS cell, min(value) AS lo, max(value) AS hi FROM l GROUP BY event_type, level, cell""")
def minmax_pyramid(spark, d):
    e = events(spark, d)
    z = e.crossJoin(F.broadcast(e.agg(F.min("us").alias("u0")))).select("event_type", F.floor((F.col("us") - F.col("u0")) / 3600000000.0).alias("slot"), "value")
    return S.pyramid(z, ["event_type"], "slot", "value", 4)


@query(f"""WITH {_EV}, w AS (SELECT user_id, us, event_id, count(*) OVER q AS n, sum(value) OVER q AS total FROM e
  WINDOW q AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 28799999999 FOLLOWING))
SELECT user_id, max(n) AS most, round(max(total), 4) AS total, min(us) FILTER (n = m) AS at FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM w) GROUP BY user_id""")
def sliding_window_peak(spark, d):
    w = S.window_sums(events(spark, d), ["user_id"], "us", F.col("value"), 8 * 3600 * 1_000_000)
    return w.groupBy("user_id").agg(F.max("n").alias("most"), F.round(F.max("total"), 4).alias("total"), F.min_by("us", F.struct(-F.col("n"), F.col("us"))).alias("at"))


@query(f"""WITH {_EV}, x AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS dt FROM e)
SELECT user_id, median(dt) AS step FROM x WHERE dt > 0 GROUP BY user_id""")
def median_spacing(spark, d):
    return S.median_step(events(spark, d), ["user_id"], "us")


@query(f"""WITH {_EV}, z AS (SELECT user_id, us // 3600000000 AS depth, event_id, value FROM e)
SELECT user_id, depth, arg_min(value, event_id) AS value FROM z GROUP BY user_id, depth""")
def settle_depths(spark, d):
    e = events(spark, d).withColumn("depth", F.floor(F.col("us") / 3600000000))
    return S.settle(e, ["user_id"], "depth", "value", "event_id")


@query(f"""WITH {_EV}, st AS (SELECT user_id, us AS t, max(value) AS v FROM e WHERE event_type = 'purchase' GROUP BY user_id, us),
f AS (SELECT event_id, user_id, us FROM e WHERE event_type = 'click'),
p AS (SELECT f.*, st.t AS t0, st.v AS v0 FROM f ASOF LEFT JOIN st ON f.user_id = st.user_id AND f.us >= st.t),
q AS (SELECT p.*, st.t AS t1, st.v AS v1 FROM p ASOF LEFT JOIN st ON p.user_id = st.user_id AND p.us <= st.t)
SELECT event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t1 > t0 THEN v0 + (v1 - v0) * ((us - t0) / (t1 - t0)) ELSE v0 END, 6) AS v FROM q""")
def station_interpolation(spark, d):
    e = events(spark, d)
    st = e.where("event_type = 'purchase'").groupBy("user_id", F.col("us").alias("t")).agg(F.max("value").alias("v"))
    facts = e.where("event_type = 'click'").select("event_id", "user_id", "us")
    return S.interpolate(facts, st, ["user_id"], "us", "t", ["v"]).select("event_id", F.round("v", 6).alias("v"))


_NK = r"array_to_string(list_transform(regexp_extract_all(translate(p_name || '-' || p_size, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' || lpad(length(regexp_replace(x, '^0+([0-9])', '\1'))::VARCHAR, 10, '0') || regexp_replace(x, '^0+([0-9])', '\1') ELSE x END), '')"


@query(rf"SELECT p_partkey, row_number() OVER (ORDER BY {_NK}, p_partkey) AS place FROM part")
def natural_sort(spark, d):
    parts = table(spark, d, "part").select("p_partkey", natural_key(F.concat_ws("-", "p_name", "p_size")).alias("k"))
    return S.ranked(parts, ["k", "p_partkey"]).select("p_partkey", "place")


@query("""SELECT c_mktsegment, c_custkey, c_acctbal, n::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 5""")
def topk_per_group(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, d, "customer").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("c_mktsegment", "c_custkey", "c_acctbal", "place")


@query("""WITH k AS (SELECT *, md5('s:' || c_custkey) AS h, (row_number() OVER (ORDER BY c_custkey) - 1) * 50 // (SELECT count(*) FROM customer) AS part FROM customer)
SELECT part, arg_min(c_custkey, h) AS c_custkey FROM k GROUP BY part""")
def stratified_sample(spark, d):
    c = S.ranked(table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    n = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    k = c.crossJoin(F.broadcast(n)).withColumn("part", F.floor((F.col("place") - 1) * 50 / F.col("n")).cast("long"))
    return k.groupBy("part").agg(F.min_by("c_custkey", F.md5(F.concat(F.lit("s:"), F.col("c_custkey").cast("string")))).alias("c_custkey"))


@query("""SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey)::BIGINT AS place FROM nation""")
def grouped_order(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.row_number().over(Window.orderBy("n_regionkey", "n_nationkey")).cast("long").alias("place"))


@query("""SELECT p_partkey, greatest(3, CASE WHEN p_size % 10 = 0 THEN p_partkey + 1 ELSE least(p_partkey + 1, round((p_partkey + 1) * (p_size / 4.0::DOUBLE) / 100)) END)::BIGINT AS target FROM part""")
def budget_limits(spark, d):
    k = F.col("p_partkey") + 1
    share = F.when(F.col("p_size") % 10 != 0, F.col("p_size") / 4.0)
    return table(spark, d, "part").select("p_partkey", M.budget(k, share).alias("target"))
