"""Blasting, haulage, solids and small rules: parts are blocks and holes, suppliers pieces, nations nodes of a network."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as GEO
from ..functions import text as T
from ..functions import values as V
from ..operators import blasting as B
from ..operators import haulage as H
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import series as S
from ..operators import solids as SO
from ..sources import tables as TB
from .interval import _EV, _SP, events, spans
from .registry import query, table


def parts(spark, d):
    return table(spark, d, "part")


# solids

_BLOCKS = "b AS (SELECT p_partkey AS block, (p_partkey % 40) * 10.0 AS x0, (p_partkey // 40 % 40) * 10.0 AS y0, (p_partkey // 1600) * 5.0 AS z0, p_size AS t FROM part)"
_PIECES = "p AS (SELECT s_suppkey AS piece, s_suppkey * 37 % 360 + 0.5 AS x0, s_suppkey * 53 % 340 + 0.25 AS y0, s_suppkey % 4 * 3.0 - 1.5 AS z0, 25.0 + s_suppkey % 30 AS w, 7.0 + s_suppkey % 5 AS h FROM supplier)"
_INSIDE = f"""{_BLOCKS}, {_PIECES}, j AS (SELECT block, piece, t, greatest(0, least(b.x0 + 10, p.x0 + w) - greatest(b.x0, p.x0)) * greatest(0, least(b.y0 + 10, p.y0 + w) - greatest(b.y0, p.y0))
  * greatest(0, least(b.z0 + 5, p.z0 + h) - greatest(b.z0, p.z0)) / 500.0::DOUBLE AS fraction FROM b JOIN p ON b.x0 < p.x0 + w AND p.x0 < b.x0 + 10 AND b.y0 < p.y0 + w AND p.y0 < b.y0 + 10)"""


def inside(spark, d):
    k = F.col("p_partkey")
    x0, y0, z0 = (k % 40) * 10.0, F.floor(k / 40) % 40 * 10.0, F.floor(k / 1600) * 5.0
    blocks = parts(spark, d).select(k.alias("block"), F.col("p_size").alias("t"), x0.alias("x0"), y0.alias("y0"), z0.alias("z0"), (x0 + 10).alias("x1"), (y0 + 10).alias("y1"), (z0 + 5).alias("z1"))
    s = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(s.alias("piece"), (s * 37 % 360 + 0.5).alias("x0"), (s * 53 % 340 + 0.25).alias("y0"), (s % 4 * 3.0 - 1.5).alias("z0"), (s % 30 + 25.0).alias("w"), (s % 5 + 7.0).alias("h"))
    pieces = p.select("piece", "x0", "y0", "z0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("w")).alias("y1"), (F.col("z0") + F.col("h")).alias("z1"))
    return blocks, SO.piece_fractions(blocks, SO.box_faces(pieces), 40.0)


@query(f"WITH {_INSIDE} SELECT block, piece, round(fraction, 7) AS fraction FROM j WHERE fraction > 1e-9")
def block_piece_fractions(spark, d):
    return inside(spark, d)[1].select("block", "piece", F.round("fraction", 7).alias("fraction"))


@query(f"WITH {_INSIDE} SELECT piece, count(*) AS blocks, round(sum(fraction * 500.0), 5) AS volume, round(sum(fraction * 500.0 * t) / sum(fraction * 500.0), 5) AS mean_size FROM j WHERE fraction > 1e-9 GROUP BY piece")
def piece_reserves(spark, d):
    blocks, share = inside(spark, d)
    metrics = [M.Metric("volume", "sum", "volume"), M.Metric("mean_size", "volume", F.col("t").cast("double"), "volume")]
    sums = M.partials(SO.covered(blocks, share, ["t"]), metrics, ["piece"], share=F.col("share"))
    return M.finalise(sums, metrics, ["piece"], digits=5).join(sums.select("piece", F.col("volume__used").alias("blocks")), "piece").select("piece", "blocks", "volume", "mean_size")


_TURNED = "b AS (SELECT p_partkey AS block, (p_partkey % 40) * 10.0 AS x0, (p_partkey // 40 % 40) * 10.0 AS y0, (p_partkey // 1600) * 5.0 AS z0 FROM part)"


@query(f"""WITH {_TURNED}, {_PIECES}, w AS (SELECT block, -(y0 + 10) AS x0, -y0 AS x1, x0 AS y0, x0 + 10 AS y1, z0 FROM b),
q AS (SELECT piece, x0 - 200 AS x0, y0, z0, w, h FROM p)
SELECT block, count(*) AS pieces, round(sum(greatest(0, least(w.x1, q.x0 + w) - greatest(w.x0, q.x0)) * greatest(0, least(w.y1, q.y0 + w) - greatest(w.y0, q.y0))
  * greatest(0, least(w.z0 + 5, q.z0 + h) - greatest(w.z0, q.z0))) / 500.0, 6) AS taken
FROM w JOIN q ON w.x0 < q.x0 + w AND q.x0 < w.x1 AND w.y0 < q.y0 + w AND q.y0 < w.y1 AND w.z0 < q.z0 + h AND q.z0 < w.z0 + 5 GROUP BY block""")
def turned_block_shares(spark, d):
    k = F.col("p_partkey")
    x0, y0, z0 = (k % 40) * 10.0, F.floor(k / 40) % 40 * 10.0, F.floor(k / 1600) * 5.0
    blocks = parts(spark, d).select(k.alias("block"), x0.alias("x0"), y0.alias("y0"), z0.alias("z0"), (x0 + 10).alias("x1"), (y0 + 10).alias("y1"), (z0 + 5).alias("z1"))
    s = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(s.alias("piece"), (s * 37 % 360 - 199.5).alias("x0"), (s * 53 % 340 + 0.25).alias("y0"), (s % 4 * 3.0 - 1.5).alias("z0"), (s % 30 + 25.0).alias("w"), (s % 5 + 7.0).alias("h"))
    pieces = p.select("piece", "x0", "y0", "z0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("w")).alias("y1"), (F.col("z0") + F.col("h")).alias("z1"))
    # the model's x axis points north and its y axis west
    share = SO.piece_fractions(blocks, SO.box_faces(pieces), 40.0, rotation=[[0, 1, 0], [-1, 0, 0], [0, 0, 1]])
    return share.groupBy("block").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum("fraction"), 6).alias("taken"))


# blasting


@query("""WITH h AS (SELECT p_partkey AS hole, (p_partkey % 3)::DOUBLE AS top, (p_partkey % 3)::DOUBLE + p_size * 0.5::DOUBLE - 2 AS bottom FROM part),
q AS (SELECT *, CASE WHEN bottom - top <= 1e-6 THEN 'no depth' WHEN 5.5 > bottom - top - 0.1 THEN 'too short' END AS problem FROM h)
SELECT hole, seq, product, f AS "from", t AS "to", NULL::VARCHAR AS problem FROM (SELECT hole, unnest([1, 2, 3, 4]::BIGINT[]) AS seq, unnest(['gravel', 'anfo', 'air', 'emulsion']) AS product,
  unnest([top, top + 3, bottom - 2.5, bottom - 1.5]) AS f, unnest([top + 3, bottom - 2.5, bottom - 1.5, bottom]) AS t FROM q WHERE problem IS NULL)
UNION ALL SELECT hole, NULL, NULL, NULL, NULL, problem FROM q WHERE problem IS NOT NULL""")
def deck_layout(spark, d):
    top = (F.col("p_partkey") % 3).cast("double")
    holes = parts(spark, d).select(F.col("p_partkey").alias("hole"), top.alias("top"), (top + F.col("p_size") * 0.5 - 2).alias("bottom"))
    decks = spark.createDataFrame([(1, "gravel", 3.0), (2, "anfo", None), (3, "air", 1.0), (4, "emulsion", 1.5)], "seq long, product string, length double")
    return B.lay_decks(holes, decks).select("hole", "seq", "product", "from", "to", "problem")


@query("""WITH h AS (SELECT p_partkey AS hole, (p_partkey % 3)::DOUBLE AS top, (p_partkey % 3)::DOUBLE + p_size * 0.25::DOUBLE AS bottom, 0.1::DOUBLE + p_partkey % 4 * 0.02::DOUBLE AS d FROM part),
q AS (SELECT *, bottom - 2.5 - (top + 3.0) AS main, CASE WHEN bottom - top <= 1e-6 THEN 'no depth' WHEN 5.5 > bottom - top - 0.1 THEN 'too short' END AS problem FROM h)
SELECT hole, problem, CASE WHEN problem IS NULL THEN round((main * 0.85 + 1.5 * 1.15) * pi() * pow(d / 2, 2), 9) ELSE 0.0 END AS mass,
  CASE WHEN problem IS NULL THEN greatest(top + 3.0, bottom - 2.5 - 0.4) END AS main_primer FROM q""")
def hole_charges(spark, d):
    top = (F.col("p_partkey") % 3).cast("double")
    holes = parts(spark, d).select(F.col("p_partkey").alias("hole"), top.alias("top"), (top + F.col("p_size") * 0.25).alias("bottom"), (F.lit(0.1) + F.col("p_partkey") % 4 * 0.02).alias("d"))
    decks = spark.createDataFrame([(1, "gravel", 3.0, "stemming", 0.0), (2, "anfo", None, "explosive", 0.85), (3, "air", 1.0, "air", 0.0), (4, "late fill", None, "stemming", 0.0), (5, "emulsion", 1.5, "explosive", 1.15)], "seq long, product string, length double, kind string, density double")
    charged = B.charge_holes(holes, decks, primer_offset=0.4)
    main = F.get(F.filter("decks", lambda x: x["seq"] == 2), F.lit(0))["primer"]
    return charged.select("hole", "problem", F.round(B.charge_mass(charged, F.col("d")), 9).alias("mass"), main.alias("main_primer"))


@query(f"""WITH {_EV}, r AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN NULL ELSE us END AS tm, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS relief FROM e)
SELECT event_type, CASE WHEN tm IS NULL THEN 'unfired' WHEN relief IS NULL THEN 'free' WHEN relief < 10 THEN 'tight' WHEN relief > 50 THEN 'slack' ELSE 'good' END AS band, count(*) AS n FROM r GROUP BY ALL""")
def relief_bands(spark, d):
    e = events(spark, d)
    time, relief = F.when(F.col("event_id") % 11 != 0, F.col("us")), F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return e.groupBy("event_type", B.relief_band(time, relief, 10.0, 50.0).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT DISTINCT p_brand, p_size AS number FROM part WHERE p_partkey % 2 = 0),
w AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 2 = 1),
c AS (SELECT p_brand, number, row_number() OVER (PARTITION BY p_brand ORDER BY number) AS n FROM (SELECT b.p_brand, r.number FROM (SELECT DISTINCT p_brand FROM w) b,
  (SELECT unnest(range(1, (SELECT max(n) FROM w) + 60)) AS number) r) WHERE (p_brand, number) NOT IN (SELECT p_brand, number FROM u))
SELECT p_brand, p_partkey, c.number::BIGINT AS number FROM w JOIN c USING (p_brand, n)""")
def lowest_unused_numbers(spark, d):
    p = parts(spark, d)
    used = p.where("p_partkey % 2 = 0").select("p_brand", F.col("p_size").alias("number"))
    return B.lowest_unused(used, p.where("p_partkey % 2 = 1").select("p_brand", "p_partkey"), ["p_brand"], "number", ["p_partkey"])


@query(f"""WITH {_SP}, w(name, x, y) AS (VALUES ('first', 0.0::DOUBLE, 20000.0::DOUBLE), ('inner', 30000.0, 30100.0)),
t AS (SELECT name, loader, tonnes * greatest(0, least(b, y) - greatest(a, x)) / (b - a) AS q FROM s, w)
SELECT name, loader, round(sum(q) + 0.00123456789, 2) AS worked FROM t GROUP BY name, loader""")
def worked_between(spark, d):
    s = spans(spark, d)
    sums = [F.sum(B.worked(s, "tonnes", F.lit(a), F.lit(b))).alias(n) for n, a, b in (("first", 0.0, 20000.0), ("inner", 30000.0, 30100.0))]
    wide = s.groupBy("loader").agg(*sums)
    return wide.unpivot(["loader"], ["first", "inner"], "name", "q").select("name", "loader", F.round(F.col("q") + 0.00123456789, 2).alias("worked"))


@query("""WITH o AS (SELECT o_custkey % 4 AS blast, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS day, o_orderkey FROM orders),
t AS (SELECT o_orderkey, day AS prepped, CASE WHEN o_orderkey % 5 <> 0 THEN day + 3 END AS drilled, CASE WHEN o_orderkey % 3 <> 0 THEN day + 5 END AS charged, CASE WHEN o_orderkey % 2 = 0 THEN day + 9 END AS fired, blast FROM o)
SELECT blast, CASE WHEN fired <= 1200 THEN 'fired' WHEN charged <= 1200 THEN 'charged' WHEN drilled <= 1200 THEN 'drilled' WHEN prepped <= 1200 THEN 'prepped' ELSE 'not started' END AS stage, count(*) AS n FROM t GROUP BY ALL""")
def stages_at(spark, d):
    day, k = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double"), F.col("o_orderkey")
    done = [day, F.when(k % 5 != 0, day + 3), F.when(k % 3 != 0, day + 5)]
    stage = B.stage_at(F.when(k % 2 == 0, day + 9), done, ["prepped", "drilled", "charged"], F.lit(1200.0))
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 4).alias("blast"), stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


# haulage

_NODES = "n AS (SELECT n_nationkey::BIGINT AS node, n_nationkey * 40.0::DOUBLE AS nx, n_nationkey * n_nationkey % 97 * 10.0::DOUBLE AS ny, n_nationkey % 6 * 5.0::DOUBLE AS nz FROM nation)"


@query(f"""WITH {_NODES}, b AS (SELECT p_partkey AS block, p_partkey % 1000 * 1.0::DOUBLE AS x, p_partkey * 7 % 970 * 1.0::DOUBLE AS y, p_size * 0.5::DOUBLE AS z FROM part),
l AS (SELECT p_partkey AS block, p_partkey % 31 AS node FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_partkey, p_partkey % 29 FROM part WHERE p_partkey % 6 = 0),
m AS (SELECT block, node, greatest(sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny) + (z - nz) * (z - nz)), abs(z - nz) / 0.1) AS metres FROM b, n),
k AS (SELECT m.* FROM m JOIN l USING (block, node))
SELECT block, node, round(metres, 6) AS metres FROM k UNION ALL
SELECT block, arg_min(node, (metres, node)), round(min(metres), 6) FROM m WHERE block NOT IN (SELECT block FROM k) GROUP BY block""")
def network_joins(spark, d):
    k = F.col("n_nationkey")
    nodes = table(spark, d, "nation").select(k.cast("long").alias("node"), (k * 40.0).alias("x"), (k * k % 97 * 10.0).alias("y"), (k % 6 * 5.0).alias("z"))
    p = F.col("p_partkey")
    blocks = parts(spark, d).select(p.alias("block"), (p % 1000 * 1.0).alias("x"), (p * 7 % 970 * 1.0).alias("y"), (F.col("p_size") * 0.5).alias("z"))
    links = blocks.where("block % 3 = 0").select("block", (F.col("block") % 31).alias("node")).union(blocks.where("block % 6 = 0").select("block", (F.col("block") % 29).alias("node"))).distinct()
    return H.network_joins(blocks, links, nodes, 0.1).select("block", "node", F.round("metres", 6).alias("metres"))


_GRADES = [(-1.0, 42.0), (-0.02, 40.0), (0.02, 24.0), (0.08, 12.0)]


@query("""WITH q AS (SELECT l_orderkey, (l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, l_linenumber * 30.0::DOUBLE AS x, l_quantity AS y, l_quantity * 0.1::DOUBLE + l_linenumber AS z FROM lineitem),
e AS (SELECT l_orderkey, pos, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM q WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)),
m AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS m, dz / greatest(sqrt(dx * dx + dy * dy), 1e-9) AS g FROM e),
v AS (SELECT *, least(CASE WHEN g >= 0.08 THEN 12.0 WHEN g >= 0.02 THEN 24.0 WHEN g >= -0.02 THEN 40.0 ELSE 42.0 END, 38.0)::DOUBLE AS kph FROM m WHERE m > 1e-9)
SELECT l_orderkey, round(sum(m / 1000), 9) AS km, round(sum(m / 1000 / kph), 9) AS hours, round(sum(greatest(dz, 0)), 6) AS rise, arg_min(kph, pos) AS first_speed, arg_max(kph, pos) AS last_speed FROM v GROUP BY l_orderkey""")
def leg_times(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("at"), (F.col("l_linenumber") * 30.0).alias("x"), F.col("l_quantity").alias("y"), (F.col("l_quantity") * 0.1 + F.col("l_linenumber")).alias("z"))
    out = H.leg_times(li, ["l_orderkey"], "at", _GRADES, 38.0)
    return out.select("l_orderkey", F.round("km", 9).alias("km"), F.round("hours", 9).alias("hours"), F.round("rise", 6).alias("rise"), "first_speed", "last_speed")


# series


@query(f"""WITH {_EV}, k AS (SELECT user_id, us AS close, sum(value) AS c FROM e WHERE event_type = 'purchase' GROUP BY user_id, us),
r AS (SELECT user_id, close, sum(c) OVER (PARTITION BY user_id ORDER BY close) AS closing FROM k)
SELECT e.event_id, round(coalesce(r.closing, 100), 6) AS balance FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.us >= r.close""")
def asof_balance(spark, d):
    e = events(spark, d)
    knots = I.balance(e.where("event_type = 'purchase'"), ["user_id"], "us", "value").select("user_id", F.col("us").alias("close"), F.col("running").alias("closing"))
    return I.asof(e, knots, ["user_id"], "us", "close", ["closing"], {"closing": 100.0}).select("event_id", F.round("closing", 6).alias("balance"))


@query(f"""WITH {_EV}, st AS (SELECT user_id, us AS t, max(value) AS v FROM e WHERE event_type = 'purchase' GROUP BY user_id, us),
f AS (SELECT event_id, user_id, value, us + (event_id % 5 - 1) * 1800000000.0::DOUBLE AS m FROM e WHERE event_type = 'click' AND event_id % 5 > 1),
p AS (SELECT f.*, st.t AS t0, st.v AS v0 FROM f ASOF LEFT JOIN st ON f.user_id = st.user_id AND f.m >= st.t),
q AS (SELECT p.*, st.t AS t1, st.v AS v1 FROM p ASOF LEFT JOIN st ON p.user_id = st.user_id AND p.m <= st.t)
SELECT event_id, value, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t1 > t0 THEN v0 + (v1 - v0) * ((m - t0) / (t1 - t0)) ELSE v0 END, 6) AS at FROM q""")
def interval_midpoints(spark, d):
    e = events(spark, d)
    trace = e.where("event_type = 'purchase'").groupBy("user_id", F.col("us").cast("double").alias("t")).agg(F.max("value").alias("at"))
    logs = e.where("event_type = 'click'").select("event_id", "user_id", "value", F.col("us").alias("from"), (F.col("us") + (F.col("event_id") % 5 - 1) * 3600000000).alias("to"))
    return S.midpoints(logs, trace, ["user_id"], "value", "t", ["at"]).select("event_id", "value", F.round("at", 6).alias("at"))


# expressions


@query("""SELECT p_partkey, round((p_size + 10 + p_partkey % 7)::DOUBLE, 9) AS total, round(2 * sqrt(greatest(0, ((p_size - 10.0) / 2) ** 2 + 9)) , 6) AS spread FROM part""")
def eigenvalues(spark, d):
    # one axis is free of the others, so the other two have a closed form to compare with
    a, b, c = F.col("p_size").cast("double"), F.lit(10.0), (F.col("p_partkey") % 7).cast("double")
    l1, l2, l3 = GEO.symmetric_eigenvalues(a, b, c, F.lit(3.0), F.lit(0.0), F.lit(0.0))
    near = lambda x: F.abs(x - c)
    rest = F.when((near(l1) <= near(l2)) & (near(l1) <= near(l3)), l2 - l3).when(near(l2) <= near(l3), l1 - l3).otherwise(l1 - l2)
    return parts(spark, d).select("p_partkey", F.round(l1 + l2 + l3, 9).alias("total"), F.round(rest, 6).alias("spread"))


@query("""WITH r AS (SELECT p_partkey, p_partkey % 90 AS a, p_size * 1.0::DOUBLE AS w, 4.0::DOUBLE AS h FROM part)
SELECT p_partkey, round(100 + 1 * cos(radians(a)) + 2 * sin(radians(a)), 8) AS x, round(200 - 1 * sin(radians(a)) + 2 * cos(radians(a)), 8) AS y, 8.0::DOUBLE AS z,
  round((w * abs(cos(radians(a))) + h * abs(sin(radians(a)))) / 2, 8) AS hx, round((w * abs(sin(radians(a))) + h * abs(cos(radians(a)))) / 2, 8) AS hy FROM r""")
def rotated_boxes(spark, d):
    a = F.col("p_partkey") % 90
    x, y, z = GEO.rotated([F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.lit(100.0), F.lit(200.0), F.lit(5.0)], a)
    hx, hy, _ = GEO.rotated_half_sizes([F.col("p_size") * 1.0, F.lit(4.0), F.lit(1.0)], a)
    return parts(spark, d).select("p_partkey", F.round(x, 8).alias("x"), F.round(y, 8).alias("y"), z.alias("z"), F.round(hx, 8).alias("hx"), F.round(hy, 8).alias("hy"))


@query("""WITH a AS (SELECT p_partkey, p_partkey * 7 % 360 + 0.5::DOUBLE AS az FROM part)
SELECT p_partkey, round(CASE WHEN az <= 30 THEN 50 + (45 - 50) * (az + 60) / 90.0 WHEN az <= 120 THEN 45 + (38 - 45) * (az - 30) / 90.0 WHEN az <= 300 THEN 38 + (50 - 38) * (az - 120) / 180.0
  ELSE 50 + (45 - 50) * (az - 300) / 90.0 END::DOUBLE, 8) AS slope FROM a""")
def slopes_at(spark, d):
    slope = GEO.slope_at(F.col("p_partkey") * 7 % 360 + 0.5, [(300.0, 50.0), (30.0, 45.0), (120.0, 38.0)])
    return parts(spark, d).select("p_partkey", F.round(slope, 8).alias("slope"))


@query("""SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 30 THEN (p_size - 10) / 20.0 * 0.5 ELSE 0.5 + least(1, (p_size - 30) / 15.0) * 0.5 END::DOUBLE, 9) AS r,
  round(CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 30 THEN 1 - (p_size - 10) / 20.0 ELSE 0 END::DOUBLE, 9) AS g FROM part""")
def colour_ramp(spark, d):
    r, g = V.ramp(F.col("p_size").cast("double"), [(10.0, (0.0, 1.0)), (30.0, (0.5, 0.0)), (45.0, (1.0, 0.0))])
    return parts(spark, d).select("p_partkey", F.round(r, 9).alias("r"), F.round(g, 9).alias("g"))


@query("""SELECT s_suppkey, greatest(greatest(abs(s_acctbal), s_suppkey) ** 2 * 1e-14, 1e-10)::DOUBLE AS tolerance FROM supplier""")
def overlap_tolerances(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", GEO.overlap_tolerance(F.col("s_acctbal"), F.col("s_suppkey").cast("double")).alias("tolerance"))


@query("""WITH c AS (SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'number' ELSE 'text' END AS kind, s_acctbal AS number FROM supplier),
f AS (SELECT p_partkey, p_retailprice AS value, CASE WHEN p_partkey % 3 = 0 THEN 'Supplier#' || lpad((p_partkey % 23)::VARCHAR, 9, '0') END AS constant FROM part)
SELECT p_partkey, CASE WHEN constant IS NULL THEN value WHEN kind = 'number' THEN number END AS value FROM f LEFT JOIN c ON f.constant = c.name""")
def resolved_constants(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_name").alias("constant"), F.when(F.col("s_suppkey") % 2 == 0, "number").otherwise("text").alias("kind"), F.col("s_acctbal").alias("number"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 23).cast("string"), 9, "0")))
    f = parts(spark, d).select("p_partkey", F.col("p_retailprice").alias("value"), name.alias("constant")).join(c, "constant", "left")
    return f.select("p_partkey", V.resolved(F.col("value"), F.col("constant"), F.col("kind"), F.col("number"), "number").alias("value"))


@query("""WITH f AS (SELECT r_name AS field, r_regionkey % 2 = 0 AS category FROM region UNION ALL SELECT n_name, n_nationkey % 3 = 0 FROM nation),
c AS (SELECT DISTINCT n_name AS name, n_nationkey % 2 = 0 AS category FROM nation) SELECT field, name AS mapped FROM f JOIN c ON field = name AND f.category = c.category WHERE field NOT IN ('CHINA', 'FRANCE')""")
def auto_mapping(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    fields = r.select(F.col("r_name").alias("field"), (F.col("r_regionkey") % 2 == 0).alias("category")).unionByName(n.select(F.col("n_name").alias("field"), (F.col("n_nationkey") % 3 == 0).alias("category")))
    columns = n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("category"))
    return P.auto_map(fields, columns, spark.createDataFrame([("CHINA",), ("FRANCE",)], "field string"))


@query("""SELECT DISTINCT field, p_partkey AS object FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS field FROM part)""")
def field_users(spark, d):
    objects = parts(spark, d).select(F.col("p_partkey").alias("object"), F.array("p_brand", "p_type").alias("fields"))
    return P.field_users(objects)


@query("""WITH i AS (SELECT p_partkey, range(1, p_size % 6 + 2) AS m, p_partkey % 9 AS x, p_partkey % 5 AS p FROM part)
SELECT p_partkey, CASE WHEN NOT list_contains(m, x) THEN m[1:least(p, len(m))] || [x] || m[least(p, len(m)) + 1:] END AS inserted,
  CASE WHEN p < len(m) AND x < len(m) THEN (list_concat(m[1:p], m[p + 2:]))[1:x] || [m[p + 1]] || (list_concat(m[1:p], m[p + 2:]))[x + 1:] END AS moved FROM i""")
def ordered_edits(spark, d):
    m, x, p = F.sequence(F.lit(1).cast("long"), (F.col("p_size") % 6 + 1).cast("long")), F.col("p_partkey") % 9, F.col("p_partkey") % 5
    return parts(spark, d).select("p_partkey", V.inserted(m, p, x).alias("inserted"), V.moved(m, p, x).alias("moved"))


@query("""SELECT p_partkey, p_partkey % 3 <> 0 AND (p_size % 4 = 0 OR p_size % 5 = 0) AS corrected FROM part""")
def corrected_intervals(spark, d):
    now = [F.col("p_size"), F.create_map(F.lit("a"), F.col("p_retailprice"), F.lit("b"), F.col("p_size") * 1.0)]
    was = [F.when(F.col("p_size") % 4 == 0, -1).otherwise(F.col("p_size")), F.create_map(F.lit("a"), F.col("p_retailprice"), F.lit("b"), F.when(F.col("p_size") % 5 == 0, F.lit(None)).otherwise(F.col("p_size") * 1.0))]
    entries = lambda m: F.array_sort(F.map_entries(m))
    changed = V.corrected([now[0], entries(now[1])], [was[0], entries(was[1])], F.col("p_partkey") % 3 != 0)
    return parts(spark, d).select("p_partkey", changed.alias("corrected"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_retailprice WHEN 2 THEN (p_size % 5)::DOUBLE END::DOUBLE AS value,
  CASE WHEN p_size % 5 < 3 THEN ['oxide', 'fresh', 'waste'][(p_size % 5 + 1)::BIGINT] END AS label FROM part""")
def captured_values(spark, d):
    values, fields = F.array(F.col("p_size") * 1.0, F.col("p_retailprice"), (F.col("p_size") % 5).cast("double")), F.array(F.lit("tonnes"), F.lit("grade"), F.lit("rock"))
    wanted = F.element_at(F.array(F.lit("tonnes"), F.lit("grade"), F.lit("rock"), F.lit("absent")), (F.col("p_partkey") % 4 + 1).cast("int"))
    labels = F.array(F.lit("oxide"), F.lit("fresh"), F.lit("waste"))
    return parts(spark, d).select("p_partkey", V.at_position(values, fields, wanted).alias("value"), V.label_of(V.at_position(values, fields, F.lit("rock")), labels).alias("label"))


@query("""WITH s AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN 'EPSG:' || (28300 + p_size) WHEN 1 THEN ' epsg: ' || (p_partkey * 1000) WHEN 2 THEN '' WHEN 3 THEN '+proj=utm +zone=' || p_size WHEN 4 THEN p_name END AS stored FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 28300 + p_size WHEN p_partkey % 6 = 1 AND p_partkey * 1000 <= 65535 THEN p_partkey * 1000 END::INT AS code,
  CASE WHEN p_partkey % 6 = 0 OR (p_partkey % 6 = 1 AND p_partkey * 1000 <= 65535) THEN 'registry' WHEN p_partkey % 6 IN (2, 5) THEN 'unset' WHEN p_partkey % 6 = 3 THEN 'definition' ELSE 'unrecognised' END AS kind FROM s""")
def coordinate_systems(spark, d):
    k = F.col("p_partkey") % 6
    stored = F.when(k == 0, F.concat(F.lit("EPSG:"), (F.col("p_size") + 28300).cast("string"))).when(k == 1, F.concat(F.lit(" epsg: "), (F.col("p_partkey") * 1000).cast("string"))).when(k == 2, "").when(k == 3, F.concat(F.lit("+proj=utm +zone="), F.col("p_size").cast("string"))).when(k == 4, F.col("p_name"))
    return parts(spark, d).select("p_partkey", T.system_code(stored).alias("code"), T.system_kind(stored).alias("kind"))


@query("""WITH r AS (SELECT s_suppkey % 3 AS file, CASE WHEN s_suppkey % 3 = 0 THEN -abs(s_acctbal) % 120 ELSE s_acctbal % 120 END AS tilt, s_suppkey * 50 % 400 AS azimuth FROM supplier)
SELECT file, coalesce(bool_or(tilt < 0 AND abs(tilt) <= 90), false) AND NOT coalesce(bool_or(tilt > 0 AND abs(tilt) <= 90), false) AS inclination_is_dip, count(*) FILTER (NOT (azimuth BETWEEN 0 AND 360)) AS azimuth_off_compass, count(*) FILTER (abs(tilt) > 90) AS tilt_not_an_angle FROM r GROUP BY file""")
def survey_angles(spark, d):
    s = table(spark, d, "supplier")
    tilt = F.when(F.col("s_suppkey") % 3 == 0, -F.abs("s_acctbal") % 120).otherwise(F.col("s_acctbal") % 120)
    return TB.survey_angles(s.select((F.col("s_suppkey") % 3).alias("file"), tilt.alias("inclination"), (F.col("s_suppkey") * 50 % 400).alias("azimuth")), ["file"])


@query("""SELECT doc_id, text, (doc_id % 3)::INT AS repairs FROM documents""")
def repaired_bytes(spark, d):
    # each document's bytes with up to two stray ones put behind, which reading takes out again as replacement signs
    raw = F.concat(F.encode("text", "UTF-8"), F.element_at(F.array(F.unhex(F.lit("")), F.unhex(F.lit("FF")), F.unhex(F.lit("FFFE"))), (F.col("doc_id") % 3 + 1).cast("int")))
    r = T.repaired(raw)
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(r["text"], "�+$", "").alias("text"), r["repairs"].alias("repairs"))
