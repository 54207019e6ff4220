"""Faces with holes, balances between knots, labelled spans, turned frames and the volume between surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import blasting as B
from ..operators import clouds as CL
from ..operators import depletion as D
from ..operators import intervals as I
from ..operators import spatial as S
from ..operators import surfaces as SU
from .interval import _SP, spans
from .registry import query, table
from .terrain import _RIGHT, right_angled


@query("""WITH f AS (SELECT s_suppkey AS face, s_suppkey * 7 % 90 + 0.25::DOUBLE AS x, s_suppkey * 11 % 80 + 0.5::DOUBLE AS y, 6.0::DOUBLE + s_suppkey % 5 AS w FROM supplier),
p AS (SELECT c_custkey AS point, c_custkey % 100 + 0.125::DOUBLE AS x, c_custkey * 3 % 90 + 0.0625::DOUBLE AS y FROM customer)
SELECT point, face FROM p JOIN f ON p.x > f.x AND p.x < f.x + w AND p.y > f.y AND p.y < f.y + w AND NOT (p.x > f.x + 2 AND p.x < f.x + w - 1 AND p.y > f.y + 1 AND p.y < f.y + w - 2)""")
def points_in_faces(spark, d):
    """Squares with a square hole."""
    k = F.col("s_suppkey")
    x, y, w = k * 7 % 90 + 0.25, k * 11 % 80 + 0.5, F.lit(6.0) + k % 5
    ring = lambda a, b, c, e: F.array(*[F.struct(p.alias("x"), q.alias("y")) for p, q in ((a, b), (c, b), (c, e), (a, e))])
    faces = table(spark, d, "supplier").select(k.alias("face"), F.array(ring(x, y, x + w, y + w), ring(x + 2, y + 1, x + w - 1, y + w - 2)).alias("rings"))
    c = F.col("c_custkey")
    points = table(spark, d, "customer").select(c.alias("point"), (c % 100 + 0.125).alias("x"), (c * 3 % 90 + 0.0625).alias("y"))
    return S.points_in_faces(points, faces, 7.0)


@query(f"""WITH {_SP}, k AS (SELECT DISTINCT loader, a AS tm, (a % 700)::DOUBLE AS bal, ((a % 5) - 2.5)::DOUBLE AS rate FROM s WHERE o_orderkey % 50 = 0)
SELECT s.o_orderkey, round(greatest(coalesce(k.bal + k.rate * (s.b - k.tm), 0), 0), 6) AS balance FROM s ASOF LEFT JOIN k ON s.loader = k.loader AND s.b >= k.tm""")
def balance_between_knots(spark, d):
    """Balances with a rate at some spans' starts, asked for at every span's end."""
    s = spans(spark, d)
    knots = s.where("o_orderkey % 50 = 0").select("loader", F.col("start").alias("at"), (F.col("start") % 700).alias("balance"), (F.col("start") % 5 - 2.5).alias("rate")).distinct()
    return I.balance_at(s.select("o_orderkey", "loader", "end"), knots, ["loader"], "end").select("o_orderkey", F.round("balance", 6).alias("balance"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey * 31 % 400 + 0.5::DOUBLE AS a, s_suppkey * 31 % 400 + 200.5::DOUBLE + s_suppkey % 90 AS b FROM supplier),
p AS (SELECT k, greatest(a, w * 24) AS a, least(b, (w + 1) * 24) AS b, CASE WHEN w >= 3 THEN w // 3 % 2 END AS label FROM (SELECT *, unnest(range(floor(a / 24)::BIGINT, ceil(b / 24)::BIGINT)) AS w FROM s)),
m AS (SELECT *, CASE WHEN lag(label) OVER v IS NOT DISTINCT FROM label AND lag(b) OVER v = a THEN 0 ELSE 1 END AS new FROM p WINDOW v AS (PARTITION BY k ORDER BY a)),
r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a) AS run FROM m)
SELECT k, min(a) AS start, max(b) AS "end", any_value('L' || label) AS label FROM r GROUP BY k, run""")
def labelled_spans(spark, d):
    """Spans cut by days; three days have one label, the next three another, and the first three none."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("k"), (k * 31 % 400 + 0.5).alias("start"), (k * 31 % 400 + 200.5 + k % 90).alias("end"))
    edges = s.select("k", F.explode(F.sequence(F.lit(3), F.lit(30))).alias("w")).select("k", (F.col("w") * 24.0).alias("since"), F.concat(F.lit("L"), F.floor(F.col("w") / 3) % 2).alias("label"))
    return I.labelled(s, edges, ["k"])


#: A frame turned about all three axes (fixed values, to six digits).
AXES = [[0.36, 0.48, -0.8], [-0.8, 0.6, 0.0], [0.48, 0.64, 0.6]]


@query("""WITH b AS (SELECT p_partkey, p_size::DOUBLE AS w, 2.0::DOUBLE + p_partkey % 5 AS h, (p_partkey % 100)::DOUBLE AS x FROM part)
SELECT p_partkey, round(10 + 0.36 * x + 2 * -0.8 + 3 * 0.48, 8) AS x, round(20 + 0.48 * x + 2 * 0.6 + 3 * 0.64, 8) AS y, round(-5 - 0.8 * x + 3 * 0.6, 8) AS z,
  round((w * 0.36 + h * 0.8 + 4 * 0.48) / 2, 8) AS hx, round((w * 0.8 + 4 * 0.6) / 2, 8) AS hz, round((w * 0.36 + h * 0.8 + 4 * 0.48), 8) AS spread FROM b""")
def turned_boxes(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), (F.lit(2.0) + F.col("p_partkey") % 5).alias("h"), (F.col("p_partkey") % 100).cast("double").alias("x"))
    centre = G.local_to_world([F.col("x"), F.lit(2.0), F.lit(3.0)], [10, 20, -5], AXES)
    size = [F.col("w"), F.col("h"), F.lit(4.0)]
    half = G.turned_half_sizes(size, AXES)
    xs = F.transform(G.corners(centre, size, AXES), lambda c: c["x"])
    return p.select("p_partkey", *[F.round(c, 8).alias(n) for c, n in zip(centre, "xyz", strict=True)], F.round(half[0], 8).alias("hx"), F.round(half[2], 8).alias("hz"), F.round(F.array_max(xs) - F.array_min(xs), 8).alias("spread"))


@query("""SELECT p_partkey, true AS sound, round(p_size + 10.0::DOUBLE + p_partkey % 7, 6) AS total FROM part""")
def eigen_frames(spark, d):
    """The vectors are the matrix's own, of length one and upright to each other."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("xx"), F.lit(3.0).alias("xy"), (k % 4).cast("double").alias("xz"), F.lit(10.0).alias("yy"), (k % 3 - 1).cast("double").alias("yz"), (k % 7).cast("double").alias("zz"))
    e = CL.eigen_frames(rows)
    v = lambda i, j: F.col("vectors")[i][j]
    dot = lambda i, j: sum((v(i, n) * v(j, n) for n in range(3)), F.lit(0.0))
    m = {(a, b): F.col("xyz"[min(a, b)] + "xyz"[max(a, b)]) for a in range(3) for b in range(3)}
    sound = F.lit(True)
    for i in range(3):
        sound = sound & (F.abs(dot(i, i) - 1) < 1e-9) & (F.abs(dot(i, (i + 1) % 3)) < 1e-9)
        for a in range(3):
            sound = sound & (F.abs(sum((m[a, b] * v(i, b) for b in range(3)), F.lit(0.0)) - F.col("values")[i] * v(i, a)) < 1e-8)
    return e.select("p_partkey", (sound & (F.col("values")[0] >= F.col("values")[1])).alias("sound"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""WITH {_RIGHT}, j AS (SELECT v.k AS lower, least(u.x + u.y + u.leg, v.x + v.y + v.leg) - greatest(u.x, v.x) - greatest(u.y, v.y) AS leg, u.z - v.z AS gap FROM u JOIN v ON u.x < v.x + v.leg AND v.x < u.x + u.leg AND u.y < v.y + v.leg AND v.y < u.y + u.leg)
SELECT lower, round(sum(gap * leg * leg / 2), 5) AS volume, round(sum(greatest(gap, 0) * leg * leg / 2), 5) AS cut, round(sum(greatest(-gap, 0) * leg * leg / 2), 5) AS fill FROM j WHERE leg > 1e-4 GROUP BY lower""")
def volume_between(spark, d):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    upper = right_angled(table(spark, d, "part"), k, k % 40 * 1.5, F.floor(k / 40) * 1.25, F.lit(1.0) + F.col("p_size") % 5, F.col("p_size"))
    lower = right_angled(table(spark, d, "supplier"), s, s * 7 % 60 + 0.25, s * 11 % 55 + 0.5, F.lit(2.0) + s % 6, F.lit(20.0))
    t = SU.triangle_overlaps(upper, lower, 5.0)
    return t.groupBy("lower").agg(F.round(F.sum(F.col("above") - F.col("below")), 5).alias("volume"), F.round(F.sum("above"), 5).alias("cut"), F.round(F.sum("below"), 5).alias("fill"))


@query(f"""WITH {_SP}, b AS (SELECT o_orderkey % 400 AS block, sum(tonnes) AS gone, max(b) AS last FROM s GROUP BY 1), w AS (SELECT o_orderkey % 400 AS block, a, b, tonnes FROM s),
q AS (SELECT block, 20000.0::DOUBLE + block * 100 AS t FROM b), g AS (SELECT q.block, t, sum(tonnes * least(1, greatest(0, (t - a) / (w.b - a)))) AS mined FROM q JOIN w USING (block) GROUP BY q.block, t)
SELECT block, round(mined / (gone + block % 4 * 100000.0), 7) AS gone FROM g JOIN b USING (block)""")
def depleted_blocks(spark, d):
    """Every order works on one of 400 blocks, of which some keep a remainder; each is asked for at a time of its own."""
    s = spans(spark, d)
    work = s.select((F.col("o_orderkey") % 400).alias("block"), "start", "end", "tonnes")
    left = F.col("block") % 4 * 100_000.0
    balances = work.groupBy("block").agg(F.sum("tonnes").alias("gone")).select("block", (F.col("gone") + left).alias("started"), left.alias("remaining"))
    asked = balances.select("block", (F.lit(20_000.0) + F.col("block") * 100).alias("time"))
    none = spark.createDataFrame([], "block long, emptied double")
    return D.fractions(asked, D.curves(work, balances), none).select("block", F.round("gone", 7).alias("gone"))


@query("""WITH w AS (SELECT o_custkey % 150 AS blast, ['prep', 'drill', 'charge'][(o_orderkey % 3 + 1)::INT] AS activity, o_orderkey * 7 % 900 * 1.0::DOUBLE AS a, o_orderkey * 7 % 900 + (o_orderkey % 40)::DOUBLE AS b, o_totalprice AS q FROM orders),
n AS (SELECT blast, activity, sum(q) * 1.1::DOUBLE AS quantity, CASE WHEN blast % 5 = 0 THEN 400.0::DOUBLE WHEN blast % 7 = 0 THEN 0.0 WHEN blast % 3 = 0 THEN 900.0 END AS done FROM w GROUP BY 1, 2),
g AS (SELECT blast, activity, sum(CASE WHEN b > a THEN q * (least(500.0, b) - a) / (b - a) ELSE q END) AS worked FROM w WHERE a < 500 GROUP BY 1, 2)
SELECT blast, activity, round(CASE WHEN done <= 500 THEN 1.0 ELSE least(1, coalesce(worked, 0) / quantity) END, 7) AS share FROM n LEFT JOIN g USING (blast, activity)""")
def blast_progress(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    start = (o * 7 % 900).cast("double")
    work = table(spark, d, "orders").select((c % 150).alias("blast"), F.element_at(F.array(*map(F.lit, ["prep", "drill", "charge"])), (o % 3 + 1).cast("int")).alias("activity"), start.alias("start"), (start + o % 40).alias("end"), F.col("o_totalprice").alias("quantity"))
    k = F.col("blast")
    blasts = work.groupBy("blast", "activity").agg((F.sum("quantity") * 1.1).alias("quantity")).withColumn("done", F.when(k % 5 == 0, 400.0).when(k % 7 == 0, 0.0).when(k % 3 == 0, 900.0))
    return B.done_shares(blasts, work, 500.0).select("blast", "activity", F.round("share", 7).alias("share"))


@query("""WITH b AS (SELECT s_suppkey AS boundary, s_suppkey * 50.0::DOUBLE AS x, 20.0::DOUBLE + s_suppkey % 11 AS w, 13.0::DOUBLE + s_suppkey % 7 AS h FROM supplier),
g AS (SELECT *, unnest(range(0, ceil(h / 4)::BIGINT)) AS row FROM b), p AS (SELECT *, unnest(range(0, ceil(w / 5)::BIGINT)) AS col FROM g),
q AS (SELECT boundary, row, col, x + 2.5 + col * 5 + CASE WHEN row % 2 = 1 THEN 2.5 ELSE 0 END AS px, 100 + 2.0 + row * 4 AS py, x, w, h FROM p)
SELECT boundary, row AS "row", col AS "column", round(px, 6)::DOUBLE AS x, round(py, 6)::DOUBLE AS y, round(10 + 0.1::DOUBLE * (px - x) + 0.05::DOUBLE * (py - 100), 6) AS z FROM q WHERE px < x + w AND py < 100 + h""")
def drill_patterns(spark, d):
    """A staggered grid in a supplier's rectangle, on a slope."""
    k = F.col("s_suppkey")
    x, w, h = k * 50.0, F.lit(20.0) + k % 11, F.lit(13.0) + k % 7
    corner = lambda i, j: F.struct((x + w * i).alias("x"), (F.lit(100.0) + h * j).alias("y"), (F.lit(10.0) + 0.1 * w * i + 0.05 * h * j).alias("z"))
    rings = table(spark, d, "supplier").select(k.alias("boundary"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    got = B.pattern_collars(rings, 4.0, 5.0, staggered=True)
    return got.select("boundary", "row", "column", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("""WITH a AS (SELECT p_partkey, 0.5::DOUBLE + p_size / 4.0 AS r, p_partkey % 3 AS kind FROM part), n AS (SELECT *, greatest(16, least(4096, ceil(pi() * r / 0.15))) AS n FROM a)
SELECT p_partkey, CASE WHEN kind = 0 THEN 1 ELSE n END::BIGINT AS points, round(CASE WHEN kind = 0 THEN 2 * r ELSE n * 2 * r * sin(pi() / (2 * n)) END, 7) AS length, round(CASE kind WHEN 0 THEN 0 WHEN 1 THEN -r ELSE r END * CASE WHEN kind = 0 THEN 0 WHEN n % 2 = 0 THEN 1 ELSE cos(pi() / (2 * n)) END, 7) AS depth FROM n""")
def arc_pieces(spark, d):
    """Half circles either way, and chords: how many points, how long, and how far they swing out."""
    k, r = F.col("p_partkey"), F.lit(0.5) + F.col("p_size") / 4.0
    at = lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    start = at(-r)
    points = G.arc_points(start, at(r), F.when(k % 3 == 1, 1.0).when(k % 3 == 2, -1.0).otherwise(0.0))
    # parts are few bytes each and arcs hundreds of points: they are dealt to as many tasks as a shuffle has, not to one for each piece of the file
    parts = table(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    a = parts.select("p_partkey", points.alias("p"), start.alias("s"))
    whole = F.concat(F.array("s"), F.col("p"))
    length = F.aggregate(F.zip_with(F.slice(whole, 1, F.size("p")), F.col("p"), lambda u, v: F.hypot(v["x"] - u["x"], v["y"] - u["y"])), F.lit(0.0), lambda t, x: t + x)
    swing = F.aggregate("p", F.lit(0.0), lambda t, p: F.when(F.abs(p["y"]) > F.abs(t), p["y"]).otherwise(t))
    return a.select("p_partkey", F.size("p").cast("long").alias("points"), F.round(length, 7).alias("length"), F.round(swing, 7).alias("depth"))
