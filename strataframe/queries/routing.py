"""Rule tables over movements: orders with their customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import rules as R
from .registry import query, table

#: seq, enabled, segments (null: any), lo, hi (null: open) of the order's value, destination.
ROUTES = [(1, True, ["BUILDING", "MACHINERY"], 200_000.0, None, "mill"), (2, False, None, None, None, "closed"), (3, True, ["BUILDING"], None, 150_000.0, "leach"), (4, True, None, 100_000.0, 300_000.0, "stockpile")]
#: enabled, segments, lo, value per unit.
VALUES = [(True, ["BUILDING"], None, 1.5), (True, None, 100_000.0, 0.25), (True, ["AUTOMOBILE", "FURNITURE"], 250_000.0, -2.0), (False, None, None, 100.0)]
#: enabled, priorities, lo, classes.
TRUCKS = [(True, ["1-URGENT", "2-HIGH"], None, ["big", "mid"]), (True, None, 200_000.0, ["big"]), (True, ["5-LOW"], None, ["small", "mid"])]


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "[" + ", ".join(map(_sql, v)) + "]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else repr(v)


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + ")"


def movements(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


_M = "m AS (SELECT o_orderkey, o_totalprice, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH r(seq, enabled, seg, lo, hi, dest) AS {_values(ROUTES)}, {_M},
h AS (SELECT o_orderkey, seq, dest, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq NULLS LAST) AS n FROM m LEFT JOIN r
  ON enabled AND (seg IS NULL OR list_contains(seg, c_mktsegment)) AND (lo IS NULL OR o_totalprice >= lo) AND (hi IS NULL OR o_totalprice < hi))
SELECT o_orderkey, seq, dest FROM h WHERE n = 1""")
def rule_first_match_route(spark, d):
    rules = spark.createDataFrame(ROUTES, "seq int, enabled boolean, seg array<string>, lo double, hi double, dest string")
    ok = lambda r: R.any_of(r["seg"], F.col("c_mktsegment")) & R.within(F.col("o_totalprice"), r["lo"], r["hi"])
    return R.first_match(movements(spark, d), rules, ok, "seq").select("o_orderkey", "seq", "dest")


@query(f"""WITH r(enabled, seg, lo, v) AS {_values(VALUES)}, {_M}
SELECT o_orderkey, coalesce(sum(v), 0)::DOUBLE AS total, count(v) AS matches FROM m LEFT JOIN r
  ON enabled AND (seg IS NULL OR list_contains(seg, c_mktsegment)) AND (lo IS NULL OR o_totalprice >= lo) GROUP BY o_orderkey""")
def rule_sum_valuation(spark, d):
    rules = spark.createDataFrame(VALUES, "enabled boolean, seg array<string>, lo double, v double")
    ok = lambda r: R.any_of(r["seg"], F.col("c_mktsegment")) & R.within(F.col("o_totalprice"), r["lo"], F.lit(None).cast("double"))
    return R.sum_matches(movements(spark, d), rules, ok, ["o_orderkey"], "v")


_TRUCKS = f"""WITH r(enabled, pri, lo, cls) AS {_values(TRUCKS)}, {_M}"""
_TRUCKS_ON = "enabled AND (pri IS NULL OR list_contains(pri, o_orderpriority)) AND (lo IS NULL OR o_totalprice >= lo)"


def _truck_rules(spark):
    rules = spark.createDataFrame(TRUCKS, "enabled boolean, pri array<string>, lo double, cls array<string>")
    return rules, lambda r: R.any_of(r["pri"], F.col("o_orderpriority")) & R.within(F.col("o_totalprice"), r["lo"], F.lit(None).cast("double"))


@query(f"{_TRUCKS} SELECT DISTINCT o_orderkey, unnest(cls) AS item FROM m JOIN r ON {_TRUCKS_ON}")
def rule_union_trucks(spark, d):
    rules, ok = _truck_rules(spark)
    return R.union_matches(movements(spark, d), rules, ok, ["o_orderkey"], "cls")


@query(f"{_TRUCKS} SELECT o_orderkey, 'no class' AS problem FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_TRUCKS_ON})")
def movements_without_class(spark, d):
    rules, ok = _truck_rules(spark)
    return R.unmatched(movements(spark, d), rules, ok).select("o_orderkey", F.lit("no class").alias("problem"))


@query(f"""{_TRUCKS}, v(enabled2, seg, lo2, v) AS {_values(VALUES)},
c AS (SELECT DISTINCT o_orderkey, o_totalprice, c_mktsegment, unnest(cls) AS cls FROM m JOIN r ON {_TRUCKS_ON})
SELECT o_orderkey, cls, coalesce(sum(v), 0)::DOUBLE AS value FROM c LEFT JOIN v
  ON enabled2 AND (seg IS NULL OR list_contains(seg, c_mktsegment)) AND (lo2 IS NULL OR o_totalprice >= lo2) GROUP BY o_orderkey, cls""")
def expand_candidates(spark, d):
    m = movements(spark, d)
    rules, ok = _truck_rules(spark)
    classes = R.union_matches(m, rules, ok, ["o_orderkey", "o_totalprice", "c_mktsegment"], "cls").withColumnRenamed("item", "cls")
    values = spark.createDataFrame(VALUES, "enabled boolean, seg array<string>, lo double, v double")
    pays = lambda r: R.any_of(r["seg"], F.col("c_mktsegment")) & R.within(F.col("o_totalprice"), r["lo"], F.lit(None).cast("double"))
    return R.sum_matches(classes, values, pays, ["o_orderkey", "cls"], "v").select("o_orderkey", "cls", F.col("total").alias("value"))


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000 AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')""")
def typed_conditions(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return rows.where(V.in_range(F.col("o_totalprice"), 100_000.0, 200_000.0, lo_inclusive=False) & V.has_label(F.col("o_orderpriority"), ["1-URGENT", "3-MEDIUM"])).select("o_orderkey")


#: kind, pit, bench, flitch: null covers everything below.
SCOPES = [("ground", 1, None, None), ("ground", 2, 3, None), ("ground", 3, 1, 2), ("pile", 1, None, None)]


@query(f"""WITH s(kind, pit, bench, flitch) AS {_values(SCOPES)},
b AS (SELECT p_partkey, 'ground' AS kind, p_partkey % 5 AS pit, p_size % 5 AS bench, p_size % 3 AS flitch FROM part)
SELECT p_partkey, s.pit AS scope_pit FROM b JOIN s ON s.kind = b.kind AND s.pit = b.pit AND (s.bench IS NULL OR s.bench = b.bench) AND (s.flitch IS NULL OR s.flitch = b.flitch)""")
def scope_cover(spark, d):
    scopes = spark.createDataFrame(SCOPES, "s_kind string, s_pit int, s_bench int, s_flitch int")
    b = table(spark, d, "part").select("p_partkey", F.lit("ground").alias("kind"), (F.col("p_partkey") % 5).alias("pit"), (F.col("p_size") % 5).alias("bench"), (F.col("p_size") % 3).alias("flitch"))
    near = lambda a, x: x.isNull() | (F.abs(a - x) < 1e-6)
    ok = (F.col("kind") == F.col("s_kind")) & (F.col("pit") == F.col("s_pit")) & near(F.col("bench"), F.col("s_bench")) & near(F.col("flitch"), F.col("s_flitch"))
    return b.join(F.broadcast(scopes), ok).select("p_partkey", F.col("s_pit").cast("int").alias("scope_pit"))


@query("""SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21')""")
def missing_references(spark, d):
    known = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Brand#13",), ("Brand#21",)], "p_brand string")
    return R.missing_references(table(spark, d, "part"), known, "p_brand")


WORK_FITS = [("dig", "shovel"), ("dig", "loader"), ("drill", "rig"), ("blast", "mpu")]


@query(f"""WITH f(work, kind) AS {_values(WORK_FITS)},
a AS (SELECT s_suppkey, ['dig', 'drill', 'blast', 'haul'][(s_suppkey % 4 + 1)::INT] AS work, ['shovel', 'rig', 'mpu'][(s_suppkey % 3 + 1)::INT] AS kind FROM supplier)
SELECT s_suppkey, work, kind, EXISTS (SELECT 1 FROM f WHERE f.work = a.work AND f.kind = a.kind) AS fits FROM a""")
def work_fits_machine(spark, d):
    fits = spark.createDataFrame(WORK_FITS, "work string, kind string").withColumn("fits", F.lit(True))
    s = table(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, ["dig", "drill", "blast", "haul"])), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("work"), F.element_at(F.array(*map(F.lit, ["shovel", "rig", "mpu"])), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("kind"))
    return s.join(F.broadcast(fits), ["work", "kind"], "left").select("s_suppkey", "work", "kind", F.coalesce("fits", F.lit(False)).alias("fits"))


@query("""SELECT c_mktsegment, round(sum(o_totalprice * coalesce(cost, 3.5)), 2) AS cost FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (VALUES ('1-URGENT', 9.0), ('2-HIGH', 7.25)) AS t(pri, cost) ON pri = o_orderpriority GROUP BY c_mktsegment""")
def cost_by_category_default(spark, d):
    costs = spark.createDataFrame([("1-URGENT", 9.0), ("2-HIGH", 7.25)], "o_orderpriority string, cost double")
    m = movements(spark, d).join(F.broadcast(costs), "o_orderpriority", "left")
    return m.groupBy("c_mktsegment").agg(F.round(F.sum(F.col("o_totalprice") * F.coalesce("cost", F.lit(3.5))), 2).alias("cost"))
