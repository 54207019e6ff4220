"""Profiles, dictionaries, data quality and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import profile as P
from ..operators import spatial as SP
from ..operators.metrics import Metric
from ..operators.slots import SlotStore
from ..session import shared_folder
from .interval import events
from .registry import query, table


@query("""WITH l AS (SELECT 'p_size' AS attribute, p_size::DOUBLE AS v, NULL AS s FROM part UNION ALL SELECT 'p_retailprice', p_retailprice, NULL FROM part UNION ALL SELECT 'p_brand', NULL, p_brand FROM part UNION ALL SELECT 'p_type', NULL, p_type FROM part)
SELECT attribute, min(v) AS lo, max(v) AS hi, count(DISTINCT s) AS labels, count(*) AS used FROM l GROUP BY attribute""")
def attribute_profile(spark, d):
    return P.attribute_profile(table(spark, d, "part"), ["p_size", "p_retailprice"], ["p_brand", "p_type"])


@query("""SELECT p_type AS label, (row_number() OVER (ORDER BY min(p_partkey)) - 1)::BIGINT AS code FROM part GROUP BY p_type""")
def dictionary_codes(spark, d):
    return P.dictionary(table(spark, d, "part").withColumnRenamed("p_type", "label"), "label", ["p_partkey"])


@query("""WITH c AS (SELECT p_type, (row_number() OVER (ORDER BY min(p_partkey)) - 1)::BIGINT AS code FROM part GROUP BY p_type) SELECT p_partkey, code, p_type AS back FROM part JOIN c USING (p_type)""")
def dictionary_round_trip(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type")
    codes = P.dictionary(p, "p_type", ["p_partkey"])
    coded = P.encode(p, codes, "p_type").select("p_partkey", "code")
    return coded.join(codes.withColumnRenamed("p_type", "back"), "code")


@query("""SELECT k AS key, min(o_orderkey) AS line FROM (SELECT *, (o_custkey % 50)::DOUBLE AS k, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders) WHERE n = 2 GROUP BY k""")
def duplicate_id_check(spark, d):
    o = table(spark, d, "orders").select((F.when(F.col("o_custkey") % 100 == 0, F.lit(-0.0)).otherwise((F.col("o_custkey") % 50).cast("double"))).alias("key"), F.col("o_orderkey").alias("line"))
    return P.duplicates(o, "key", ["line"]).select("key", "line")


@query("SELECT count(*) AS orphans, count(DISTINCT o_custkey) AS keys FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)")
def orphan_rows(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 9 != 0").select(F.col("c_custkey").alias("o_custkey"))
    out = P.orphans(table(spark, d, "orders"), known, "o_custkey")
    return out.agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("o_custkey").alias("keys"))


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS first FROM part")
def first_of_equal(spark, d):
    return P.first_of_equal(table(spark, d, "part"), ["p_brand", "p_size"], "p_partkey").select("p_partkey", "first")


@query("SELECT c_custkey AS id, c_nationkey AS nation, 0 AS colour FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_nationkey % 3 FROM supplier")
def union_reconciled(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.lit(1).alias("cls"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), (F.col("s_nationkey") % 3).alias("colour"))
    return P.union_reconciled([c, s], {"colour": F.lit(0)}, ["cls"])


@query("""SELECT 'discount over 0.09' AS problem, count(*) FILTER (l_discount > 0.09) AS rows FROM lineitem UNION ALL SELECT 'quantity of 1', count(*) FILTER (l_quantity = 1) FROM lineitem""")
def constraint_problems(spark, d):
    return P.validate(table(spark, d, "lineitem"), {"discount over 0.09": F.col("l_discount") <= 0.09, "quantity of 1": F.col("l_quantity") != 1, "never": V.finite(F.col("l_tax"))})


@query("""SELECT p_size::DOUBLE AS x, (p_partkey % 10)::DOUBLE AS y, count(*) AS n, round(avg(p_retailprice), 4) AS z FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 GROUP BY ALL""")
def equal_position_means(spark, d):
    """A height in thirteen is missing, and one in seventeen is no number."""
    k = F.col("p_partkey")
    z = F.when(k % 13 == 0, None).when(k % 17 == 0, float("nan")).otherwise(F.col("p_retailprice"))
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), (k % 10).cast("double").alias("y"), z.alias("z"))
    return SP.position_means(p).select("x", "y", "n", F.round("z", 4).alias("z"))


@query("""WITH r AS (SELECT DISTINCT l_suppkey, l_partkey % 20 AS material, l_returnflag, l_linestatus, l_quantity FROM lineitem)
SELECT l_suppkey, l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, count(*) AS merged FROM r GROUP BY ALL""")
def equivalent_merge(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 20).alias("material"), "l_returnflag", "l_linestatus", "l_quantity")
    return P.merge_equivalent(rows, ["l_suppkey"], ["l_returnflag", "l_linestatus"], "l_quantity")


@query("SELECT event_type, (row_number() OVER (ORDER BY min(event_id)) - 1)::BIGINT AS code FROM events GROUP BY event_type")
def interned_ids(spark, d):
    return P.dictionary(events(spark, d), "event_type", ["event_id"])


@query("""WITH s AS (SELECT DISTINCT c_nationkey AS section, c_mktsegment || c_custkey % 40 AS code FROM customer)
SELECT section::BIGINT AS section, code, CASE WHEN n = 1 THEN 'kept' ELSE 'claimed' END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY section) AS n FROM s)""")
def section_claims(spark, d):
    s = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("section"), F.concat("c_mktsegment", F.col("c_custkey") % 40).alias("code"))
    return P.first_claims(s, "section", "code")


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment || c_custkey % 37 AS name FROM customer), t AS (SELECT * FROM c WHERE id % 2 = 0), i AS (SELECT * FROM c WHERE id % 2 = 1),
n AS (SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY id) AS id, name, row_number() OVER (PARTITION BY name ORDER BY id) + CASE WHEN name IN (SELECT name FROM t) THEN 1 ELSE 0 END AS k FROM i)
SELECT id, name, 'target' AS origin FROM t UNION ALL SELECT id, CASE WHEN k > 1 THEN name || ' (' || k || ')' ELSE name END, 'imported' FROM n""")
def project_merge(spark, d):
    """Customers with even keys are the project, those with odd ones come in."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.col("c_custkey") % 37).alias("name"))
    return P.merge_projects(c.where("id % 2 = 0"), c.where("id % 2 = 1"))


@query("""WITH k AS (SELECT l_suppkey % 4 AS slot, sum(l_quantity) AS t FROM lineitem WHERE l_suppkey % 4 < 2 GROUP BY slot) SELECT slot, t, 'kept' AS origin FROM k UNION ALL SELECT l_suppkey % 4, sum(l_quantity), 'new' FROM lineitem WHERE l_suppkey % 4 >= 2 GROUP BY l_suppkey % 4""")
def incremental_reuse(spark, d):
    """Slots 2 and 3 get the rest of their rows after a first refresh; the second one reads these two alone."""
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("slot"), F.col("l_quantity").cast("double").alias("q"), "l_linenumber")
    base = f"{shared_folder(spark)}/slots-{uuid.uuid4().hex}"
    late = (F.col("slot") >= 2) & (F.col("l_linenumber") > 1)
    rows.where(~late).write.partitionBy("slot").parquet(f"{base}/rows")
    store = SlotStore(spark, f"{base}/kept", [Metric("t", "sum", "q")], [])
    store.refresh(f"{base}/rows")
    rows.where(late).write.mode("append").partitionBy("slot").parquet(f"{base}/rows")
    got = store.figures(store.refresh(f"{base}/rows"), ["slot", "origin"])
    return got.select(F.col("slot").cast("bigint").alias("slot"), "t", "origin")
