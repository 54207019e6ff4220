"""Scalar functions over part and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as X
from ..functions import time as D
from .registry import query, table


@query("""SELECT p_partkey, CASE WHEN p_retailprice <= b * 1 THEN b WHEN p_retailprice <= 2 * b THEN 2 * b WHEN p_retailprice <= 5 * b THEN 5 * b ELSE 10 * b END AS up
FROM (SELECT *, pow(10, floor(log10(p_retailprice))) AS b FROM part)""")
def round_up_series(spark, d):
    return table(spark, d, "part").select("p_partkey", M.round_up_to_series(F.col("p_retailprice")).alias("up"))


@query("""WITH g(i, grade, grams) AS (VALUES (0, 'percent', 10000.0), (1, 'ppm', 1.0), (2, 'g/t', 1.0), (3, 'ppb', 0.001), (4, 'kg/t', 1000.0)),
s(i, sales, per) AS (VALUES (0, 'gram', 1.0), (1, 'troy ounce', 31.1034768), (2, 'pound', 453.59237), (3, 'kilogram', 1000.0), (4, 'tonne', 1000000.0))
SELECT p_partkey, grade, sales, round(p_retailprice * grams::DOUBLE / per::DOUBLE + 0.0000123, 5) AS metal FROM part JOIN g ON g.i = p_partkey % 5 JOIN s ON s.i = p_size % 5""")
def metal_factors(spark, d):
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % 5 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", pick(list(M.GRADE_GRAMS), F.col("p_partkey")).alias("grade"), pick(list(M.SALES_GRAMS), F.col("p_size")).alias("sales"))
    return p.select("p_partkey", "grade", "sales", F.round(F.col("p_retailprice") * M.metal_factors(F.col("grade"), F.col("sales")) + 0.0000123, 5).alias("metal"))


@query("""SELECT p_partkey, round(CASE WHEN h <= 0 THEN 1.0 WHEN h >= 30 THEN 0.0 ELSE 0.9 * (1 - 1.5 * h / 30 + 0.5 * (h / 30) ** 3) END, 8)::DOUBLE AS cov FROM (SELECT p_partkey, (p_size - 1)::DOUBLE AS h FROM part)""")
def variogram(spark, d):
    h = (F.col("p_size") - 1).cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(M.spherical_covariance(h, 1.0, 0.1, 30.0), 8).alias("cov"))


@query("""SELECT p_partkey, round(p_retailprice * 1000000)::BIGINT AS um FROM part""")
def micrometre_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", M.micrometres(F.col("p_retailprice")).alias("um"))


@query("""SELECT p_partkey, list_sum(list_transform(range(0, 8), lambda i: ((p_size >> i) & 1) * (1::BIGINT << (2 * i)) + (((p_partkey % 256) >> i) & 1) * (1::BIGINT << (2 * i + 1))))::BIGINT AS code FROM part""")
def morton_codes(spark, d):
    return table(spark, d, "part").select("p_partkey", M.morton(F.col("p_size"), F.col("p_partkey") % 256, 8).alias("code"))


@query("""SELECT o_orderkey, format('{:,}', round(o_totalprice)::BIGINT) AS whole, regexp_replace(regexp_replace(format('{:.3f}', round(o_totalprice % 7, 3)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS plain,
  printf('%d:%02d', m // 60, m % 60) AS hours, CASE WHEN o_orderpriority LIKE '%-%' THEN 'seg:' || lower(o_orderpriority) END AS key
FROM (SELECT *, (o_orderkey % 3000)::BIGINT AS m FROM orders)""".replace("\\\\", "\\"))
def text_formats(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.quantity(F.round("o_totalprice", 0), 0).alias("whole"), X.plain(F.col("o_totalprice") % 7, 3).alias("plain"), X.hours(F.col("o_orderkey") % 3000 / 60.0).alias("hours"), X.namespaced("seg", F.col("o_orderpriority")).alias("key"))


@query("""WITH m AS (SELECT c_custkey, (c_acctbal + 0.0037) * pow(10, c_custkey % 8 - 1) AS v FROM customer), a AS (SELECT *, abs(v) AS a FROM m),
u AS (SELECT *, CASE WHEN a >= 1e9 THEN 'B' WHEN a >= 1e6 THEN 'M' WHEN a >= 1e3 THEN 'K' ELSE '' END AS unit, CASE WHEN a >= 1e9 THEN a / 1e9 WHEN a >= 1e6 THEN a / 1e6 WHEN a >= 1e3 THEN a / 1e3 ELSE a END AS s FROM a)
SELECT c_custkey, CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || CASE WHEN s >= 100 THEN printf('%.0f', s) WHEN s >= 10 THEN printf('%.1f', s) ELSE printf('%.2f', s) END || unit AS text FROM u""")
def money_texts(spark, d):
    c = table(spark, d, "customer").select("c_custkey", ((F.col("c_acctbal") + 0.0037) * F.pow(F.lit(10.0), F.col("c_custkey") % 8 - 1)).alias("v"))
    return c.select("c_custkey", X.money(F.col("v")).alias("text"))


@query(r"""SELECT p_partkey, regexp_replace(printf('%.3f', p_size / 8.0::DOUBLE), '(\.\d\d)0$', '\1') AS factor, regexp_replace(lower(trim(' ' || p_brand || ' (' || p_type || ')_' || p_name || ' ')), '[^a-z0-9]+', '', 'g') AS header FROM part""")
def factor_and_header_texts(spark, d):
    p = table(spark, d, "part")
    header = F.concat(F.lit(" "), "p_brand", F.lit(" ("), "p_type", F.lit(")_"), "p_name", F.lit(" "))
    return p.select("p_partkey", X.factor(F.col("p_size") / 8.0).alias("factor"), X.header_key(header).alias("header"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN p_name || ',' || p_brand WHEN 2 THEN 'say "' || p_name || '"' WHEN 3 THEN p_name || chr(10) || p_type WHEN 4 THEN p_name END AS v FROM part)
SELECT p_partkey, CASE WHEN v LIKE '%,%' OR v LIKE '%"%' OR contains(v, chr(10)) THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell FROM c""")
def csv_cells(spark, d):
    k = F.col("p_partkey") % 5
    v = F.when(k == 1, F.concat("p_name", F.lit(","), "p_brand")).when(k == 2, F.concat(F.lit('say "'), "p_name", F.lit('"'))).when(k == 3, F.concat("p_name", F.lit("\n"), "p_type")).when(k == 4, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.csv_cell(v).alias("cell"))


@query("""SELECT o_orderkey, TIMESTAMP '2024-01-01' + to_minutes((o_orderkey % 5000)::BIGINT) AS at, (o_orderkey % 5000 / 1440)::BIGINT AS unused FROM orders""".replace(", (o_orderkey % 5000 / 1440)::BIGINT AS unused", ""))
def date_time_at_hours(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.date_time_at(F.lit("2024-01-01").cast("date"), F.col("o_orderkey") % 5000 / 60.0).alias("at"))


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey % 11)::INT AS i, (o_orderkey % 27 + 1)::INT AS n, (o_orderkey % 24)::INT AS h, (o_orderkey % 60)::INT AS m FROM orders)
SELECT o_orderkey, CASE i WHEN 0 THEN n + 0.25 WHEN 1 THEN (n - 1) * 24 WHEN 2 THEN (n - 1) * 24 + h + m / 60.0::DOUBLE WHEN 3 THEN n * 24 WHEN 6 THEN (n - 1) * 24 + h + m / 60.0::DOUBLE WHEN 7 THEN (n - 1) * 24 END::DOUBLE AS hours FROM o""")
def parsed_times(spark, d):
    """Times in every form that is read, and in some that aren't: no day 0, no hour 25, no date before the first, no words, no blank."""
    k = F.col("o_orderkey")
    n, h, m = (k % 27 + 1).cast("int"), (k % 24).cast("int"), (k % 60).cast("int")
    texts = [F.format_string("%d.25", n), F.format_string("day %d", n), F.format_string("D%d %02d:%02d", n, h, m), F.format_string("Day %d 24:00", n), F.lit("day 0 01:00"), F.format_string("%d 25:00", n), F.format_string("%d/1/2024 %02d:%02d", n, h, m), F.format_string("2024-01-%02d", n), F.lit("31/12/2023"), F.lit("soon"), F.lit("")]
    text = F.element_at(F.array(*texts), (k % 11 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", D.parse_time(text, F.lit("2024-01-01").cast("date")).alias("hours"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS period, (o_custkey % 900) / 4.0::DOUBLE + 0.25 AS e FROM orders)
SELECT o_orderkey, CASE WHEN e - period * 24 > 0 THEN least(24, e - period * 24) END::DOUBLE AS hours, ceil(e / 24)::BIGINT AS covered FROM o""")
def coverage(spark, d):
    end = F.col("o_custkey") % 900 / 4.0 + 0.25
    return table(spark, d, "orders").select("o_orderkey", D.covered_hours(F.col("o_orderkey") % 9, end).alias("hours"), D.covered_periods(end).alias("covered"))


@query("""SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY length(p_name), p_partkey) AS n FROM part WHERE contains(lower(p_name), 'ed') AND contains(lower(p_name), 't')) WHERE n <= 20""")
def registry_search(spark, d):
    return table(spark, d, "part").where(X.matches_terms(F.col("p_name"), "ED t")).orderBy(F.length("p_name"), "p_partkey").limit(20).select("p_partkey", "p_name")


@query("""SELECT p_partkey, round(pi() * (p_size / 100.0::DOUBLE / 2) ** 2 * greatest(p_partkey % 12 - 3, 0) * 1.15::DOUBLE, 6) AS mass, CASE WHEN p_size % 2 = 0 THEN p_size / 24.0::DOUBLE ELSE p_size END::DOUBLE AS rate FROM part""")
def charge_and_rates(spark, d):
    p = table(spark, d, "part")
    mass = M.hole_charge(F.col("p_size") / 100.0, (F.col("p_partkey") % 12).cast("double"), F.lit(3.0), F.lit(1.15))
    return p.select("p_partkey", F.round(mass, 6).alias("mass"), M.hourly(F.col("p_size").cast("double"), F.col("p_size") % 2 == 0).alias("rate"))


@query("""SELECT event_id, (props ->> '$.k')::INT AS k FROM events""")
def json_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_size % 7)), ',') AS sizes FROM part GROUP BY p_brand""")
def column_sets(spark, d):
    s = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.col("p_size") % 7)).alias("s"))
    return s.select("p_brand", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sizes"))


@query("""WITH p AS (SELECT p_partkey, [p_size / 8.0::DOUBLE, (p_partkey % 5) / 2.0::DOUBLE, p_size / 8.0::DOUBLE, round(p_partkey % 7 + 0.0004, 3)] AS f FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(f, lambda x: x > 0))), ',') AS factors FROM p""")
def factor_lists(spark, d):
    k = F.col("p_partkey")
    text = F.concat((F.col("p_size") / 8.0).cast("string"), F.lit(", "), (k % 5 / 2.0).cast("string"), F.lit(";x "), (F.col("p_size") / 8.0).cast("string"), F.lit(","), (k % 7 + F.lit(0.0004)).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(X.factor_list(text), lambda x: x.cast("string")), ",").alias("factors"))
