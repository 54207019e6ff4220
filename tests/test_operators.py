"""Edge rows of operators that have no SQL, or that the tables don't hold."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import geometry as G
from strataframe.functions import values as V
from strataframe.operators import graph, intervals, ledger, metrics, rules, series, spatial
from strataframe.plans.closure import max_closure, nested_shells, pattern
from strataframe.streaming import windows


def test_missing_is_never_zero(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", float("nan"), 2.0), ("b", 3.0, 0.0), ("b", 5.0, -1.0), ("c", 2.0, 3.0), ("c", -4.0, 1.0), ("c", float("inf"), 1.0)], "k string, v double, w double")
    m = [metrics.Metric("s", "sum", "v"), metrics.Metric("a", "weighted", "v", "w")]
    got = {r["k"]: r for r in metrics.totals(df, m, ["k"]).collect()}
    assert got["a"]["s"] is None and got["a"]["s_missing"] == 2
    assert got["b"]["s"] == 8 and got["b"]["a"] is None and got["b"]["a_unusable"] == 2 and got["b"]["a_max"] == 5
    assert got["c"]["s"] == -2 and got["c"]["a"] == 0.5 and got["c"]["s_missing"] == 1


def test_sentinels_are_exact(spark):
    df = spark.createDataFrame([(-99.0,), (-999.0,), (-98.9,), (-0.0,), (None,), (float("nan"),), (float("-inf"),), (7.0,)], "v double")
    assert [r[0] for r in df.where(V.usable(F.col("v"), default=7.0)).collect()] == [-98.9, 0.0]
    assert df.where(V.in_range(F.col("v"), -99, 0, False, True)).count() == 2


def test_touching_and_nested_spans(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 3.0), (1, 0.5, 1.0), (1, 5.0, 5.0), (1, 7.0, 8.0)], "k int, start double, end double")
    assert sorted(tuple(r)[1:] for r in intervals.coalesce_spans(df, ["k"]).collect()) == [(0.0, 3.0, 3), (7.0, 8.0, 1)]
    assert [tuple(r)[1:] for r in intervals.gaps(df, ["k"]).collect()] == [(3.0, 7.0)]
    parts = intervals.apportion(spark.createDataFrame([(20.0, 52.0, 32.0), (24.0, 24.0, 5.0)], "start double, end double, t double"), "t")
    assert sorted((r["period"], r["share"]) for r in parts.collect()) == [(0, 4.0), (1, 5.0), (1, 24.0), (2, 4.0)]


def test_overlap_join_gives_each_pair_once(spark):
    rng = np.random.default_rng(1)
    a = [(int(i), float(s), float(s + w)) for i, (s, w) in enumerate(zip(rng.uniform(0, 90, 60), rng.uniform(0, 40, 60), strict=True))]
    left, right = spark.createDataFrame(a, "i int, start double, end double"), spark.createDataFrame(a, "j int, r_start double, r_end double")
    got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(left, right, 10.0).collect())
    assert got == sorted((i, j) for (i, s, e), (j, x, y) in itertools.product(a, a) if s < y and x < e and s < e and x < y)


def test_asof_takes_nulls_of_the_last_step(spark):
    facts = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 5.0)], "k int, t double")
    steps = spark.createDataFrame([(1, 1.0, 7.0), (1, 3.0, None)], "k int, s double, v double")
    got = {r["t"]: r["v"] for r in intervals.asof(facts, steps, ["k"], "t", "s", ["v"], {"v": -1.0}).collect()}
    assert got == {0.5: -1.0, 1.0: 7.0, 5.0: None}


def test_rules_with_no_match_and_bad_values(spark):
    facts = spark.createDataFrame([(1, 5.0), (2, None)], "id int, v double")
    table = spark.createDataFrame([(True, 0.0, 2.0), (False, 0.0, 9.0)], "enabled boolean, lo double, x double")
    got = {r["id"]: (r["total"], r["matches"]) for r in rules.sum_matches(facts, table, lambda r: rules.within(F.col("v"), r["lo"], F.lit(None).cast("double")), ["id"], "x").collect()}
    assert got == {1: (2.0, 1), 2: (0.0, 0)}
    with pytest.raises(Exception, match="finite"):
        rules.sum_matches(facts, spark.createDataFrame([(True, 0.0, float("inf"))], table.schema), lambda r: F.lit(True), ["id"], "x").collect()


def test_a_blank_does_not_break_a_run(spark):
    df = spark.createDataFrame([("h", 0, 1, "A"), ("h", 1, 2, None), ("h", 2, 3, "A"), ("h", 3, 4, "B"), ("h", 4, 5, "A")], "k string, `from` int, `to` int, code string")
    got = series.code_runs(df, ["k"], ["from"], "code", ["A"]).orderBy("run").collect()
    assert [(r["roof"], r["floor"], r["runs"]) for r in got] == [(0, 3, 2), (4, 5, 2)]


def test_empty_envelope_buckets_take_the_nearest(spark):
    df = spark.createDataFrame([("h", 0.0, 1.0), ("h", 0.5, 3.0), ("h", 9.0, 7.0)], "k string, d double, v double")
    got = {r["bucket"]: (r["lo"], r["hi"]) for r in series.envelope(df, ["k"], "d", "v", 0.0, 10.0, 5).collect()}
    assert got == {0: (1.0, 3.0), 1: (3.0, 3.0), 2: (7.0, 7.0), 3: (7.0, 7.0), 4: (7.0, 7.0)}


def test_ledgers(spark):
    lots = spark.createDataFrame([(1, 1, 10.0), (1, 2, 5.0)], "pile int, t long, v double")
    draws = spark.createDataFrame([(1, 3, 12.0), (1, 4, 9.0)], "pile int, t long, v double")
    assert sorted(tuple(r)[1:] for r in ledger.fifo(lots, draws, "pile", "t", "v").collect()) == [(1, 3, 10.0), (2, 3, 2.0), (2, 4, 3.0)]
    e = spark.createDataFrame([(1, 1, 0, 10.0), (1, 2, 0, 5.0), (1, 3, 1, 7.0), (1, 4, 0, 1.0), (1, 5, 1, 20.0)], "pile int, `order` long, kind int, amount double")
    assert sorted(tuple(r)[1:] for r in ledger.lifo(e, "pile").collect()) == [(1, 3, 2.0), (1, 5, 8.0), (2, 3, 5.0), (4, 5, 1.0)]


def test_max_closure_is_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = 8
        values = {i: int(v) for i, v in enumerate(rng.integers(-9, 10, n))}
        needs = [(int(a), int(b)) for a, b in rng.integers(0, n, (9, 2)) if a != b]
        best = max(sum(values[i] for i in s) for k in range(n + 1) for s in itertools.combinations(range(n), k) if all(b in s for a, b in needs if a in s))
        got = max_closure(values, needs)
        assert sum(values[i] for i in got) == best and all(b in got for a, b in needs if a in got)


def test_shells_nest():
    rng = np.random.default_rng(6)
    rev, cost = {i: int(rng.integers(0, 90)) for i in range(48)}, {i: int(rng.integers(5, 60)) for i in range(48)}
    needs = pattern((4, 4, 3))
    shells = nested_shells(rev, cost, needs, [0.5, 0.8, 1.0])
    for k, factor in enumerate([0.5, 0.8, 1.0]):
        assert {b for b, s in shells.items() if s <= k} == max_closure({b: round(rev[b] * factor) - cost[b] for b in rev}, needs)


def test_kriging_is_exact_at_samples_and_blank_without_enough(spark):
    s = spark.createDataFrame([(i, float(i % 3), float(i // 3), 0.0, float(i)) for i in range(9)], "sample long, x double, y double, z double, v double")
    t = spark.createDataFrame([(0, 1.0, 1.0, 0.0), (1, 50.0, 50.0, 0.0), (2, 2.2, 2.2, 0.0)], "target long, x double, y double, z double")
    got = {r["target"]: r["estimate"] for r in spatial.krige(t, s, 1.5, 8, 3, 1.0, 0.0, 3.0).collect()}
    assert got[0] == pytest.approx(4.0, abs=1e-6) and 1 not in got and got[2] is not None
    few = {r["target"]: r["estimate"] for r in spatial.krige(t, s, 0.5, 8, 3, 1.0, 0.0, 3.0).collect()}
    assert few[0] is None


def test_nearest_breaks_ties_by_sample(spark):
    s = spark.createDataFrame([(i, x, 0.0, 0.0, 1.0) for i, x in ((5, 1.0), (3, -1.0), (9, 0.5))], "sample long, x double, y double, z double, v double")
    t = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "target long, x double, y double, z double")
    assert [r["sample"] for r in spatial.nearest(t, s, 2.0, 3).orderBy("place").collect()] == [9, 3, 5]


def test_paths_and_flow(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (1, 3, 9.0), (4, 5, 1.0)], "src long, dst long, w double")
    got = {r["node"]: r["cost"] for r in graph.shortest_paths(e, spark.createDataFrame([(1, 0.0)], "node long, cost double")).collect()}
    assert got == {1: 0.0, 2: 5.0, 3: 6.0}
    flow = graph.tie_flow(spark.createDataFrame([(1, 2), (3, 2), (4, 5)], "a long, b long"), spark.createDataFrame(list(got.items()), "node long, cost double"))
    assert {(r["a"], r["b"]): r["flow"] for r in flow.collect()} == {(1, 2): "forward", (3, 2): "backward", (4, 5): "dead"}


def test_contours_do_not_double_shared_corners(spark):
    p = lambda x, y, z: (float(x), float(y), float(z))
    tri = spark.createDataFrame([(0, p(0, 0, 0), p(1, 0, 1), p(0, 1, 2)), (1, p(0, 0, 1), p(1, 0, 1), p(0, 1, 1))], "face int, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>")
    got = spatial.contour_segments(tri, [1.0, 2.0]).collect()
    assert [(r["face"], r["level"]) for r in got] == [(0, 1.0)]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    row = spark.range(1).select(G.shoelace(ring).alias("a"), G.in_ring(ring, F.lit(1.0), F.lit(1.0)).alias("i"), G.in_ring(ring, F.lit(3.0), F.lit(1.0)).alias("o")).first()
    assert (row["a"], row["i"], row["o"]) == (4.0, True, False)


def test_stateful_balances(spark, tmp_path):
    spark.createDataFrame([("a", 5.0), ("a", -9.0), ("b", 2.0)], "k string, c double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = windows.file_stream(spark, str(tmp_path / "in"), "k string, c double")
    got = {r["k"]: r["balance"] for r in windows.run_to_table(windows.balances(s, "k", "c"), "update").collect()}
    assert got == {"a": 0.0, "b": 2.0}


def test_first_match_of_rows_that_share_a_key(spark):
    facts = spark.createDataFrame([(1, 5.0), (1, 50.0), (1, 5.0), (2, None)], "k int, v double")
    table = spark.createDataFrame([(2, True, 10.0, "high"), (1, False, 0.0, "off"), (3, True, 20.0, "later"), (None, True, 0.0, "any")], "seq int, enabled boolean, lo double, name string")
    ok = lambda r: rules.within(F.col("v"), r["lo"], F.lit(None).cast("double"))
    got = sorted((r["k"], r["v"] or 0, r["name"] or "") for r in rules.first_match(facts, table, ok, "seq").collect())
    assert got == [(1, 5.0, "any"), (1, 5.0, "any"), (1, 50.0, "high"), (2, 0, "")]
    assert [r["name"] for r in rules.first_match(facts, table.where("false"), ok, "seq").collect()] == [None] * 4
    assert rules.unmatched(facts, table, ok).count() == 1
    plan = rules.first_match(facts, table, ok, "seq")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "hashpartitioning" not in plan


def test_rules_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(rules, "RULE_LIMIT", 7)
    facts = spark.range(40).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v"))
    table = spark.createDataFrame([(i, True, 40.0 - 2 * i, float(i), [f"c{i % 3}"]) for i in range(20)], "seq int, enabled boolean, lo double, x double, cls array<string>")
    ok = lambda r: rules.within(F.col("v"), r["lo"], F.lit(None).cast("double"))
    first = {r["k"]: r["seq"] for r in rules.first_match(facts, table, ok, "seq").collect()}
    hits = {k: [i for i in range(20) if k >= 40 - 2 * i] for k in range(40)}
    assert first == {k: (h or [None])[0] for k, h in hits.items()}
    assert {r["k"]: (r["total"], r["matches"]) for r in rules.sum_matches(facts, table, ok, ["k"], "x").collect()} == {k: (float(sum(h)), len(h)) for k, h in hits.items()}
    assert {(r["k"], r["item"]) for r in rules.union_matches(facts, table, ok, ["k"], "cls").collect()} == {(k, f"c{i % 3}") for k, h in hits.items() for i in h}


def test_intervals_of_close_points(spark):
    points = spark.createDataFrame([("a", x) for x in (0.0, 0.6, 1.2, 1.8, 2.4, 9.0, 9.0)] + [("b", 5.0), ("b", None)], "k string, at double")
    got = sorted(tuple(r) for r in intervals.build_intervals(points, tolerance=1.0, keys=["k"]).collect())
    assert got == [("a", 0.0, 1.2), ("a", 1.2, 2.4), ("a", 2.4, 9.0)]
