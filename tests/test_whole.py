"""Queries over whole tables: every row counts, and results are those of plain Python."""

import heapq
from collections import defaultdict

import numpy as np
import pytest

from strataframe.operators import intervals, series
from strataframe.plans import closure
from strataframe.queries import QUERIES, graphs, interval

from .conftest import SF


@pytest.fixture(scope="module")
def orders(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/orders.parquet").collect()]


def test_no_order_is_left_out_of_the_spans(spark, orders):
    by = defaultdict(list)
    for r in interval.whole(spark, SF).collect():
        by[r["loader"]].append((r["start"], r["end"]))
    assert sum(map(len, by.values())) == len(orders)
    islands, gaps, hours = [], [], {}
    for k, x in by.items():
        runs = []
        for s, e in sorted(x):
            if runs and s <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(e, runs[-1][1]), runs[-1][2] + 1)
            else:
                runs.append((s, e, 1))
        islands += [(k, *r) for r in runs]
        gaps += [(k, a[1], b[0]) for a, b in zip(runs, runs[1:])]
        hours[k] = sum(e - s for s, e, _ in runs)
    got = QUERIES["coalesce_spans"](spark, SF)
    assert sorted((r["loader"], r["start"], r["end"], r["n"]) for r in got.collect()) == sorted(islands)
    assert sum(n for *_, n in islands) == len(orders) and gaps
    assert sorted((r["loader"], r["start"], r["end"]) for r in QUERIES["idle_gaps"](spark, SF).collect()) == sorted(gaps)
    assert {r["loader"]: r["hours"] for r in QUERIES["busy_union_hours"](spark, SF).collect()} == hours
    account = QUERIES["loader_time_accounting"](spark, SF).collect()
    assert {r["loader"]: r["busy"] for r in account} == hours
    priority = {"1-URGENT": "urgent", "5-LOW": "low"}
    for p, column in priority.items():
        want = sum(r["o_orderkey"] % 72 + 1 for r in orders if r["o_orderpriority"] == p)
        assert sum(r[column] or 0 for r in account) == want


def winners(spans):
    """(key, start, end, winner) by trying every span on every cell."""
    out = []
    for k in sorted({s[0] for s in spans}):
        mine = [s[1:] for s in spans if s[0] == k]
        cuts = sorted({t for s in mine for t in s[:2]})
        for at, to in zip(cuts, cuts[1:]):
            over = [(e - s, o) for s, e, o in mine if s <= at and e >= to]
            if over:
                o = min(over)[1]
                if out and out[-1][0] == k and out[-1][2] == at and out[-1][3] == o:
                    out[-1] = (k, out[-1][1], to, o)
                else:
                    out.append((k, at, to, o))
    return out


def test_the_sweep_is_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(s), float(s + n), i) for i, (k, s, n) in enumerate(zip(rng.integers(0, 3, 150), rng.integers(-40, 40, 150), rng.integers(0, 30, 150)))]
    df = spark.createDataFrame(rows, "k int, start double, end double, o long")
    want = winners(rows)
    for width in (7.0, 16.0, 1024.0):
        got = intervals.elementary_winner(df, ["k"], "o", width)
        assert sorted((r["k"], r["start"], r["end"], r["winner"]) for r in got.collect()) == want


def test_every_order_competes_and_every_loader_has_intervals(spark, orders):
    rows = [(r["loader"], r["start"], r["end"], r["o_orderkey"]) for r in interval.spans(spark, SF).collect()]
    assert len(rows) == len(orders)
    got = QUERIES["elementary_sweep_winner"](spark, SF).collect()
    assert sorted((r["loader"], r["start"], r["end"], r["winner"]) for r in got) == winners(rows)
    cells = QUERIES["build_intervals"](spark, SF).collect()
    want = []
    for k in sorted({x[0] for x in rows}):
        cuts = sorted({t for x in rows if x[0] == k for t in x[1:3]})
        want += [(k, *c) for c in zip(cuts, cuts[1:])]
    assert sorted((r["loader"], r["start"], r["end"]) for r in cells) == want


def test_far_holes_fire_and_their_ties_flow(spark, tmp_path):
    spark.range(1, 301).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    ties = [(r["a"], r["b"], r["ms"]) for r in graphs.ties(spark, str(tmp_path)).collect()]
    near = defaultdict(list)
    for a, b, ms in ties:
        near[a].append((b, ms))
        near[b].append((a, ms))
    cost, heap = {}, [(0, 1)]
    while heap:
        c, a = heapq.heappop(heap)
        if a not in cost:
            cost[a] = c
            for b, ms in near[a]:
                heapq.heappush(heap, (c + ms, b))
    assert max(cost.values()) > 260
    assert {r["node"]: r["cost"] for r in QUERIES["firing_times"](spark, str(tmp_path)).collect()} == cost
    flow = {(r["a"], r["b"]): r["flow"] for r in QUERIES["tie_flow"](spark, str(tmp_path)).collect()}
    side = lambda a, b: "dead" if a not in cost or b not in cost else "forward" if cost[a] < cost[b] else "backward" if cost[a] > cost[b] else "together"
    assert flow == {(a, b): side(a, b) for a, b, _ in ties}


def test_every_part_is_a_block_of_a_pit(spark, tmp_path):
    parts = [(i, (i * 7919) % 50 + 1) for i in range(1, 351)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    want = set()
    for scenario in range(8):
        mine = {i % 100: n for i, n in parts if i // 100 == scenario // 2}
        shells = closure.nested_shells({b: n * (scenario % 2 + 2) for b, n in mine.items()}, {b: b % 7 * 12 + 20 for b in mine}, closure.pattern((5, 5, 4)), [0.6, 0.8, 1.0])
        assert shells
        want |= {(scenario, b, s) for b, s in shells.items()}
    got = QUERIES["nested_shells"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["scenario"], r["block"], r["shell"]) for r in got} == want


def test_empty_buckets_are_filled_from_every_user(spark, tmp_path):
    rows = [(i, t, u, k, v) for i, (t, u, k, v) in enumerate([(0, 1, "a", 1.0), (40_000, 900, "a", 5.0), (41_000, 25, "a", -3.0), (2_000_000, 77, "a", 2.0), (500_000, 500, "b", 8.0)])]
    spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").selectExpr("event_id", "cast(timestamp_seconds(s) as timestamp_ntz) ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["event_type"], r["bucket"]): (r["lo"], r["hi"]) for r in QUERIES["envelope_buckets"](spark, str(tmp_path)).collect()}
    want = {}
    for k in "ab":
        mine = [(t, v) for _, t, _, x, v in rows if x == k]
        for b in range(100):
            inside = [v for t, v in mine if t // 25920 == b]
            middle = (b + 0.5) * 25920
            near = min(mine, key=lambda x: (abs(x[0] - middle), x[0]))[1]
            want[k, b] = (min(inside), max(inside)) if inside else (near, near)
    assert got == want


def test_ranks_by_ranges_are_one_order(spark):
    rows = [(None if i % 17 == 0 else f"k{i * 7919 % 41}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(5)
    want = {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])), 1)}
    for ranges in (1, 2, 64):
        assert {r["i"]: r["place"] for r in series.ranked(df, ["k", "i"], ranges).collect()} == want


def test_no_part_or_event_is_left_out(spark, tmp_path):
    spark.createDataFrame([(i, f"rock {i % 13}", i % 29) for i in range(1, 1201)], "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    places = [r["place"] for r in QUERIES["natural_sort"](spark, str(tmp_path)).collect()]
    assert sorted(places) == list(range(1, 1201))
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert QUERIES["json_properties"](spark, SF).count() == events.count() > 500
