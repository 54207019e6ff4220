"""Operators of blasting, haulage and solids on rows of known answers, and small functions that no query reaches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import geometry, maths, text, values
from strataframe.operators import blasting, depletion, haulage, intervals, metrics, series, solids
from strataframe.sources import files, tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


TETRA = [((0, 0, 0), (0, 1, 0), (1, 0, 0)), ((0, 0, 0), (1, 0, 0), (0, 0, 1)), ((0, 0, 0), (0, 0, 1), (0, 1, 0)), ((1, 0, 0), (0, 1, 0), (0, 0, 1))]


def faces(mesh, scale=1.0, shift=(0.0, 0.0, 0.0)):
    return [tuple(tuple(x * scale + s for x, s in zip(p, shift)) for p in f) for f in mesh]


def volume(lo, hi, mesh):
    box = lambda p: np.tile(np.array(p, float), (len(mesh), 1))
    return solids.column_volumes(box(lo), box(hi), np.array(mesh, float)).sum()


def test_column_volumes_of_a_tetrahedron():
    mesh = faces(TETRA, 6.0)
    assert volume((-1, -1, -1), (7, 7, 7), mesh) == pytest.approx(36.0)
    assert volume((-1, -1, -1), (7, 7, 3), mesh) == pytest.approx(36.0 * (1 - 1 / 8))
    assert sum(volume((x, y, z), (x + 1, y + 1, z + 1), mesh) for x in range(6) for y in range(6) for z in range(6)) == pytest.approx(36.0)
    assert volume((5, 5, 5), (6, 6, 6), mesh) == pytest.approx(0.0)


def mesh_of(spark, pieces):
    rows = [(n, *[float(x) for p in f for x in p]) for n, fs in pieces for f in fs]
    return spark.createDataFrame(rows, "piece string, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))


def test_broken_meshes_are_errors(spark):
    block = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 6.0, 6.0, 6.0)], "block int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    good = faces(TETRA, 6.0)
    open_, inward = good[:3], [(f[0], f[2], f[1]) for f in good]
    found = solids.mesh_problems(mesh_of(spark, [("good", good), ("open", open_), ("inward", inward), ("twice", good + good)]))
    assert sorted(tuple(r) for r in found.collect()) == [("inward", "inward"), ("open", "open")]
    for bad in (open_, inward):
        with pytest.raises(ValueError, match="orientation and closure"):
            solids.piece_fractions(block, mesh_of(spark, [("x", bad)]), 10.0)
    # unchecked, and a mesh that covers the same ground twice: the figure itself is out of range
    inner = spark.createDataFrame([(1, 0.1, 0.1, 0.1, 0.5, 0.5, 0.5)], block.schema)
    for bad, check in ((inward, False), (good + good, True)):
        with pytest.raises(Exception, match="invalid overlap fraction"):
            solids.piece_fractions(inner, mesh_of(spark, [("x", bad)]), 10.0, check=check).collect()


def test_fractions_in_a_tilted_model(spark):
    """The same bodies, turned with the model: fractions don't change, and blocks of a grid sum to the body."""
    a, b = 0.6, -1.1
    ca, sa, cb, sb = math.cos(a), math.sin(a), math.cos(b), math.sin(b)
    axes = np.array([[ca, sa, 0], [-sa * cb, ca * cb, sb], [sa * sb, -ca * sb, cb]])
    origin = np.array([1000.0, -500.0, 30.0])
    local = [("t", faces(TETRA, 6.0)), ("u", faces(TETRA, 3.0, (2.5, 1.5, 0.25)))]
    world = [(n, [tuple(tuple(np.array(p) @ axes + origin) for p in f) for f in fs]) for n, fs in local]
    blocks = spark.createDataFrame([(i, float(i % 6), float(i // 6 % 6), float(i // 36), i % 6 + 1.0, i // 6 % 6 + 1.0, i // 36 + 1.0) for i in range(216)], "block int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    want = {(r["block"], r["piece"]): r["fraction"] for r in solids.piece_fractions(blocks, mesh_of(spark, local), 2.5).collect()}
    got = {(r["block"], r["piece"]): r["fraction"] for r in solids.piece_fractions(blocks, mesh_of(spark, world), 2.5, least=1e-6, rotation=axes.tolist(), origin=origin.tolist()).collect()}
    assert all(got.get(k, 0) == pytest.approx(v, abs=1e-5) for k, v in want.items()) and sum(got.values()) == pytest.approx(40.5, abs=1e-5)
    assert {r["block"] for r in solids.over_budget(solids.piece_fractions(blocks, mesh_of(spark, [*local, ("v", local[0][1])]), 2.5)).collect()}


def test_fractions_of_meshes_over_cells(spark):
    blocks = spark.createDataFrame([(i, float(i % 6), float(i // 6 % 6), float(i // 36), i % 6 + 1.0, i // 6 % 6 + 1.0, i // 36 + 1.0) for i in range(216)] + [(999, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)], "block int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    rows = [(n, *[x for p in f for x in p]) for n, k, s in (("t", 6.0, (0, 0, 0)), ("u", 3.0, (2.5, 1.5, 0.25))) for f in faces(TETRA, k, s)]
    mesh = spark.createDataFrame(rows, "piece string, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    got = solids.piece_fractions(blocks, mesh, 2.5)
    volume = {r["piece"]: r["v"] for r in got.groupBy("piece").agg(F.sum("fraction").alias("v")).collect()}
    assert volume == pytest.approx({"t": 36.0, "u": 4.5})
    assert got.where("fraction > 1 OR fraction <= 0").count() == 0
    assert solids.piece_fractions(blocks.where("false"), mesh, 2.5).count() == 0 == solids.piece_fractions(blocks, mesh.where("false"), 2.5).count()


def test_decks_without_a_fill_run_to_the_toe(spark):
    holes = spark.createDataFrame([(1, 0.0, 10.0), (2, 1.0, 4.0), (3, 2.0, 2.0)], "hole long, top double, bottom double")
    decks = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (3, "c", 9.0)], "seq long, product string, length double")
    got = sorted((r["hole"], r["seq"] or 0, r["from"], r["to"], r["problem"]) for r in blasting.lay_decks(holes, decks).collect())
    assert got == [(1, 1, 0.0, 2.0, None), (1, 2, 2.0, 5.0, None), (1, 3, 5.0, 10.0, None), (2, 1, 1.0, 3.0, None), (2, 2, 3.0, 4.0, None), (3, 0, None, None, "no depth")]


def test_lowest_unused_numbers(spark):
    used = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4), ("a", -3), ("c", 7)], "k string, n int")
    wanted = spark.createDataFrame([("a", 10), ("a", 11), ("a", 12), ("b", 1), ("b", 2), ("c", 1)], "k string, id int")
    got = sorted(tuple(r) for r in blasting.lowest_unused(used, wanted, ["k"], "n", ["id"]).select("k", "id", "n").collect())
    assert got == [("a", 10, 3), ("a", 11, 5), ("a", 12, 6), ("b", 1, 1), ("b", 2, 2), ("c", 1, 1)]


def test_stages_and_shares(spark):
    at = [F.lit(x).cast("double") for x in (5.0, 7.0, None)]
    stage = lambda t: one(spark, blasting.stage_at(F.lit(None).cast("double"), at, ["prepped", "drilled", "charged"], F.lit(t)))[0]
    assert [stage(t) for t in (4.0, 5.0, 9.0)] == ["not started", "prepped", "drilled"]
    s = spark.createDataFrame([(0.0, 10.0, 100.0), (5.0, 5.0, 9.0)], "start double, end double, q double")
    assert [r[0] for r in s.select(blasting.worked(s, "q", F.lit(2.0), F.lit(4.0))).collect()] == [20.0, 0.0]


def test_network_joins_and_limits(spark, monkeypatch):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 10.0, 0.0, 5.0), (3, 0.0, 20.0, 0.0)], "node long, x double, y double, z double")
    blocks = spark.createDataFrame([(7, 9.0, 0.0, 0.0), (8, 9.0, 0.0, 0.0), (9, 9.0, 0.0, 0.0)], "block long, x double, y double, z double")
    links = spark.createDataFrame([(8, 2), (8, 3), (9, 44)], "block long, node long")
    got = sorted(tuple(r) for r in haulage.network_joins(blocks, links, nodes, 0.1).collect())
    assert [(b, n) for b, n, _ in got] == [(7, 1), (8, 2), (8, 3), (9, 1)] and got[1][2] == pytest.approx(50.0)
    assert haulage.network_joins(blocks, links, nodes.where("false"), 0.1).count() == 0
    monkeypatch.setattr(haulage, "FEW_NODES", 2)
    assert sorted(tuple(r) for r in haulage.network_joins(blocks, links, nodes, 0.1).collect()) == got
    assert one(spark, haulage.acceleration_loss(F.lit(36.0), 0.5))[0] == pytest.approx(0.01)


def test_the_nearest_node_of_a_large_network(spark):
    rng = random.Random(3)
    nodes = [(i, rng.choice([rng.uniform(0, 10), rng.uniform(0, 1000)]), rng.uniform(0, 40), rng.choice([0.0, 0.0, 30.0])) for i in range(400)] + [(500, 5.0, 5.0, 1.0), (501, 5.0, 5.0, 1.0)]
    blocks = [(i, rng.uniform(-3000, 5000), rng.uniform(-50, 90), rng.uniform(0, 40)) for i in range(150)] + [(900, 5.0, 5.0, 1.0)]
    metres = lambda b, n: max(math.dist(b[1:], n[1:]), abs(b[3] - n[3]) / 0.1)
    want = {b[0]: min((metres(b, n), n[0]) for n in nodes)[::-1] for b in blocks}
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, x double, y double, z double")
    got = {r["block"]: (r["node"], r["metres"]) for r in haulage.nearest_nodes(df(blocks, "block"), df(nodes, "node"), 0.1).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    for few in ((blocks, []), ([], nodes)):
        assert haulage.nearest_nodes(df(few[0], "block"), df(few[1], "node"), 0.1).count() == 0


def test_percentiles_are_by_rank_in_any_distribution(spark):
    rng = random.Random(4)
    rows = [("flat", rng.random()) for _ in range(500)] + [("one", 3.0)] * 40 + [("far", 10.0 ** rng.randint(0, 9)) for _ in range(300)] + [("none", None), ("alone", 5.0), ("flat", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for bins in (1, 4, 4096):
        got = {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in series.rank_percentile(df, ["k"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.99}, bins).collect()}
        for k in ("flat", "one", "far", "alone"):
            v = sorted(x for n, x in rows if n == k and x is not None)
            assert got[k] == tuple(v[math.floor((len(v) - 1) * p + 0.5)] for p in (0.01, 0.5, 0.99)), (bins, k)
        assert "none" not in got


@pytest.mark.parametrize("width", [3.0, 1024.0])
def test_spans_merge_over_stretches(spark, width):
    rng = random.Random(9)
    spans = [("a", s, s + rng.choice([0.0, 1.0, 2.0, 40.0])) for s in (rng.randrange(0, 400) * 1.0 for _ in range(80))]
    want = []
    for _, s, e in sorted(x for x in spans if x[2] > x[1]):
        if want and s <= want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], e), want[-1][2] + 1)
        else:
            want.append((s, e, 1))
    df = spark.createDataFrame(spans, "k string, start double, end double")
    assert sorted((r["start"], r["end"], r["n"]) for r in intervals.coalesce_spans(df, ["k"], width).collect()) == want
    assert sorted((r["start"], r["end"]) for r in intervals.gaps(df, ["k"]).collect()) == [(a[1], b[0]) for a, b in zip(want, want[1:])]


def test_small_functions(spark):
    assert one(spark, geometry.slope_at(F.lit(10.0), [(90.0, 40.0)]))[0] == 40.0
    r = one(spark, *geometry.symmetric_eigenvalues(*[F.lit(x) for x in (2.0, 2.0, 2.0, 0.0, 0.0, 0.0)]))
    assert tuple(r) == pytest.approx((2.0, 2.0, 2.0))
    r = one(spark, *geometry.symmetric_eigenvalues(*[F.lit(x) for x in (2.0, 3.0, 4.0, 1.0, -1.0, 0.5)]))
    import numpy as np

    assert tuple(r) == pytest.approx(tuple(np.linalg.eigvalsh([[2, 1, -1], [1, 3, 0.5], [-1, 0.5, 4]])[::-1]))
    r = one(spark, text.repaired(F.unhex(F.lit("41FF42C3"))).alias("r"), text.repaired(F.encode(F.lit("a�b"), "UTF-8")).alias("s"))
    assert (r["r"]["text"], r["r"]["repairs"], r["s"]["text"], r["s"]["repairs"]) == ("A�B�", 2, "a�b", 0)
    assert (maths.series_count(0, 1, 0.25), maths.series_count(0, 1, 0), maths.fixed_point_digits(1e12)) == (5, None, 6)
    assert one(spark, maths.bearing(F.lit("sw")))[0] == 225.0
    assert one(spark, text.level_label(F.lit(-0.0), 1))[0] == "0.0"
    p = lambda x, y, z: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))
    assert one(spark, geometry.tetra_volume(p(1.0, 0.0, 0.0), p(0.0, 1.0, 0.0), p(0.0, 0.0, 1.0)))[0] == pytest.approx(1 / 6)
    assert [x is None for x in one(spark, values.inserted(F.array(F.lit(1), F.lit(2)), F.lit(9), F.lit(2)), values.moved(F.array(F.lit(1)), F.lit(0), F.lit(4)))] == [True, True]
    ordered = spark.createDataFrame([("a2",), ("a10",), ("A1",), ("a" + "9" * 24,), ("a1" + "0" * 24,)], "x string").orderBy(text.natural_key(F.col("x")))
    assert [r[0] for r in ordered.collect()] == ["A1", "a2", "a10", "a" + "9" * 24, "a1" + "0" * 24]


def test_kinds_turns_files_and_images(spark, tmp_path):
    assert [metrics.default_kind(n) for n in ("Density", "ore_tonnes", "au_ppm")] == ["volume", "sum", "weighted"]
    turn = lambda *x: one(spark, geometry.orient2d(*[F.lit(float(v)) for v in x]))[0]
    assert (turn(0, 0, 1, 0, 0, 1), turn(0, 0, 0, 1, 1, 0), turn(0, 0, 1, 1, 2, 2)) == (1.0, -1.0, 0.0)
    rows = [("a,b", 1), ('q"q', 2)]
    tables.write_delimited(spark.createDataFrame(rows, "x string, n int"), str(tmp_path / "out"), ";")
    back = spark.read.option("header", True).option("sep", ";").option("escape", '"').schema("x string, n int").csv(str(tmp_path / "out"))
    assert sorted(r["n"] for r in back.collect()) == [1, 2] and "a,b" in {r["x"] for r in back.collect()}
    head = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (640).to_bytes(4, "big") + (33).to_bytes(4, "big") + bytes(5)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(head)
    (tmp_path / "img" / "b.png").write_bytes(b"no image at all, but long enough for a head")
    assert [(r["width"], r["height"]) for r in files.read_rasters(spark, str(tmp_path / "img")).collect()] == [(640, 33)]


def test_second_fill_and_no_explosive(spark):
    holes = spark.createDataFrame([(1, 0.0, 10.0)], "hole long, top double, bottom double")
    schema = "seq long, product string, length double, kind string, density double"
    decks = spark.createDataFrame([(1, "stem", 2.0, "stemming", 0.0), (2, "anfo", None, "explosive", 0.8), (3, "more", None, "explosive", 0.8), (4, "toe", 1.0, "explosive", 1.2)], schema)
    got = [(r["seq"], r["from"], r["to"], r["primer"]) for r in blasting.lay_decks(holes, decks, 0.5).orderBy("seq").collect()]
    assert got == [(1, 0.0, 2.0, None), (2, 2.0, 9.0, 8.5), (3, 9.0, 9.0, None), (4, 9.0, 10.0, 9.5)]
    assert [r["problem"] for r in blasting.lay_decks(holes, decks.where("seq = 1")).collect()] == ["too short"]
    charged = blasting.charge_holes(holes, decks)
    assert charged.select(blasting.charge_mass(charged, F.lit(0.2))).first()[0] == pytest.approx((7 * 0.8 + 1.2) * math.pi * 0.01)


def test_depletion_and_its_faults(spark):
    work = spark.createDataFrame([(1, 0.0, 10.0, 50.0), (1, 5.0, 10.0, 20.0), (1, 30.0, 40.0, 30.0), (2, 0.0, 4.0, 10.0), (2, 3.0, 3.0, 0.0)], "block long, start double, end double, tonnes double")
    balances = spark.createDataFrame([(1, 100.0, 0.0), (2, 40.0, 30.0), (3, 0.0, 0.0)], "block long, started double, remaining double")
    asked = spark.createDataFrame([(1, t) for t in (-5.0, 5.0, 8.0, 20.0, 35.0, 99.0)] + [(2, 2.0), (2, 50.0), (3, 6.9), (3, 7.0), (9, 1.0)], "block long, time double")
    instant = spark.createDataFrame([(3, 7.0)], "block long, emptied double")
    got = {(r["block"], r["time"]): r["gone"] for r in depletion.fractions(asked, depletion.curves(work, balances), instant).collect()}
    assert got == pytest.approx({(1, -5.0): 0, (1, 5.0): 0.25, (1, 8.0): 0.52, (1, 20.0): 0.7, (1, 35.0): 0.85, (1, 99.0): 1, (2, 2.0): 0.125, (2, 50.0): 0.25, (3, 6.9): 0, (3, 7.0): 1, (9, 1.0): 0})
    for rows, text in (([(1, 0.0, 10.0, 99.0)], "gone 100"), ([(1, 2.0, 2.0, 100.0)], "invalid work"), ([(1, 0.0, 1.0, None)], "invalid work")):
        with pytest.raises(Exception, match=text):
            depletion.curves(spark.createDataFrame(rows, work.schema), balances.where("block = 1")).collect()


def test_holds(spark):
    names = ["prep", "drill", "charge"]
    rows = [("fired", 5.0, 0.0, None, [1.0, 2.0, 3.0], None), ("window", 99.0, 0.0, None, [1.0, 2.0, 3.0], None), ("never", None, None, "never", [None] * 3, None), ("above", None, 50.0, "a", [None] * 3, None), ("none", None, 0.0, None, [1.0, None, None], "drill"), ("busy", None, 0.0, None, [1.0, None, None], None), ("queue", None, 0.0, None, [1.0, 4.0, 77.0], None)]
    blasts = spark.createDataFrame(rows, "blast string, fired double, cleared double, above string, done array<double>, unworked string")
    work = spark.createDataFrame([("busy", "drill", 9.0, 11.0), ("queue", "charge", 0.0, 10.0), ("busy", "drill", 8.0, 12.0)], "blast string, activity string, start double, end double")
    got = {r["blast"]: r["hold"] for r in blasting.hold_at(blasts, work, names, 10.0).collect()}
    assert got == {"fired": "fired", "window": "awaiting window", "never": "never clears", "above": "above standing", "none": "no machine", "busy": "working drill", "queue": "queued charge"}


def test_patterns_turn_with_their_boundary(spark):
    ring = [(0.0, 0.0, 0.0), (21.0, 0.0, 0.0), (21.0, 9.0, 0.0), (10.0, 9.0, 0.0), (10.0, 17.0, 0.0), (0.0, 17.0, 0.0)]
    a = math.radians(30)
    turned = [(x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a), z) for x, y, z in ring]
    df = spark.createDataFrame([("a", ring), ("b", turned)], "boundary string, ring array<struct<x:double,y:double,z:double>>")
    flat = {(r["row"], r["column"]) for r in blasting.pattern_collars(df.where("boundary = 'a'"), 4.0, 5.0).collect()}
    assert flat == {(r["row"], r["column"]) for r in blasting.pattern_collars(df.where("boundary = 'b'"), 4.0, 5.0, 30.0).collect()}
    # the L: two rows of four below, and two of two above
    assert flat == {(j, i) for j in range(2) for i in range(4)} | {(j, i) for j in (2, 3) for i in range(2)}
    for most, text in ((3, "more than 3 holes"), (0, "scan")):
        with pytest.raises(Exception, match=text):
            blasting.pattern_collars(df, 4.0, 5.0, most=most).collect()
    upright = spark.createDataFrame([("u", [(0.0, 0.0, 0.0), (5.0, 0.0, 0.0), (5.0, 0.0, 5.0)])], df.schema)
    with pytest.raises(Exception, match="usable plane"):
        blasting.pattern_collars(upright, 4.0, 5.0).collect()


def test_pieces_of_a_trace(spark):
    trace = spark.createDataFrame([("h", 0.0, 0.0, 0.0, 0.0), ("h", 10.0, 0.0, 0.0, -10.0), ("h", 20.0, 10.0, 0.0, -10.0), ("g", 0.0, 1.0, 1.0, 1.0)], "k string, depth double, x double, y double, z double")
    spans = spark.createDataFrame([("h", 5.0, 15.0), ("h", -3.0, 2.0), ("h", 30.0, 40.0), ("g", 0.0, 9.0), ("x", 0.0, 1.0)], "k string, from double, to double")
    cuts = spark.createDataFrame([("h", 7.0), ("h", 7.0 + 1e-12), ("h", 99.0)], "k string, depth double")
    got = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in series.trace_pieces(spans, trace, cuts, "k").select("k", "from", "to", "x0", "z0", "x1", "z1").collect())
    assert got == [("h", 0.0, 2.0, 0.0, 0.0, 0.0, -2.0), ("h", 5.0, 7.0, 0.0, -5.0, 0.0, -7.0), ("h", 7.0, 10.0, 0.0, -7.0, 0.0, -10.0), ("h", 10.0, 15.0, 0.0, -10.0, 5.0, -10.0)]
