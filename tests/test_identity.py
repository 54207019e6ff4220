"""References to ground that was cut anew, heirs of blocks, and byte runs."""

import random

import pytest
from pyspark.sql import functions as F

from strataframe.operators import identity
from strataframe.sources import runs

GROUND = "block long, solid int, source string, base double, top double, outline array<struct<x:double,y:double>>, footprint string, area double, volume double"
REF = "ref string, solid int, source string, base double, top double, x double, y double, footprint string, area double, volume double"


def box(x, y, w=10.0, h=10.0):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_every_status(spark):
    ground = spark.createDataFrame([
        (1, 1, "a", 0.0, 5.0, box(0.0, 0.0), "f1", 100.0, 500.0),
        (2, 1, "a", 0.0, 5.0, box(10.0, 0.0), "f2", 100.0, None),
        (3, 1, "a", 5.0, 12.0, box(0.0, 0.0), "f3", 100.0, 700.0),
        (4, 1, "a", 0.0, 5.0, box(30.0, 0.0), "f4", 100.0, 500.0),
        (5, 1, "a", 0.0, 5.0, box(32.0, 2.0), "f5", 100.0, 500.0),
        (6, 2, "z", 0.0, 5.0, box(0.0, 0.0), "f6", 100.0, 500.0),
    ], GROUND)
    ref = lambda name, solid=1, source="a", base=0.0, top=5.0, x=5.0, y=5.0, foot="f1", area=100.0, volume=500.0: (name, solid, source, base, top, x, y, foot, area, volume)
    refs = spark.createDataFrame([
        ref("good"), ref("close", base=1e-7, volume=500.0004), ref("open", x=15.0, foot="f2", volume=None), ref("solid", solid=9), ref("source", solid=2), ref("flitch", base=1.0),
        ref("top", base=5.0, top=10.0), ref("gone", x=500.0), ref("two", x=35.0), ref("foot", foot="other"), ref("vol", volume=501.0), ref("closed", x=15.0, foot="f2"), ref("bad", x=float("nan")), ref("flat", area=0.0),
    ], REF)
    got = {r["ref"]: tuple(r)[1:] for r in identity.resolve(refs, ground, 7.0).collect()}
    assert got == {
        "good": ("resolved", 1, None, None), "close": ("resolved", 1, None, None), "open": ("resolved", 2, None, None), "solid": ("solid missing", None, None, None),
        "source": ("source changed", None, None, None), "flitch": ("flitch missing", None, None, None), "top": ("flitch top changed", None, 10.0, 12.0), "gone": ("ground missing", None, None, None),
        "two": ("ground ambiguous", None, None, 2.0), "foot": ("ground changed", None, 100.0, 100.0), "vol": ("volume changed", None, 501.0, 500.0), "closed": ("volume changed", None, 500.0, None),
        "bad": ("malformed", None, None, None), "flat": ("malformed", None, None, None),
    }
    after = identity.successors(spark.createDataFrame([ref("s", base=2.0, top=8.0)], REF), ground, 3.0)
    assert [tuple(r) for r in after.orderBy("place").collect()] == [("s", 1, 3), ("s", 2, 1)]


def test_heirs_take_most_of_a_block(spark):
    rng = random.Random(6)
    rand = lambda n: [(i, rng.randrange(2), *[c for k in range(3) for c in (lambda a: (a, a + rng.randrange(1, 9)))(float(rng.randrange(30 if k < 2 else 6)))]) for i in range(n)]
    old, new = rand(60), rand(50) + [(900, 0, 5.0, 5.0, 0.0, 1.0, 0.0, 1.0)]
    schema = "block long, solid int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"
    want = {}
    for b in new:
        size = (b[3] - b[2]) * (b[5] - b[4]) * (b[7] - b[6])
        best = None
        for a in old:
            v = 1.0
            for k in (2, 4, 6):
                v *= max(0.0, min(a[k + 1], b[k + 1]) - max(a[k], b[k]))
            if a[1] == b[1] and v > 0 and size and (best is None or (-v, a[0]) < best[:2]):
                best = (-v, a[0], v / size)
        if best:
            want[b[0]] = best[1:]
    for size in (2.5, 40.0):
        got = identity.heirs(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), size)
        assert {r["block"]: (r["old"], pytest.approx(r["share"])) for r in got.collect()} == want and len(want) > 20


def test_a_key_s_bytes_alone_are_read(spark, tmp_path):
    rng = random.Random(1)
    rows, where = [], {}
    for hole in ("A", "B", "C", "A"):
        for i in range({"A": 40, "B": 3, "C": 25}[hole]):
            cells = (hole, f"{i * 0.5}", str(rng.randrange(100)) if hole != "B" else "", "n/a")
            rows.append(cells)
            where.setdefault(hole, []).append(cells)
    text = ["hole,depth,gamma,note"] + [",".join(r) for r in rows]
    text[10:10] = ["", "A,x,1,2", "broken line", ",5,5,5"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text("\n".join(text))
    (tmp_path / "f" / "b.csv").write_text("hole,depth,gamma,note\r\nD,1,2,3\r\nD,2,3,\r\n")
    path = str(tmp_path / "f")
    for split in (17, 100, 1 << 20):
        index = runs.index_runs(spark, path, "hole", "depth", split)
        got = sorted((r["key"], r["readings"], r["top"], r["bottom"], tuple(r["curves"])) for r in index.collect())
        assert got == [("A", 40, 0.0, 19.5, ("gamma", "note")), ("A", 40, 0.0, 19.5, ("gamma", "note")), ("B", 3, 0.0, 1.0, ("note",)), ("C", 25, 0.0, 12.0, ("gamma", "note")), ("D", 2, 1.0, 2.0, ("gamma", "note"))], split
        c = runs.read_key(index, path, ["C"], "hole", "depth", ["gamma"])
        assert [(r["depth"], r["value"]) for r in c.orderBy("depth").collect()] == [(float(x[1]), float(x[2])) for x in where["C"]]
        size = sum(len(",".join(x)) + 1 for x in where["C"])
        assert {r["read"] for r in c.collect()} == {size} and size < 0.4 * (tmp_path / "f" / "a.csv").stat().st_size
        assert runs.read_key(index, path, ["A"], "hole", "depth", ["gamma", "note"]).where(F.col("curve") == "gamma").count() == 80
    with pytest.raises(Exception, match="has no hole"):
        (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
        runs.index_runs(spark, str(tmp_path / "bad.csv"), "hole", "depth").count()
