"""Project containers: round trips of each element, types, uneven lengths, zips."""

import datetime
import gzip
import io
import json
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strataframe.sources import project as P


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("row").select(*columns).collect()]


def zipped(path, index, arrays, compression=zipfile.ZIP_STORED, **options):
    with zipfile.ZipFile(path, "w", compression) as z:
        z.writestr("index.json.gz", gzip.compress(json.dumps(index).encode()))
        for name, table in arrays.items():
            buffer = io.BytesIO()
            pq.write_table(table, buffer, **options)
            z.writestr(name, buffer.getvalue())


TYPES = {
    "flags": (pa.bool_(), [True, True, False, True]),
    "doubles": (pa.float64(), [0.0, 1.0, None, 4.0]),
    "floats": (pa.float32(), [0.5, None, 2.5]),
    "u32": (pa.uint32(), [0, 1, 4_294_967_295]),
    "u8": (pa.uint8(), [0, 255]),
    "i64": (pa.int64(), [-1_000_000_000_000, 1, None, 1_000_000_000_000]),
    "texts": (pa.string(), ["", None, "Ünï", "a" * 1000]),
    "days": (pa.date32(), [datetime.date(1970, 1, 1), None, datetime.date(2023, 9, 14)]),
    "times": (pa.timestamp("us", "UTC"), [datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC), datetime.datetime(2023, 9, 14, 12, 0, 0, 123456, tzinfo=datetime.UTC)]),
}


@pytest.mark.parametrize("compression", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_arrays_of_every_type_in_small_row_groups(spark, tmp_path, compression):
    zipped(tmp_path / "t.zip", {}, {f"{k}.parquet": pa.table({"v": pa.array(v, t)}) for k, (t, v) in TYPES.items()}, compression, row_group_size=3)
    for k, (_, want) in TYPES.items():
        df = P.read_arrays(spark, str(tmp_path / "t.zip"), [("", f"{k}.parquet")])
        got = [x if not isinstance(x, datetime.datetime) else x.astimezone(datetime.UTC) for (x,) in rows(df, "v")]
        assert got == want, k
        assert [r[0] for r in rows(df, "row")] == list(range(len(want)))
    assert P.read_arrays(spark, str(tmp_path / "t.zip"), [("", "doubles.parquet")]).rdd.getNumPartitions() == 2


def test_arrays_side_by_side_and_uneven_ones(spark, tmp_path):
    n = 200_000
    tables = {"a.parquet": pa.table({"x": np.arange(n), "y": np.arange(n) * 0.5}), "b.parquet": pa.table({"x": pa.array(np.arange(n) * 3, pa.uint32())})}
    zipped(tmp_path / "t.zip", {}, tables | {"short.parquet": pa.table({"x": [1, 2]})}, row_group_size=70_001)
    df = P.read_arrays(spark, str(tmp_path / "t.zip"), [("", "a.parquet"), ("b_", "b.parquet")])
    assert df.where("x = row AND y = row * 0.5 AND b_x = row * 3").count() == n == df.select("row").distinct().count()
    with pytest.raises(Exception, match="uneven lengths"):
        P.read_arrays(spark, str(tmp_path / "t.zip"), [("", "a.parquet"), ("s_", "short.parquet")]).count()
    with pytest.raises(Exception, match="missing"):
        P.read_arrays(spark, str(tmp_path / "t.zip"), [("", "none.parquet")]).count()


def test_points_and_lines_and_surfaces_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    pts = spark.range(1000).select(*[(F.col("id") * k + 500).cast("double").alias(c) for c, k in (("x", 1.0), ("y", 2.0), ("z", -1.0))], F.when(F.col("id") % 7 != 0, F.col("id") * 0.25).alias("grade"), F.concat(F.lit("h"), F.col("id")).alias("hole"), (F.col("id") % 2 == 0).alias("even")).repartitionByRange(4, "x").sortWithinPartitions("x")
    corners = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 5.0), (0.0, 1.0, 0.0)], "x double, y double, z double").coalesce(1)
    tri = spark.createDataFrame([(0, 1, 2, 7.0), (0, 2, 3, None)], "a long, b long, c long, slope double").coalesce(1)
    seg = spark.createDataFrame([(0, 1, "A"), (1, 3, "B")], "a long, b long, hole string").coalesce(1)
    elements = [P.write_points(pts, path, "pts", ["grade", "hole", "even"], origin=(500, 500, 500)), P.write_cornered(corners, tri, path, "top", ["slope"]), P.write_cornered(corners, seg, path, "traces", ["hole"])]
    index = {"name": "mine", "origin": [10, 0, 0], "elements": [elements[0], {"name": "group", "geometry": {"type": "Composite", "elements": elements[1:]}, "attributes": []}]}
    P.write_index(path, index)
    P.pack(spark, path, str(tmp_path / "p.zip"))
    for at in (path, str(tmp_path / "p.zip")):
        got = P.read_points(spark, at, "pts")
        want = [(r["x"] + 10, r["y"], r["z"], r["grade"], r["hole"], r["even"]) for r in pts.collect()]
        assert rows(got, "x", "y", "z", "grade", "hole", "even") == want
        assert rows(P.read_surface(spark, at, "top"), "ax", "bx", "cx", "cz", "slope") == [(10.0, 11.0, 11.0, 5.0, 7.0), (10.0, 11.0, 10.0, 0.0, None)]
        assert rows(P.read_lines(spark, at, "traces"), "ax", "by", "hole") == [(10.0, 0.0, "A"), (11.0, 1.0, "B")]


def test_block_models(spark, tmp_path):
    path = str(tmp_path / "b")
    orient = {"origin": [100, 200, 0], "u": [0, 1, 0], "v": [-1, 0, 0], "w": [0, 0, 1]}
    grid = {"type": "Regular", "size": [10, 20, 5], "count": [3, 2, 2]}
    whole = spark.range(12).select(F.col("id").cast("double").alias("grade")).coalesce(1)
    sub = [(i, 1, 0, 0.0, 0.0, 0.0, 0.5, 1.0, 1.0, f"r{i}") for i in range(3)] + [(0, 0, 1, 0.25, 0.5, 0.0, 1.0, 1.0, 0.5, "last")]
    free = spark.createDataFrame(sub, ", ".join(f"{c} {'long' if c.startswith('parent') else 'double'}" for c in P.SUBBLOCK) + ", rock string").coalesce(1)
    octree = spark.createDataFrame([(2, 1, 1, 0, 2, 0, 4, 4, 1, 1.5)], ", ".join(f"{c} long" for c in P.SUBBLOCK) + ", t double").coalesce(1)
    elements = [P.write_blocks(whole, path, "regular", orient, grid, ["grade"]), P.write_blocks(free, path, "free", orient, grid, ["rock"]), P.write_blocks(octree, path, "octree", orient, grid, ["t"], steps=(4, 4, 2))]
    P.write_index(path, {"name": "m", "elements": elements})
    regular = rows(P.read_blocks(spark, path, "regular"), "i", "j", "k", "x0", "y1", "z1", "x", "y", "z", "grade")
    assert regular[4] == (1, 1, 0, 10.0, 40.0, 5.0, 100.0 - 30, 200.0 + 15, 2.5, 4.0) and len(regular) == 12
    got = rows(P.read_blocks(spark, path, "free"), "x0", "x1", "y0", "y1", "z0", "z1", "rock")
    assert got[1] == (10.0, 15.0, 20.0, 40.0, 0.0, 5.0, "r1") and got[3] == (2.5, 10.0, 10.0, 20.0, 5.0, 7.5, "last")
    assert rows(P.read_blocks(spark, path, "octree"), "x0", "x1", "y0", "y1", "z0", "z1", "t") == [(20.0, 30.0, 30.0, 40.0, 5.0, 7.5, 1.5)]


def test_categories_tensors_and_grid_surfaces(spark, tmp_path):
    array = lambda name, n: {"filename": name, "item_count": n}
    at = {"name": "rock", "location": "Primitives", "data": {"type": "Category", "values": array("code.parquet", 4), "names": array("names.parquet", 2)}}
    blocks = {"name": "tensor", "geometry": {"type": "BlockModel", "orient": {"origin": [0, 0, 0]}, "grid": {"type": "Tensor", "u": array("u.parquet", 2), "v": array("v.parquet", 1), "w": array("w.parquet", 2)}}, "attributes": [at]}
    surface = {"name": "topo", "geometry": {"type": "GridSurface", "orient": {"origin": [5, 0, 1]}, "grid": {"type": "Regular", "size": [2, 3], "count": [1, 1]}, "heights": array("h.parquet", 4)}, "attributes": []}
    scalar = lambda *x: pa.table({"scalar": pa.array(x, pa.float32())})
    arrays = {"code.parquet": pa.table({"index": pa.array([0, 1, None, 7], pa.uint32())}), "names.parquet": pa.table({"name": ["ore", "waste"]}), "u.parquet": scalar(1, 4), "v.parquet": scalar(2), "w.parquet": scalar(3, 5), "h.parquet": scalar(0, 1, 2, 3)}
    index = {"name": "x", "elements": [blocks, surface]}
    zipped(tmp_path / "c.zip", index, arrays)
    assert P.problems(P.Container(str(tmp_path / "c.zip")), index) == []
    assert rows(P.read_blocks(spark, str(tmp_path / "c.zip"), "tensor"), "x0", "x1", "z0", "z1", "rock") == [(0, 1, 0, 3, "ore"), (1, 5, 0, 3, "waste"), (0, 1, 3, 8, None), (1, 5, 3, 8, None)]
    assert rows(P.read_grid_surface(spark, str(tmp_path / "c.zip"), "topo"), "x", "y", "z") == [(5, 0, 1), (7, 0, 2), (5, 3, 3), (7, 3, 4)]


def test_groups_that_may_be_null(spark, tmp_path):
    colour = pa.struct([pa.field(c, pa.uint8(), False) for c in "rgba"])
    vector = pa.struct([pa.field(c, pa.float32(), False) for c in "xyz"])
    tables = {"v.parquet": pa.table({c: pa.array([0.0, 1.0, 2.0]) for c in "xyz"}), "c.parquet": pa.table({"color": pa.array([{"r": 255, "g": 0, "b": 1, "a": 9}, None, {"r": 1, "g": 2, "b": 3, "a": 4}], colour)}), "d.parquet": pa.table({"vector": pa.array([None, {"x": 1, "y": 2, "z": 0.5}, None], vector)})}
    array = lambda name: {"filename": name, "item_count": 3}
    at = [{"name": n, "location": "Vertices", "data": {"type": k, "values": array(f)}} for n, k, f in (("paint", "Color", "c.parquet"), ("way", "Vector", "d.parquet"))]
    index = {"elements": [{"name": "p", "geometry": {"type": "PointSet", "vertices": array("v.parquet")}, "attributes": at}]}
    zipped(tmp_path / "g.zip", index, tables)
    got = rows(P.read_points(spark, str(tmp_path / "g.zip"), "p"), "x", "paint", "way")
    assert [(x, c and tuple(c), w and tuple(w)) for x, c, w in got] == [(0.0, (255, 0, 1, 9), None), (1.0, None, (1.0, 2.0, 0.5)), (2.0, (1, 2, 3, 4), None)]


def test_what_is_refused(spark, tmp_path):
    path = str(tmp_path / "r")
    pts = spark.createDataFrame([(1.0, 2.0, None, 3.0)], "x double, y double, z double, v double")
    with pytest.raises(Exception, match="z has a null"):
        P.write_points(pts, path, "bad")
    good = P.write_points(pts.fillna(0.0), path, "good", ["v"])
    P.write_arrays(spark.range(3).select(F.col("id").cast("double").alias("v")), path, {"long.parquet": {"v": "number"}})
    longer = dict(good["attributes"][0], name="w", data={"type": "Number", "values": {"filename": "long.parquet", "item_count": 3}})
    nowhere = dict(good["attributes"][0], name="q", location="Subblocks")
    gone = dict(good["attributes"][0], name="g", data={"type": "Number", "values": {"filename": "gone.parquet", "item_count": 1}})
    with pytest.raises(ValueError) as e:
        P.write_index(path, {"elements": [good | {"attributes": [*good["attributes"], longer, nowhere, gone]}, good]})
    for text in ("w has 3 values for 1 Vertices", "q lies at Subblocks", "gone.parquet is missing", "good is there twice"):
        assert text in str(e.value)
    with pytest.raises(ValueError, match="no index"):
        P.Container(path).index()
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        z.writestr("index.json", b" " * (P.INDEX_BYTES + 1))
    with pytest.raises(ValueError, match="larger"):
        P.Container(str(tmp_path / "big.zip")).index()
