import struct
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strataframe.sources import files, tables


def put(path, text):
    path.write_text(text)
    return str(path)


def test_block_model_round_trip(spark, tmp_path):
    p = put(tmp_path / "m.csv", "X,Y,Z,dx,dy,dz,id,grade,rock\n10,20,30,2,4,6,1,0.5,ore\n12,20,30,2,4,6,2,,\n14,20,30,2,4,6,3,-99,waste\n")
    headers, kinds = tables.preview(spark, p)
    assert kinds[headers.index("rock")] == "category" and kinds[headers.index("grade")] == "numeric"
    m = tables.read_block_model(spark, p, ["rock"])
    got = sorted(tuple(r) for r in m.select("id", "xl", "xu", "zl", "grade", "rock").collect())
    assert got[0] == (1.0, 9.0, 11.0, 27.0, 0.5, "ore") and got[1][4:] == (None, None)
    tables.write_block_model(m, str(tmp_path / "out"), ["grade", "rock"])
    back = tables.read_block_model(spark, str(tmp_path / "out"), ["rock"])
    assert sorted((r["xl"], r["grade"]) for r in back.collect()) == [(9.0, 0.5), (11.0, None), (13.0, None)]


@pytest.mark.parametrize("row", ["bad,0,0,1,1,1,1", "0,0,0,0,1,1,1", "0,0,0,1,1,1,nan", ",0,0,1,1,1,1"])
def test_block_models_are_strict(spark, tmp_path, row):
    p = put(tmp_path / "m.csv", f"x,y,z,dx,dy,dz,g\n0,0,0,1,1,1,1\n{row}\n")
    with pytest.raises(Exception, match="finite|positive|blank"):
        tables.read_block_model(spark, p).collect()


def test_roles_and_duplicate_ids(spark, tmp_path):
    assert tables.block_roles(["X", "x", "Y", "Z", "au"]) == ["x", "value", "y", "z", "value"]
    assert tables.validate_roles(["x", "y", "z"], None) and not tables.validate_roles(["x", "y", "z"], (1, 1, 1))
    assert tables.unique_names(["a", "b", "a"]) == ["a", "b", "a (2)"]
    p = put(tmp_path / "m.csv", "x,y,z,id\n0,0,0,-0.0\n1,0,0,0\n")
    with pytest.raises(Exception, match="twice"):
        tables.read_block_model(spark, p, fixed=(1, 1, 1)).collect()


def test_drill_bundle_is_lenient(spark, tmp_path):
    c = put(tmp_path / "c.csv", "HoleID,Easting,Northing,RL\nA,0,0,100\nA,9,9,9\nB,10,0,100\n")
    s = put(tmp_path / "s.csv", "HoleID,Depth,Azimuth,Dip\nA,0,90,-90\nA,10,90,-90\nZ,0,0,-90\nB,0,0,0\nB,5,x,0\nB,8,0,0\n")
    i = put(tmp_path / "i.csv", "HoleID,From,To,Au,Rock\nA,0,5,1.5,ox\nA,5,9,,fr\nA,9,8,1,fr\nB,0,5,2,7\n")
    b = tables.read_drill_bundle(spark, c, s, i)
    assert b["collar"].count() == 2 and b["collar"].where("dhid = 'A'").first()["east"] == 0
    assert dict(b["interval"].dtypes)["Au"] == "double" and dict(b["interval"].dtypes)["Rock"] == "string"
    assert {(r[0], r[1]): r[2] for r in b["dropped"].collect()} == {("collar", "unreadable"): 0, ("survey", "unreadable"): 1, ("survey", "orphan"): 1, ("interval", "unreadable"): 1, ("interval", "orphan"): 0}
    trace = {(r["dhid"], r["depth"]): (round(r["x"], 6), round(r["y"], 6), round(r["z"], 6)) for r in tables.desurvey(b["collar"], b["survey"]).collect()}
    assert trace["A", 10.0] == (0, 0, 90) and trace["B", 8.0] == (10, 8, 100)
    with pytest.raises(ValueError, match="can't be read"):
        tables.read_drill_bundle(spark, put(tmp_path / "bad.csv", "dhid,east,north,rl\nA,q,0,0\nB,q,0,0\nC,0,0,0\n"), s, i)


def test_delays_are_all_or_nothing(spark):
    agents = spark.createDataFrame([("EX1", 1), ("EX2", 2)], "name string, agent int")
    lines = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "line int, value string")
    good = tables.read_delays(spark, lines("machine,start,end", "ex1,1.5,3", "", "EX2;day 1 06:00;day 2"), agents)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 1.5, 3.0), (2, 6.0, 24.0)]
    with pytest.raises(ValueError, match="line 1: unknown machine; line 3: ends before"):
        tables.read_delays(spark, lines("EX9,1,2", "EX1,1,2", "EX1,5,4"), agents)


def test_roles_of_drill_files():
    roles = tables.drill_roles("survey", ["Hole ID", "Depth", "MD", "Azi", "Incl.", "height"])
    assert roles == {"dhid": "Hole ID", "azimuth": "Azi", "inclination": "Incl.", "elevation": "height"}
    assert tables.drill_roles("interval", ["hole", "DepthFrom", "From", "depto", "au"]) == {"dhid": "hole", "from": "From", "to": "depto"}
    assert tables.named_headers("interval", ["hole", "DepthFrom", "From", "depto", "au"]) == {"hole", "DepthFrom", "From", "depto"}
    assert tables.block_roles(["xc", "x", "Y ", "Z", "block_id", "ID"]) == ["value", "x", "y", "z", "value", "id"]
    assert tables.guessed_kind(["hole", "MD", "GRDE"]) == "geophysics" and tables.guessed_kind(["hole", "depth", "au"]) is None


@pytest.mark.parametrize(("tilts", "dips"), [((-60, -90), (-60, -90)), ((60, 90), (-60, -90)), ((-60, 90), (60, -90))])
def test_inclinations_become_dips(spark, tmp_path, tilts, dips):
    c = put(tmp_path / "c.csv", "hole,x,y,z\nA,0,0,0\n")
    s = put(tmp_path / "s.csv", f"hole,depth,azimuth,inc,x,y,z\nA,0,10,{tilts[0]},,,\nA,5,400,{tilts[1]},,,\nA,9,10,120,1,2,3\nA,11,,,,,\n")
    i = put(tmp_path / "i.csv", "hole,from,to\nA,0,5\n")
    b = tables.read_drill_bundle(spark, c, s, i)
    assert [r["dip"] for r in b["survey"].orderBy("depth").collect()] == [*dips, None]
    assert tuple(b["angles"].first()) == (tilts == (-60, -90), 1, 1)
    assert {r["rows"] for r in b["dropped"].where("kind = 'survey' AND reason = 'unreadable'").collect()} == {1}


def test_the_first_collar_is_first_by_file(spark, tmp_path):
    (tmp_path / "c").mkdir()
    put(tmp_path / "c" / "a.csv", "hole,x,y,z\nA,1,0,0\n")
    put(tmp_path / "c" / "b.csv", "hole,x,y,z\n" + "".join(f"H{i},0,0,0\n" for i in range(500)) + "A,2,0,0\n")
    s = put(tmp_path / "s.csv", "hole,depth,azimuth,dip\nA,0,0,-90\n")
    i = put(tmp_path / "i.csv", "hole,from,to\nA,0,5\n")
    assert tables.read_drill_bundle(spark, str(tmp_path / "c"), s, i)["collar"].where("dhid = 'A'").first()["east"] == 1.0


def test_geophysics_is_read_by_hole(spark, tmp_path):
    p = put(tmp_path / "g.csv", "hole,depth,gamma\nA,1,5\nA,2,6\nB,1,7\nB,,9\n")
    spans = {r["dhid"]: (r["top"], r["bottom"], r["readings"]) for r in tables.index_geophysics(spark, p, str(tmp_path / "g"), "hole", "depth").collect()}
    assert spans == {"A": (1.0, 2.0, 2), "B": (1.0, 1.0, 1)}
    assert tables.read_hole(spark, str(tmp_path / "g"), "A").count() == 2


def test_point_clouds(spark, tmp_path):
    put(tmp_path / "a.xyz", "3\n# c\n1 2 3\n4,5,6,255,0,7\n")
    head = bytearray(227)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 2, 2
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<HI", head, 105, 26, 1)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100, 200, 300)
    rec = struct.pack("<3i", 150, 250, 350) + bytes([0, 0, 0, 2]) + bytes(4) + struct.pack("<3H", 256, 512, 65280)
    (tmp_path / "b.las").write_bytes(bytes(head) + rec)
    put(tmp_path / "c.pcd", "FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 2\nDATA ascii\n0 0 0\n1 1 1\n")
    got = {}
    for r in files.read_point_cloud(spark, str(tmp_path / "*.*")).collect():
        got.setdefault(r["path"][-5], []).append((r["x"], r["y"], r["z"], r["r"], r["cls"]))
    assert got["a"] == [(1, 2, 3, None, None), (4, 5, 6, 255, None)]
    assert got["b"] == [(101.5, 202.5, 303.5, 1, 2)] and len(got["c"]) == 2


def test_meshes_round_trip(spark, tmp_path):
    put(tmp_path / "q.obj", "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\n")
    put(tmp_path / "t.ply", "ply\nformat ascii 1.0\nelement vertex 3\nelement face 1\nend_header\n0 0 0\n1 0 0\n0 1 5\n3 0 1 2\n")
    put(tmp_path / "s.stl", "solid x\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid\n")
    faces = files.read_meshes(spark, str(tmp_path / "*.*"))
    assert faces.groupBy("path").count().count() == 3 and faces.count() == 4
    v, f = files.indexed(faces.where("path LIKE '%obj'"))
    assert v.count() == 4
    files.write_obj(v, f, str(tmp_path / "out.obj"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out.obj")).collect())
    assert len(files.parse_obj(text.encode())) == 2


def test_containers(spark, tmp_path):
    df = spark.range(3).withColumn("v", F.col("id") * 1.5)
    files.write_container({"a": df, "b": df.limit(1)}, str(tmp_path / "c"), {"name": "p"})
    index, arrays = files.read_container(spark, str(tmp_path / "c"))
    assert index["name"] == "p" and arrays["a"].count() == 3 and arrays["b"].columns == ["id", "v"]
    pq.write_table(pa.table({"x": [1, 2]}), tmp_path / "x.parquet")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "x.parquet", "x.parquet")
    assert files.read_zip_container(spark, str(tmp_path / "z.zip")).count() == 2


def test_mps():
    p = files.parse_mps("NAME T\nROWS\n N COST\n L LIM\nCOLUMNS\n X COST 1 LIM 2\nRHS\n R LIM 4\nBOUNDS\n UP B X 3\nENDATA\n")
    assert p["columns"]["X"] == {"COST": 1.0, "LIM": 2.0} and p["rhs"] == {"LIM": 4.0} and p["bounds"]["X"] == [("UP", 3.0)]


def test_ground_needs_three_points(spark):
    pts = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "point long, cls int")
    with pytest.raises(ValueError):
        files.ground_points(pts)
    assert np.isnan(files._blank(1)).all()
