"""Point clouds, meshes, containers and programs, read as binary files by the executors."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "path string, point long, x double, y double, z double, r int, g int, b int, cls int"
FACES = "path string, face long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _blank(n: int) -> np.ndarray:
    return np.full((n, 4), np.nan)


def parse_xyz(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and colour and class (NaN: none). Comments and a lone count line are skipped; a bad row is an error."""
    xyz, more = [], []
    for line in raw.decode("utf-8-sig").splitlines():
        cells = line.replace(",", " ").replace(";", " ").split()
        if not cells or cells[0][0] in "#/" or (len(cells) == 1 and not xyz):
            continue
        v = [float(c) for c in cells]
        if len(v) < 3:
            raise ValueError(f"not a point: {line}")
        xyz.append(v[:3])
        rgb = v[-3:] if len(v) >= 6 and all(c == int(c) and 0 <= c <= 255 for c in v[-3:]) else [np.nan] * 3
        more.append([*rgb, np.nan])
    return np.array(xyz).reshape(-1, 3), np.array(more).reshape(-1, 4)


def parse_las(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """LAS 1.x: scaled positions, class, and colour where the record format has it."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, kind, size, count = struct.unpack_from("<I", raw, 96)[0], raw[104] & 63, *struct.unpack_from("<HI", raw, 105)
    if raw[104] & 128:
        raise ValueError("compressed records aren't supported")
    if raw[25] >= 4:
        count = struct.unpack_from("<Q", raw, 247)[0]
    scale, offset = np.frombuffer(raw, "<f8", 3, 131), np.frombuffer(raw, "<f8", 3, 155)
    rec = np.frombuffer(raw, np.uint8, count * size, start).reshape(count, size)
    xyz = np.ascontiguousarray(rec[:, :12]).view("<i4") * scale + offset
    more = _blank(count)
    more[:, 3] = rec[:, 16] if kind >= 6 else rec[:, 15] & 31
    at = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}.get(kind)
    if at is not None:
        more[:, :3] = np.ascontiguousarray(rec[:, at : at + 6]).view("<u2") >> 8
    return xyz, more


def parse_pcd(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """PCD, ascii or binary."""
    head, kind, at = {}, "", 0
    while kind == "":
        end = raw.index(b"\n", at)
        key, _, rest = raw[at:end].decode().strip().partition(" ")
        head[key] = rest.split()
        at = end + 1
        kind = rest if key == "DATA" else ""
    names, n = head["FIELDS"], int(head["POINTS"][0])
    if kind == "ascii":
        rows = np.array([line.split() for line in raw[at:].decode().split("\n") if line.strip()][:n], float)
        cols = {c: rows[:, i] for i, c in enumerate(names)}
    elif kind == "binary":
        types = [(c, f"<{ {'F': 'f', 'U': 'u', 'I': 'i'}[t] }{s}") for c, t, s in zip(names, head["TYPE"], head["SIZE"], strict=True)]
        rec = np.frombuffer(raw, np.dtype(types), n, at)
        cols = {c: rec[c].astype(float) for c in names}
    else:
        raise ValueError(f"PCD data {kind} isn't supported")
    return np.stack([cols[c] for c in "xyz"], 1), _blank(n)


PARSERS: dict[str, Callable] = {"xyz": parse_xyz, "txt": parse_xyz, "las": parse_las, "pcd": parse_pcd}


def read_point_cloud(spark: SparkSession, path: str) -> DataFrame:
    """All points of the files at path, by extension; files are read in parallel, points given out in batches."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                xyz, more = PARSERS[name.rsplit(".", 1)[-1].lower()](content)
                for i in range(0, len(xyz), 100_000):
                    part, m = xyz[i : i + 100_000], pd.DataFrame(more[i : i + 100_000], columns=["r", "g", "b", "cls"]).astype("Int32")
                    out = pd.DataFrame({"path": name, "point": np.arange(i, i + len(part)), "x": part[:, 0], "y": part[:, 1], "z": part[:, 2]})
                    yield pd.concat([out, m], axis=1)

    return _binary(spark, path).mapInPandas(run, POINTS)


def ground_points(points: DataFrame) -> DataFrame:
    """Class 2; fewer than three are an error."""
    ground = points.where("cls = 2")
    if ground.limit(3).count() < 3:
        raise ValueError("fewer than three ground points")
    return ground


def parse_obj(raw: bytes) -> np.ndarray:
    v, faces = [], []
    for line in raw.decode().splitlines():
        c = line.split()
        if c[:1] == ["v"]:
            v.append([float(x) for x in c[1:4]])
        elif c[:1] == ["f"]:
            k = [int(x.split("/")[0]) for x in c[1:]]
            k = [i - 1 if i > 0 else len(v) + i for i in k]
            faces += [[v[k[0]], v[k[i]], v[k[i + 1]]] for i in range(1, len(k) - 1)]
    return np.array(faces, float).reshape(-1, 9)


def parse_stl(raw: bytes) -> np.ndarray:
    if raw[:5] == b"solid" and b"facet" in raw[:1000]:
        return np.array([line.split()[1:4] for line in raw.decode().splitlines() if line.split()[:1] == ["vertex"]], float).reshape(-1, 9)
    n = struct.unpack_from("<I", raw, 80)[0]
    rec = np.frombuffer(raw, np.uint8, n * 50, 84).reshape(n, 50)
    return np.ascontiguousarray(rec[:, 12:48]).view("<f4").astype(float)


def parse_ply(raw: bytes) -> np.ndarray:
    head, _, body = raw.partition(b"end_header\n")
    lines = head.decode().splitlines()
    if not any("ascii" in x for x in lines):
        raise ValueError("only ascii PLY is supported")
    n = {x.split()[1]: int(x.split()[2]) for x in lines if x.startswith("element")}
    rows = [x.split() for x in body.decode().splitlines()]
    v = np.array([r[:3] for r in rows[: n["vertex"]]], float)
    faces = []
    for r in rows[n["vertex"] : n["vertex"] + n.get("face", 0)]:
        k = [int(x) for x in r[1 : 1 + int(r[0])]]
        faces += [np.concatenate([v[k[0]], v[k[i]], v[k[i + 1]]]) for i in range(1, len(k) - 1)]
    return np.array(faces).reshape(-1, 9)


MESHES = {"obj": parse_obj, "stl": parse_stl, "ply": parse_ply}


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """One row a triangle, with its corners."""

    def run(batches):
        import pandas as pd

        names = [f"{a}{i}" for i in range(3) for a in "xyz"]
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                t = MESHES[name.rsplit(".", 1)[-1].lower()](content)
                out = pd.DataFrame(t, columns=names)
                out.insert(0, "face", np.arange(len(t)))
                out.insert(0, "path", name)
                yield out

    return _binary(spark, path).mapInPandas(run, FACES)


def indexed(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces): equal corners are one vertex, numbered by content."""
    from pyspark.sql.window import Window

    corners = faces.select("face", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.col(f"z{i}").alias("z")) for i in range(3)])).alias("c")).select("face", "c.*")
    v = corners.select("x", "y", "z").distinct().withColumn("vertex", F.row_number().over(Window.orderBy("x", "y", "z")) - 1)
    f = corners.join(v, ["x", "y", "z"]).groupBy("face").agg(*[F.max(F.when(F.col("i") == i, F.col("vertex"))).alias(n) for i, n in enumerate("abc")])
    return v, f


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One Wavefront text: vertices in order, then faces."""
    v = vertices.select(F.lit(0).alias("k"), F.col("vertex").cast("long").alias("n"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    f = faces.select(F.lit(1).alias("k"), F.col("face").cast("long").alias("n"), F.concat_ws(" ", F.lit("f"), F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("value"))
    v.unionByName(f).repartitionByRange(1, "k", "n").sortWithinPartitions("k", "n").select("value").write.mode("overwrite").text(path)


def write_container(tables: dict[str, DataFrame], folder: str, index: dict) -> None:
    """A catalogue folder: one Parquet table an array, and a JSON index."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(index | {"arrays": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/index.json")


def read_container(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    index = json.loads(spark.read.text(f"{folder}/index.json").first()[0])
    return index, {name: spark.read.parquet(f"{folder}/{name}") for name in index["arrays"]}


def read_zip_container(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """(path, array, row, values as JSON) of zips of Parquet arrays; members over `most` bytes are an error."""

    def run(batches):
        import pandas as pd
        import pyarrow.parquet as pq

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.filename.endswith(".parquet"):
                            continue
                        if m.file_size > most:
                            raise ValueError(f"{m.filename} is too large")
                        table = pq.read_table(io.BytesIO(z.read(m)))
                        rows = [json.dumps(r) for r in table.to_pylist()]
                        yield pd.DataFrame({"path": name, "array": m.filename.removesuffix(".parquet"), "row": np.arange(len(rows)), "value": rows})

    return _binary(spark, path).mapInPandas(run, "path string, array string, row long, value string")


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height) of PNG images."""
    head = F.col("content")
    size = lambda at: F.conv(F.hex(F.substring(head, at, 4)), 16, 10).cast("long")
    return _binary(spark, path).where(F.hex(F.substring(head, 2, 3)) == "504E47").select("path", size(17).alias("width"), size(21).alias("height"))


def parse_mps(text: str) -> dict:
    """Rows, objective, coefficients, right sides and bounds of a free-form MPS program."""
    out = {"name": "", "rows": {}, "columns": {}, "rhs": {}, "bounds": {}}
    section = ""
    for line in text.splitlines():
        if not line.strip() or line.startswith("*"):
            continue
        c = line.split()
        if not line[0].isspace():
            section = c[0]
            out["name"] = c[1] if section == "NAME" and len(c) > 1 else out["name"]
        elif section == "ROWS":
            out["rows"][c[1]] = c[0]
        elif section in ("COLUMNS", "RHS"):
            for row, v in zip(c[1::2], c[2::2], strict=True):
                if section == "COLUMNS":
                    out["columns"].setdefault(c[0], {})[row] = float(v)
                else:
                    out["rhs"][row] = float(v)
        elif section == "BOUNDS":
            out["bounds"].setdefault(c[2], []).append((c[0], float(c[3]) if len(c) > 3 else None))
    return out
