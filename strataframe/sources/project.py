"""Project containers: a JSON index of elements over Parquet arrays, as a Spark data source with readers and writers of each element.

A container is a folder of arrays (each a folder of part files and a manifest that orders them) or a zip file of
arrays, stored or deflated. Both have an index: index.json, or index.json.gz. `arrays` of one element are read
side by side, so columns meet by their place in the arrays and no join is needed.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "project_arrays"
#: Rows of a batch; an index of more bytes is an error, as it is read whole.
BATCH, INDEX_BYTES = 65_536, 1 << 20
#: Column names of the arrays, by what they hold.
VERTEX, SEGMENT, TRIANGLE = ("x", "y", "z"), ("a", "b"), ("a", "b", "c")
SUBBLOCK = ("parent_u", "parent_v", "parent_w", "corner_min_u", "corner_min_v", "corner_min_w", "corner_max_u", "corner_max_v", "corner_max_w")
#: The kind of an attribute, the key of its array in the index, and its column.
ATTRIBUTES = {"Number": ("values", "number"), "Text": ("values", "text"), "Category": ("values", "index"), "Boolean": ("values", "bool"), "Vector": ("values", "vector"), "Color": ("values", "color")}


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


class Container:
    """Members of a container at a path that any machine can open."""

    def __init__(self, path: str):
        self.fs, self.path = _filesystem(path)
        self.zip = None
        if self.fs.get_file_info(self.path).is_file:
            self.zip = zipfile.ZipFile(self.fs.open_input_file(self.path))

    def open(self, name: str):
        return self.zip.open(name) if self.zip else self.fs.open_input_file(posixpath.join(self.path, name))

    def has(self, name: str) -> bool:
        return name in self.zip.namelist() if self.zip else self.fs.get_file_info(posixpath.join(self.path, name)).is_file

    def read(self, name: str, most: int = INDEX_BYTES) -> bytes:
        with self.open(name) as f:
            data = gzip.GzipFile(fileobj=f).read(most + 1) if name.endswith(".gz") else f.read(most + 1)
        if len(data) > most:
            raise ValueError(f"{name} is larger than {most} bytes")
        return data

    def index(self) -> dict:
        for name in ("index.json", "index.json.gz"):
            if self.has(name):
                return json.loads(self.read(name))
        raise ValueError(f"{self.path} has no index")

    def parts(self, array: str) -> list[tuple[str, int]]:
        """The files of an array in order, and their rows."""
        manifest = f"{array}/manifest.json"
        if self.has(manifest):
            return [(f"{array}/{p['file']}", p["rows"]) for p in json.loads(self.read(manifest, 1 << 28))["parts"]]
        if not self.has(array):
            raise ValueError(f"array {array} is missing")
        return [(array, self.parquet(array).metadata.num_rows)]

    def parquet(self, name: str):
        import pyarrow.parquet as pq

        return pq.ParquetFile(self.open(name))

    def groups(self, array: str) -> list[tuple[str, int, int, int]]:
        """(file, row group, first row in the array, rows), in order."""
        out, at = [], 0
        for name, _ in self.parts(array):
            meta = self.parquet(name).metadata
            for g in range(meta.num_row_groups):
                out.append((name, g, at, meta.row_group(g).num_rows))
                at += out[-1][3]
        return out

    def rows(self, array: str, first: int, count: int) -> Iterator:
        """Batches of an array's rows first..first + count; only the files and row groups that hold some of them are opened."""
        at = 0
        for name, n in self.parts(array):
            if at < first + count and first < at + n:
                file, inside = self.parquet(name), at
                for g in range(file.metadata.num_row_groups):
                    m = file.metadata.row_group(g).num_rows
                    if inside < first + count and first < inside + m:
                        here = inside
                        for b in file.iter_batches(batch_size=BATCH, row_groups=[g]):
                            lo, hi = max(first, here), min(first + count, here + b.num_rows)
                            if lo < hi:
                                yield b.slice(lo - here, hi - lo)
                            here += b.num_rows
                    inside += m
            at += n


def _spark_type(t):
    """Unsigned and small floating columns in the Spark type that holds them."""
    import pyarrow as pa

    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}
    if pa.types.is_timestamp(t):
        return pa.timestamp("us", "UTC")
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _spark_type(f.type), f.nullable) for f in t])
    return wider.get(t, t)


def _chunked(batches: Iterator, sizes: Iterator[int]) -> Iterator:
    """The rows of batches dealt anew into tables of the given sizes."""
    import pyarrow as pa

    held, have = [], 0
    for want in sizes:
        while have < want:
            b = next(batches)
            held.append(b)
            have += b.num_rows
        table = pa.Table.from_batches(held)
        yield table.slice(0, want)
        held, have = table.slice(want).to_batches(), have - want


@dataclass
class Rows(InputPartition):
    first: int
    count: int


class ArraysReader(DataSourceReader):
    def __init__(self, path: str, arrays: list[tuple[str, str]], schema):
        self.path, self.arrays, self.fields = path, arrays, [f.name for f in schema]

    def partitions(self) -> list[InputPartition]:
        """One partition a row group of the first array; arrays of other lengths are an error."""
        c = Container(self.path)
        counts = {array: sum(g[3] for g in c.groups(array)) for _, array in self.arrays}
        if len(set(counts.values())) > 1:
            raise ValueError(f"uneven lengths of arrays: {counts}")
        return [Rows(at, n) for _, _, at, n in c.groups(self.arrays[0][1])] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = Container(self.path)
        wanted = [(prefix, array) for prefix, array in self.arrays]
        sizes = [min(BATCH, partition.count - i) for i in range(0, partition.count, BATCH)]
        streams = [_chunked(c.rows(array, partition.first, partition.count), iter(sizes)) for _, array in wanted]
        at = partition.first
        for n in sizes:
            columns = {"row": pa.array(np.arange(at, at + n))}
            for (prefix, _), s in zip(wanted, streams, strict=True):
                t = next(s)
                columns |= {prefix + name: t.column(name).combine_chunks().cast(_spark_type(t.schema.field(name).type)) for name in t.column_names}
            yield pa.RecordBatch.from_pydict({k: columns[k] for k in self.fields})
            at += n


class ArraysWriter(DataSourceArrowWriter):
    """Writes a frame's columns to several arrays in one pass: a part file an array and task, ordered by the manifest."""

    def __init__(self, path: str, members: dict[str, dict[str, str]], required: list[str], overwrite: bool):
        self.path, self.members, self.required, self.overwrite = path, members, required, overwrite

    def write(self, iterator) -> WriterCommitMessage:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        fs, base = _filesystem(self.path)
        part, rows, writers = TaskContext.get().partitionId(), 0, {}
        name = f"part-{part:06d}-{uuid.uuid4().hex}.parquet"
        try:
            for b in iterator:
                for c in self.required:
                    if b.column(b.schema.get_field_index(c)).null_count:
                        raise ValueError(f"{c} has a null")
                for array, columns in self.members.items():
                    picked = [b.column(b.schema.get_field_index(c)) for c in columns]
                    fields = [pa.field(to, x.type, nullable=c not in self.required) for (c, to), x in zip(columns.items(), picked, strict=True)]
                    out = pa.RecordBatch.from_arrays(picked, schema=pa.schema(fields))
                    if array not in writers:
                        fs.create_dir(f"{base}/{array}", recursive=True)
                        writers[array] = pq.ParquetWriter(fs.open_output_stream(f"{base}/{array}/{name}"), out.schema, compression="zstd")
                    writers[array].write_batch(out)
                rows += b.num_rows
        finally:
            for w in writers.values():
                w.close()
        return _Part(part, name, rows if writers else 0)

    def commit(self, messages) -> None:
        fs, base = _filesystem(self.path)
        parts = [{"file": m.file, "rows": m.rows} for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.part)]
        for array in self.members:
            fs.create_dir(f"{base}/{array}", recursive=True)
            with fs.open_output_stream(f"{base}/{array}/manifest.json") as f:
                f.write(json.dumps({"parts": parts}).encode())

    def abort(self, messages) -> None:
        fs, base = _filesystem(self.path)
        for m in messages:
            for array in self.members:
                at = f"{base}/{array}/{m.file}" if m is not None else ""
                if at and fs.get_file_info(at).is_file:
                    fs.delete_file(at)


@dataclass
class _Part(WriterCommitMessage):
    part: int
    file: str
    rows: int


class ProjectArrays(DataSource):
    """options: path; arrays (JSON list of [prefix, array]) to read; members (JSON of array to columns) and required to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _arrays(self) -> list[tuple[str, str]]:
        return [tuple(x) for x in json.loads(self.options["arrays"])]

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        c, fields = Container(self.options["path"]), [pa.field("row", pa.int64())]
        for prefix, array in self._arrays():
            parts = c.parts(array)
            for f in c.parquet(parts[0][0]).schema_arrow if parts else []:
                fields.append(pa.field(prefix + f.name, _spark_type(f.type), f.nullable))
        return from_arrow_schema(pa.schema(fields))

    def reader(self, schema) -> DataSourceReader:
        return ArraysReader(self.options["path"], self._arrays(), schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArraysWriter(self.options["path"], json.loads(self.options["members"]), json.loads(self.options.get("required", "[]")), overwrite)


def read_arrays(spark: SparkSession, path: str, arrays: Sequence[tuple[str, str]]) -> DataFrame:
    """row and the columns of arrays [(prefix, array)] side by side; a partition a row group of the first."""
    spark.dataSource.register(ProjectArrays)
    return spark.read.format(FORMAT).option("path", path).option("arrays", json.dumps(list(arrays))).load()


def write_arrays(df: DataFrame, path: str, members: dict[str, dict[str, str]], required: Sequence[str] = ()) -> None:
    """Write columns of df to arrays {array: {column: name}} in one pass, in the order of df's rows; a null in `required` is an error."""
    df.sparkSession.dataSource.register(ProjectArrays)
    names = list(dict.fromkeys(c for m in members.values() for c in m))
    df.select(*names).write.format(FORMAT).option("path", path).option("members", json.dumps(members)).option("required", json.dumps(list(required))).mode("append").save()


def write_index(path: str, project: dict) -> None:
    """Check the index against the arrays (see problems) and write it; a container with problems is refused."""
    c = Container(path)
    found = problems(c, project)
    if found:
        raise ValueError("; ".join(found))
    with c.fs.open_output_stream(f"{c.path}/index.json") as f:
        f.write(json.dumps(project).encode())


def _array(c: Container, name: str) -> dict:
    return {"filename": name, "item_count": sum(n for _, n in c.parts(name))}


def geometry_length(g: dict, location: str) -> int | None:
    """How many values an attribute at a location of a geometry has; null if it has no such place."""
    count = lambda key: (g.get(key) or {}).get("item_count")
    cells = g.get("grid", {}).get("count") or [a["item_count"] for a in (g.get("grid", {}).get(k) for k in "uvw") if a]
    product = lambda x: x[0] * product(x[1:]) if x else 1
    table = {
        "PointSet": {"Vertices": count("vertices")},
        "LineSet": {"Vertices": count("vertices"), "Primitives": count("segments")},
        "Surface": {"Vertices": count("vertices"), "Primitives": count("triangles")},
        "GridSurface": {"Vertices": product([n + 1 for n in cells]), "Primitives": product(cells)},
        "BlockModel": {"Vertices": product([n + 1 for n in cells]), "Primitives": product(cells), "Subblocks": ((g.get("subblocks") or {}).get("subblocks") or {}).get("item_count")},
    }
    return table.get(g.get("type"), {}).get(location)


def elements_of(project: dict) -> Iterator[dict]:
    """Elements, those of composites included."""
    todo = list(project.get("elements", []))
    while todo:
        e = todo.pop(0)
        yield e
        todo = e["geometry"].get("elements", []) + todo


def problems(c: Container, project: dict) -> list[str]:
    """What is wrong with an index: missing arrays, arrays of another length than it says or than their place has, repeated names."""
    out, seen = [], set()
    for e in elements_of(project):
        name, g = e.get("name", ""), e["geometry"]
        if name in seen:
            out.append(f"element {name} is there twice")
        seen.add(name)
        arrays = [g.get(k) for k in ("vertices", "segments", "triangles", "heights")] + [(g.get("subblocks") or {}).get("subblocks")]
        for a in e.get("attributes", []):
            values = a["data"].get("values")
            arrays += [values, a["data"].get("names")]
            want = geometry_length(g, a["location"])
            if want is None:
                out.append(f"{name}: {a['name']} lies at {a['location']}, which a {g['type']} doesn't have")
            elif values and values["item_count"] != want:
                out.append(f"{name}: {a['name']} has {values['item_count']} values for {want} {a['location']}")
        for a in filter(None, arrays):
            try:
                n = _array(c, a["filename"])["item_count"]
            except ValueError as err:
                out.append(f"{name}: {err}")
                continue
            if n != a["item_count"]:
                out.append(f"{name}: {a['filename']} has {n} rows, not {a['item_count']}")
    return out


# elements


def find(project: dict, name: str) -> dict:
    for e in elements_of(project):
        if e.get("name") == name:
            return e
    raise ValueError(f"no element {name}")


def _moved(origin: Sequence[float] | None, project: dict, columns: Sequence[str] = VERTEX) -> list[Column]:
    at = [a + b for a, b in zip(origin or (0, 0, 0), project.get("origin") or (0, 0, 0), strict=True)]
    return [(F.col(c).cast("double") + F.lit(float(o))).alias(c) for c, o in zip(columns, at, strict=True)]


def _with_values(spark: SparkSession, path: str, base: str, e: dict, location: str) -> tuple[list[tuple[str, str]], list[Column], list]:
    """Arrays to read beside `base`, the columns of its attributes, and names tables of the category ones."""
    arrays, columns, names = [("", base)] if base else [], [], []
    for i, a in enumerate(x for x in e.get("attributes", []) if x["location"] == location and x["data"].get("values")):
        kind, p = a["data"]["type"], f"__{i}_"
        arrays.append((p, a["data"]["values"]["filename"]))
        # vectors and colours are one column, a group that may be null as a whole
        columns.append(F.col(p + ATTRIBUTES[kind][1]).alias(a["name"]))
        if kind == "Category" and a["data"].get("names"):
            names.append((a["name"], read_arrays(spark, path, [("", a["data"]["names"]["filename"])]).select(F.col("row").alias("__code"), F.col("name").alias("__name"))))
    return arrays, columns, names


def _named(df: DataFrame, names: list) -> DataFrame:
    """Codes of category attributes replaced by their names; a code without a name is null."""
    for column, table in names:
        df = df.join(table, F.col(f"`{column}`") == F.col("__code"), "left").withColumn(column, F.col("__name")).drop("__code", "__name")
    return df


def read_points(spark: SparkSession, path: str, name: str) -> DataFrame:
    """row, x, y, z in the world, and the attributes at vertices of a point set, line set or surface."""
    project = Container(path).index()
    e = find(project, name)
    arrays, columns, names = _with_values(spark, path, e["geometry"]["vertices"]["filename"], e, "Vertices")
    return _named(read_arrays(spark, path, arrays).select("row", *_moved(e["geometry"].get("origin"), project), *columns), names)


def _cornered(spark: SparkSession, path: str, name: str, key: str, corners: Sequence[str]) -> DataFrame:
    e = find(Container(path).index(), name)
    arrays, columns, names = _with_values(spark, path, e["geometry"][key]["filename"], e, "Primitives")
    own = read_arrays(spark, path, arrays).select("row", *[F.col(c).alias(f"__{c}") for c in corners], *columns)
    points = read_points(spark, path, name).select(F.col("row").alias("__point"), *VERTEX)
    for c in corners:
        mine = points.select(F.col("__point").alias(f"__p{c}"), *[F.col(x).alias(c + x) for x in VERTEX])
        own = own.join(mine, F.col(f"__{c}") == F.col(f"__p{c}")).drop(f"__{c}", f"__p{c}")
    return _named(own, names)


def read_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """row, ax..bz and the attributes of each segment of a line set (traces and intervals of drill holes are such)."""
    return _cornered(spark, path, name, "segments", SEGMENT)


def read_surface(spark: SparkSession, path: str, name: str) -> DataFrame:
    """row, ax..cz and the attributes of each triangle of a surface."""
    return _cornered(spark, path, name, "triangles", TRIANGLE)


def _edges(spark: SparkSession, path: str, grid: dict, axis: int) -> list[float]:
    """Where the cells of a grid begin along an axis, and where the last one ends: as many as the grid has cells that way."""
    if grid["type"] == "Regular":
        return [grid["size"][axis] * i for i in range(grid["count"][axis] + 1)]
    sizes = [r[0] for r in read_arrays(spark, path, [("", grid["uvw"[axis]]["filename"])]).orderBy("row").select("scalar").collect()]
    out = [0.0]
    for s in sizes:
        out.append(out[-1] + s)
    return out


def _edge(spark: SparkSession, path: str, grid: dict, axis: int, at: Column) -> Column:
    if grid["type"] == "Regular":
        return at.cast("double") * F.lit(float(grid["size"][axis]))
    return F.get(F.array(*[F.lit(float(x)) for x in _edges(spark, path, grid, axis)]), at.cast("int"))


def _counts(grid: dict) -> list[int]:
    return grid.get("count") or [grid[k]["item_count"] for k in "uvw" if k in grid]


def read_grid_surface(spark: SparkSession, path: str, name: str) -> DataFrame:
    """row, x, y, z and the attributes at the vertices of a gridded surface; without heights it is flat."""
    project = Container(path).index()
    e = find(project, name)
    g, o = e["geometry"], e["geometry"]["orient"]
    n = _counts(g["grid"])[0] + 1
    base = g["heights"]["filename"] if g.get("heights") else ""
    arrays, columns, names = _with_values(spark, path, base, e, "Vertices")
    rows = read_arrays(spark, path, arrays) if arrays else spark.range(geometry_length(g, "Vertices")).withColumnRenamed("id", "row")
    u, v = o.get("u") or [1, 0, 0], o.get("v") or [0, 1, 0]
    up = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    a, b = (_edge(spark, path, g["grid"], axis, at) for axis, at in ((0, F.col("row") % n), (1, F.floor(F.col("row") / n))))
    h = F.col("scalar").cast("double") if base else F.lit(0.0)
    origin = [p + q for p, q in zip(o["origin"], project.get("origin") or (0, 0, 0), strict=True)]
    xyz = [(F.lit(float(origin[k])) + a * float(u[k]) + b * float(v[k]) + h * float(up[k])).alias(c) for k, c in enumerate(VERTEX)]
    return _named(rows.select("row", *xyz, *columns), names)


def read_blocks(spark: SparkSession, path: str, name: str) -> DataFrame:
    """row, parent i, j, k, x0..z1 in the model's frame, world centroid x, y, z and the attributes of a block model.

    Of a model with sub-blocks its sub-blocks (corners are shares of the parent, or steps of its own grid) with the
    attributes at Subblocks; else its blocks, the first axis fastest, with those at Primitives.
    """
    project = Container(path).index()
    e = find(project, name)
    g, o, sub = e["geometry"], e["geometry"]["orient"], e["geometry"].get("subblocks")
    n = _counts(g["grid"])
    arrays, columns, names = _with_values(spark, path, sub["subblocks"]["filename"] if sub else "", e, "Subblocks" if sub else "Primitives")
    rows = read_arrays(spark, path, arrays) if arrays else spark.range(n[0] * n[1] * n[2]).withColumnRenamed("id", "row")
    if sub:
        steps = sub.get("count") or [1, 1, 1]
        parent = [F.col(f"parent_{a}").cast("long") for a in "uvw"]
        share = {(a, end): F.col(f"corner_{end}_{a}").cast("double") / float(steps[k]) for k, a in enumerate("uvw") for end in ("min", "max")}
    else:
        row = F.col("row")
        parent = [row % n[0], F.floor(row / n[0]) % n[1], F.floor(row / (n[0] * n[1]))]
        share = {(a, end): F.lit(float(end == "max")) for a in "uvw" for end in ("min", "max")}
    out = rows.select("*", *[p.cast("long").alias(c) for p, c in zip(parent, "ijk", strict=True)])
    bounds = {}
    for k, (a, c, x) in enumerate(zip("uvw", "ijk", VERTEX, strict=True)):
        lo, hi = _edge(spark, path, g["grid"], k, F.col(c)), _edge(spark, path, g["grid"], k, F.col(c) + 1)
        bounds |= {f"{x}0": lo + (hi - lo) * share[a, "min"], f"{x}1": lo + (hi - lo) * share[a, "max"]}
    axes = [o.get(a) or [float(a == b) for b in "uvw"] for a in "uvw"]
    origin = [p + q for p, q in zip(o["origin"], project.get("origin") or (0, 0, 0), strict=True)]
    out = out.withColumns(bounds)
    mid = [(F.col(f"{x}0") + F.col(f"{x}1")) / 2 for x in VERTEX]
    centre = [(F.lit(float(origin[k])) + sum((mid[a] * float(axes[a][k]) for a in range(3)), F.lit(0.0))).alias(x) for k, x in enumerate(VERTEX)]
    return _named(out.select("row", *"ijk", *bounds, *centre, *columns), names)


def _attribute(c: Container, name: str, kind: str, location: str, array: str, names: str | None = None) -> dict:
    data = {"type": kind, "values": _array(c, array)} | ({"names": _array(c, names)} if names else {})
    return {"name": name, "location": location, "data": data}


#: Spark types by the kind of attribute that holds them.
_KINDS = {"string": "Text", "boolean": "Boolean"}


def _kind(df: DataFrame, column: str) -> str:
    return _KINDS.get(dict(df.dtypes)[column], "Number")


def _write_element(df: DataFrame, path: str, key: str, columns: dict[str, str], attributes: Sequence[str], location: str) -> tuple[dict, list[dict]]:
    """The array `key` of an element and its attributes, in the order of df's rows, in one pass."""
    members = {f"{key}.parquet": columns} if columns else {}
    for a in attributes:
        members[f"{key}-{a}.parquet"] = {a: ATTRIBUTES[_kind(df, a)][1]}
    write_arrays(df, path, members, list(columns))
    c = Container(path)
    return (_array(c, f"{key}.parquet") if columns else {}), [_attribute(c, a, _kind(df, a), location, f"{key}-{a}.parquet") for a in attributes]


def write_points(df: DataFrame, path: str, name: str, attributes: Sequence[str] = (), origin: Sequence[float] = (0, 0, 0)) -> dict:
    """Write df(x, y, z, attributes) as a point set, less its origin; returns its element of the index."""
    away = df.withColumns({c: F.col(c) - F.lit(float(o)) for c, o in zip(VERTEX, origin, strict=True)})
    vertices, described = _write_element(away, path, f"{name}-vertices", {c: c for c in VERTEX}, attributes, "Vertices")
    return {"name": name, "geometry": {"type": "PointSet", "origin": list(origin), "vertices": vertices}, "attributes": described}


def write_cornered(points: DataFrame, parts: DataFrame, path: str, name: str, attributes: Sequence[str] = ()) -> dict:
    """Write points(x, y, z), in order of their own numbers, and parts(a, b[, c]) that refer to them, as a line set or surface."""
    corners = TRIANGLE if "c" in parts.columns else SEGMENT
    kind, key = ("Surface", "triangles") if corners == TRIANGLE else ("LineSet", "segments")
    vertices, _ = _write_element(points, path, f"{name}-vertices", {c: c for c in VERTEX}, (), "Vertices")
    array, described = _write_element(parts, path, f"{name}-{key}", {c: c for c in corners}, attributes, "Primitives")
    return {"name": name, "geometry": {"type": kind, "vertices": vertices, key: array}, "attributes": described}


def write_blocks(df: DataFrame, path: str, name: str, orient: dict, grid: dict, attributes: Sequence[str], steps: Sequence[int] | None = None) -> dict:
    """Write a block model. df has the SUBBLOCK columns and its rows are sub-blocks (regular with `steps` to a parent); or no such column and its rows are all blocks, the first axis fastest."""
    is_sub = SUBBLOCK[0] in df.columns
    array, described = _write_element(df, path, f"{name}-subblocks" if is_sub else f"{name}-blocks", {c: c for c in SUBBLOCK} if is_sub else {}, attributes, "Subblocks" if is_sub else "Primitives")
    geometry = {"type": "BlockModel", "orient": orient, "grid": grid}
    if is_sub:
        geometry["subblocks"] = ({"type": "Regular", "count": list(steps)} if steps else {"type": "Freeform"}) | {"subblocks": array}
    return {"name": name, "geometry": geometry, "attributes": described}


def pack(spark: SparkSession, folder: str, target: str) -> None:
    """The folder as one zip file, streamed by one task part by part: a file is written from one place.

    Arrays of several parts stay several members beside their manifest; members are stored, so that a row group can be
    read from the middle of the file.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pfs

        for b in batches:
            source, (fs, at) = Container(folder), _filesystem(target)
            with fs.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for f in fs.get_file_info(pfs.FileSelector(source.path, recursive=True)):
                    if f.is_file and f.path != at:
                        with z.open(posixpath.relpath(f.path, source.path), "w", force_zip64=True) as to, fs.open_input_file(f.path) as src:
                            while chunk := src.read(1 << 20):
                                to.write(chunk)
            yield pa.record_batch([pa.array([1] * b.num_rows)], ["n"])

    spark.range(1).mapInArrow(run, "n long").collect()
