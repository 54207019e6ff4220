"""A byte index of large delimited files grouped by a key: one pass over file splits, then lookups that read only a key's bytes."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from .project import _filesystem

FORMAT = "byte_runs"
SPLIT, READ = 64 << 20, 1 << 20


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs as pfs

    fs, at = _filesystem(path)
    info = fs.get_file_info(at)
    found = [info] if info.is_file else fs.get_file_info(pfs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith((".", "_")))


def _lines(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in start..end; a line that runs on past the end is read whole."""
    at = start
    f.seek(max(0, start - 1))
    held = b""
    if start:
        # the byte before tells whether a line begins at start
        at, held = start - 1, b""
        while True:
            chunk = f.read(READ)
            if not chunk:
                return
            k = chunk.find(b"\n")
            if k >= 0:
                held, at = chunk[k + 1 :], at + k + 1
                break
            at += len(chunk)
    while at < end:
        k = held.find(b"\n")
        if k < 0:
            chunk = f.read(READ)
            if not chunk:
                if held:
                    yield at, held
                return
            held += chunk
            continue
        cut = held.rfind(b"\n") + 1
        for line in held[:cut].splitlines(keepends=True):
            if at >= end:
                return
            yield at, line
            at += len(line)
        held = held[cut:]


class RunsReader(DataSourceReader):
    def __init__(self, path: str, key: str, depth: str, split: int):
        self.path, self.key, self.depth, self.split = path, key, depth, split

    def partitions(self) -> list[InputPartition]:
        return [Split(p, a, min(size, a + self.split)) for p, size in _files(self.path) for a in range(0, size, self.split)] or [Split("", 0, 0)]

    def read(self, part: Split) -> Iterator[tuple]:
        if not part.path:
            return
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(part.path) as f:
            head = f.read(READ)
            first = head[: head.find(b"\n") + 1] or head
            names = [c.strip() for c in next(csv.reader([first.decode("utf-8-sig")]))]
            if self.key not in names or self.depth not in names:
                raise ValueError(f"{part.path} has no {self.key} or no {self.depth}")
            k, d = names.index(self.key), names.index(self.depth)
            curves = [i for i in range(len(names)) if i not in (k, d)]
            run = None
            for at, line in _lines(f, part.start, part.end):
                if at < len(first):
                    continue
                if not line.strip():
                    continue
                cells = next(csv.reader([line.decode("utf-8", "replace")]))
                try:
                    name, depth = cells[k].strip(), float(cells[d])
                except (IndexError, ValueError):
                    name, depth = None, None
                ok = bool(name) and depth is not None and depth == depth and abs(depth) < float("inf") and len(cells) == len(names)
                if run and ok and run[0] == name:
                    run[2], run[3], run[4], run[5] = at + len(line), min(run[3], depth), max(run[4], depth), run[5] + 1
                else:
                    if not ok:
                        # a row that can't be read neither ends nor joins a run
                        if run:
                            run[7] += 1
                        else:
                            yield (part.path, None, at, at + len(line), None, None, 0, [], 1)
                        continue
                    if run:
                        yield self._row(part.path, run, names)
                    run = [name, at, at + len(line), depth, depth, 1, set(), 0]
                for i in curves:
                    if cells[i].strip():
                        run[6].add(i)
            if run:
                yield self._row(part.path, run, names)

    @staticmethod
    def _row(path: str, run: list, names: list[str]) -> tuple:
        return (path, run[0], run[1], run[2], run[3], run[4], run[5], sorted(names[i] for i in run[6]), run[7])


class ByteRuns(DataSource):
    """options: path, key, depth, split."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, key string, start long, stop long, top double, bottom double, readings long, curves array<string>, skipped long"

    def reader(self, schema) -> DataSourceReader:
        return RunsReader(self.options["path"], self.options["key"], self.options["depth"], int(self.options.get("split", SPLIT)))


def index_runs(spark: SparkSession, path: str, key: str, depth: str, split: int = SPLIT) -> DataFrame:
    """(file, key, start, stop, top, bottom, readings, curves, skipped): where the rows of each key lie in a file or folder of delimited files.

    One pass: each task reads a split of bytes, one line at a time, and gives a row a run of rows with one key; runs
    that a split's edge cut are put together again over the index, which has a row or two a run. A row of another
    width than the head, without a key or a finite depth, is counted as skipped. curves are the columns with a cell
    that isn't blank. Quoted cells may not hold line breaks. A file without the two columns is an error.
    """
    spark.dataSource.register(ByteRuns)
    raw = spark.read.format(FORMAT).option("path", path).option("key", key).option("depth", depth).option("split", split).load()
    w = Window.partitionBy("file").orderBy("start")
    # rows that can't be read lie between runs; they don't part them
    real = raw.where("key IS NOT NULL")
    new = F.when(F.lag("key").over(w) == F.col("key"), 0).otherwise(1)
    runs = real.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    out = runs.groupBy("file", "key", "__run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.sum("readings").alias("readings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("curves")))).alias("curves"), F.sum("skipped").alias("skipped"))
    return out.drop("__run")


def read_key(index: DataFrame, path: str, keys: Sequence[str], key: str, depth: str, curves: Sequence[str]) -> DataFrame:
    """(key, depth, curve, value, read) of the readings of some keys: a task opens a file at a run's first byte and reads that run only.

    A cell that is no number is null; depths stay in file order within a run. read: the bytes that the run took.
    """
    runs = index.where(F.col("key").isin(list(keys))).select("file", F.col("key").alias("name"), "start", "stop")

    def run(batches):
        import pyarrow as pa

        fs, _ = _filesystem(path)
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_file(r["file"]) as f:
                    head = f.read(READ)
                    names = [c.strip() for c in next(csv.reader([(head[: head.find(b"\n") + 1] or head).decode("utf-8-sig")]))]
                    f.seek(r["start"])
                    raw = f.read(r["stop"] - r["start"])
                out = []
                for cells in csv.reader(io.StringIO(raw.decode("utf-8", "replace"))):
                    if len(cells) != len(names) or cells[names.index(key)].strip() != r["name"]:
                        continue
                    d = _number(cells[names.index(depth)])
                    if d is not None:
                        out += [(r["name"], d, c, _number(cells[names.index(c)]), len(raw)) for c in curves]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.float64(), pa.string(), pa.float64(), pa.int64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["key", "depth", "curve", "value", "read"])

    return runs.mapInArrow(run, "key string, depth double, curve string, value double, read long")


def _number(text: str) -> float | None:
    try:
        x = float(text)
    except ValueError:
        return None
    return x if x == x and abs(x) < float("inf") else None
