"""What the text operators share: staged tables, bounded broadcasts, exact distributed ranks, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Words are maximal runs of anything but these bytes, in every operator but decontamination.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of the operators' own only where a local session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "/tmp/strataframe-shared").rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, reads by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows and bytes, so that Python workers hold a few MB of text at a time, or one long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A new schema with more fields (add() would change the frame's own)."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def word_count(text: Column) -> Column:
    """Number of WORD matches; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, *cols: Column) -> Column:
    """A uniform number in [0, 1) from 52 bits of an MD5; the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def bucketed(df: DataFrame, group: str | None, key: str, rows: str, per_bucket: int = 4096) -> DataFrame:
    """Add __bucket: ranges of `key` (uniform in [0, 1)) holding about per_bucket of the group's `rows`."""
    n = F.greatest(F.lit(1), F.ceil(F.col(rows) / F.lit(per_bucket))).cast("long")
    return df.withColumn("__bucket", F.least(F.floor(F.col(key) * n), n - 1))


def prefix_within(df: DataFrame, group: list[str], order: list[Column], value: Column) -> DataFrame:
    """Add __before: the exact sum of `value` over the rows of the same group that come earlier.

    df has __bucket, increasing along `order`. Sums meet by (group, bucket), so that no task holds a whole
    group. The buckets' sums are put in order in runs of 4,096 buckets, and the runs' sums together: of 10**10
    rows in buckets of 4,096, those are some 600 a group.
    """
    keys = [*group, "__bucket"]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    sums = staged(sums.withColumn("__run", F.floor(F.col("__bucket") / 4096)), "bucket-sums")
    before = lambda w, c: F.coalesce(F.sum("__sum").over(w.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy(*group, "__run").agg(F.sum("__sum").alias("__sum"))
    runs = runs.select(*[F.col(g).alias(f"__of_{g}") for g in group], F.col("__run").alias("__nth_run"), before(Window.partitionBy(*group or [F.lit(0)]), "__run").alias("__run_start"))
    on = [F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in group]
    starts = sums.withColumn("__start", before(Window.partitionBy(*group, "__run"), "__bucket"))
    starts = starts.join(small(runs), reduce(and_, on, F.col("__run") == F.col("__nth_run"))).select(*keys, (F.col("__start") + F.col("__run_start")).alias("__start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = [ranked[k].eqNullSafe(starts[k]) for k in keys]
    out = ranked.join(starts, on, "left").select(*[ranked[c] for c in df.columns], (F.col("__inside") + F.col("__start")).alias("__before"))
    return out


def spread(df: DataFrame, key: str, most: int, *more: Column) -> DataFrame:
    """df with `key` (uniform in [0, 1)) drawn anew, by `more`, for rows whose key more than `most` rows share.

    Such rows have one id between them; each should still find a bucket of its own. There are fewer such keys
    than a share 1 / most of the rows.
    """
    shared = staged(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select(F.col(key).alias("__shared")), "shared-keys")
    if shared.isEmpty():
        return df
    out = df.join(small(shared), df[key] == F.col("__shared"), "left")
    return out.withColumn(key, F.when(F.col("__shared").isNotNull(), unit_hash("spread", F.col(key), *more)).otherwise(F.col(key))).select(*df.columns)


def power_of_two(n: int, least: int, most: int) -> int:
    return int(min(most, max(least, 1 << max(0, int(n) - 1).bit_length())))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three xor-shifts and two odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BitFilter:
    """Which 64-bit keys may be in a set: one bit per hashed key, of a size bounded by `most` bits.

    A key of the set always passes. With more keys than bits, more others pass as well, which costs time
    and never changes a result, as every user of the filter checks exactly afterwards.
    """

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.data):
            return np.zeros(len(keys), bool)
        at = mix64(keys.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(self.bits - 1)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filters_of(keys: DataFrame, column: str, counts: list[int], most: int = 1 << 29) -> list[BitFilter]:
    """BitFilters of a long column, in one job: with a column `level`, filter i has the keys of a level over i.

    counts: the keys of each filter. A filter takes 16 bits a key, and 64 MB at most, whatever the table holds.
    """
    bits = [power_of_two(16 * n, 1 << 15, most) if n else 8 for n in counts]

    def positions(batches):
        import pyarrow as pa

        for b in batches:
            k = mix64(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            level = b.column(1).to_numpy(zero_copy_only=False)
            for i, n in enumerate(bits):
                at = k[level > i] & np.uint64(n - 1)
                if len(at):
                    yield pa.record_batch([pa.array(np.full(len(at), i, np.int32)), pa.array((at >> np.uint64(15)).astype(np.int64)), pa.array((at & np.uint64(32767)).astype(np.int64))], ["nth", "seg", "pos"])

    level = F.col("level") if "level" in keys.columns else F.lit(1)
    parts = keys.select(column, level.alias("level")).mapInArrow(positions, "nth int, seg long, pos long").groupBy("nth", "seg").agg(F.expr("bitmap_construct_agg(pos)").alias("m"))
    out = [np.zeros(n // 8 if c else 0, np.uint8) for n, c in zip(bits, counts, strict=True)]
    # a job for each of a few partitions, so that no more than a share of the bits reaches the driver at once
    for row in parts.coalesce(4).toLocalIterator() if any(counts) else ():
        mine = out[row["nth"]][row["seg"] * 4096 : row["seg"] * 4096 + 4096]
        mine[:] = np.frombuffer(bytes(row["m"]), np.uint8)[: len(mine)]
    return [BitFilter(n, x.tobytes()) for n, x in zip(bits, out, strict=True)]


def filter_bits(keys: DataFrame, column: str, count: int, most: int = 1 << 29) -> BitFilter:
    """The BitFilter of a long column of `count` keys."""
    return filters_of(keys.select(column), column, [count], most)[0]


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (a row a source, say); else joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, or with more underscores if a column of the frames is called so (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parted(docs: DataFrame, key: list[Column], keys: DataFrame, finish: Callable | None = None, ddl: str = "", n_keys: int | None = None) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose key surely isn't among `keys` (columns in the order of `key`), and the others.

    The first part needs no join, so its texts stay where they lie; the second is about as large as `keys`.
    With `finish`, the first part's batches go through it in the same pass, to columns `ddl`. n_keys: how many keys there
    are, if it is known.
    """
    hashed = keys.select(F.xxhash64(*[F.col(f"`{c}`") for c in keys.columns]).alias("key"))
    keep = filter_bits(hashed, "key", keys.count() if n_keys is None else n_keys)
    name, schema = unused("__key", docs), docs.schema
    marked = docs.withColumn(name, F.xxhash64(*key))

    def part(touched: bool):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                hit = keep(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
                mask = pa.array(hit if touched else ~hit)
                rows = pa.RecordBatch.from_arrays([c.filter(mask) for c in b.columns[:-1]], b.schema.names[:-1])
                yield rows if touched or finish is None else finish(rows)

        return marked.mapInArrow(run, schema if touched or finish is None else ddl)

    return part(False), part(True)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, comp) for every node of edges(u, v): comp is the least node of its connected component.

    Large-star and small-star steps until nothing changes; every step is a pre-aggregated minimum and a
    join, and is staged, so a chain of any length or a node of any degree needs no large task.
    """
    def low(x: DataFrame) -> DataFrame:
        return x.groupBy("u").agg(F.min("v").alias("m"))

    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    size = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = size(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = low(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        m = low(large)
        small = large.join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).where("u != v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = staged(small, "edges")
        now = size(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
