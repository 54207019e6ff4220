"""Streams over files: hourly totals, deduplication, and a stateful ledger."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_totals(events: DataFrame, at: str, keys: list[str], value: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """n and total by window; a window is given out once the watermark has passed it."""
    w = events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def deduplicated(events: DataFrame, at: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "2 hours") -> DataFrame:
    s = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key)
    return s.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def balances(events: DataFrame, key: str, change: str) -> DataFrame:
    """(key, balance) after each batch: a running balance kept as state, never below 0."""
    kind = events.schema[key].dataType.simpleString()

    def step(k, batches: Iterator, state):
        import pandas as pd

        total = state.get[0] if state.exists else 0.0
        for pdf in batches:
            for c in pdf["change"]:
                total = max(0.0, total + c)
        state.update((total,))
        yield pd.DataFrame({"key": [k[0]], "balance": [total]})

    rows = events.select(F.col(key).alias("key"), F.col(change).cast("double").alias("change"))
    out = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, balance double", "total double", "update", "NoTimeout")
    return out.withColumnRenamed("key", key)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into Parquet files of the shared folder and return the table they make.

    Each micro-batch is one folder, written whole by its number, so a batch that is tried again replaces its
    first try; state and progress are in a checkpoint beside it. In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"{(shared or '/tmp/strataframe-shared').rstrip('/')}/stream-{uuid.uuid4().hex}"
    done = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batches/{number}")
        done.append(f"{base}/batches/{number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    paths = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema])
