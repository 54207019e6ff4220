"""Aggregates kept by slot: only slots whose files changed are read again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as M

PRINT = "__print"


def fingerprints(spark: SparkSession, path: str, slot: str) -> DataFrame:
    """(slot, __print, __folder) of a Parquet table partitioned by `slot`: a digest of its files' names, sizes and times, from the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    line = F.concat_ws("|", F.element_at(F.split("path", "/"), -1), F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rows = files.select(F.col(slot).cast("string").alias(slot), line.alias("f"), folder.alias("__folder")).groupBy(slot)
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("f")), "\n"), 256).alias(PRINT), F.min("__folder").alias("__folder"))


@dataclass
class Refreshed:
    """partials: the accumulators of every slot that the source has, with origin kept or new; changed: the slots that were read."""

    partials: DataFrame
    changed: list[str]


class SlotStore:
    """Partial accumulators of metrics by slot and keys, in a folder of their own.

    A row of the store carries the fingerprint of the files that it came from, so rows of slots that have changed or
    gone since are passed over when it is read, and a refresh that is broken off leaves nothing wrong behind. Use one folder for one
    set of metrics and keys.
    """

    def __init__(self, spark: SparkSession, folder: str, metrics: list[M.Metric], keys: list[str], slot: str = "slot"):
        self.spark, self.folder, self.metrics, self.keys, self.slot = spark, folder.rstrip("/"), metrics, keys, slot

    def _kept(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            kept = self.spark.read.parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return kept.withColumn(self.slot, F.col(self.slot).cast("string"))

    def refresh(self, path: str) -> Refreshed:
        """Bring the store up to date with the table at `path`, partitioned by the slot; slots whose files are as they were aren't read.

        The slots' fingerprints (a row a slot) are compared by a join; only the names of the changed ones reach the driver.
        """
        now, kept = fingerprints(self.spark, path, self.slot), self._kept()
        if kept is None:
            changed = now
        else:
            known = kept.select(F.col(self.slot).alias("__slot"), F.col(PRINT).alias("__known")).distinct()
            changed = now.join(known, (F.col(self.slot) == F.col("__slot")) & (F.col(PRINT) == F.col("__known")), "left_anti")
        found = {r[0]: r[1] for r in changed.select(self.slot, "__folder").collect()}
        names = sorted(found)
        if names:
            rows = self.spark.read.option("basePath", path).parquet(*found.values()).withColumn(self.slot, F.col(self.slot).cast("string"))
            parts = M.partials(rows, self.metrics, [self.slot, *[k for k in self.keys if k != self.slot]])
            prints = now.select(F.col(self.slot).alias("__slot"), PRINT)
            fresh = parts.join(prints, F.col(self.slot) == F.col("__slot")).drop("__slot")
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.slot).parquet(self.folder)
            kept = self._kept()
        if kept is None:
            return Refreshed(self.spark.createDataFrame([], f"`{self.slot}` string"), names)
        valid = kept.join(now.select(F.col(self.slot).alias("__slot"), F.col(PRINT).alias("__now")), (F.col(self.slot) == F.col("__slot")) & (F.col(PRINT) == F.col("__now")))
        origin = F.when(F.col(self.slot).isin(names), "new").otherwise("kept") if names else F.lit("kept")
        return Refreshed(valid.drop("__slot", "__now", PRINT).withColumn("origin", origin), names)

    def figures(self, refreshed: Refreshed, keys: list[str], digits: int = 6) -> DataFrame:
        """The metrics by keys (some of the store's, the slot or origin among them), merged over slots."""
        return M.finalise(M.merge(refreshed.partials, self.metrics, keys), self.metrics, keys, digits)
