"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucketed, prefix_within, spread, staged, unit_hash


def interleave(docs: DataFrame, shards: int = 24, seed: str = "shards", per_bucket: int = 4096) -> DataFrame:
    """Deal documents into shards whose row counts differ by one at most and whose mixtures are alike.

    docs needs doc_id, text, source; other columns are ignored. Rows of a source are shuffled by a seeded
    hash and ranked; row r of n has fractional rank (r + 0.5) / n; all rows in order of fractional rank
    (then source, null last, then rank) are cut into equal runs. So any run holds each source's share to
    within a row. The law is `rows`: shards' counts are at most one apart. Groups of equal texts are dealt
    like any rows, by their own ids: kept together, a group of more rows than a shard has would break that
    law, and copies spread over the shards are what a mixture asks for. text_crc32 names the group.

    Returns one row per input row: doc_id, size (UTF-8 bytes + 8; 8 for null), text_crc32 (0 for null, as
    for no bytes), source, law, shard, slot (from 0, without gaps, within the shard).
    Null is a source of its own; repeated rows are separate; an empty table gives none; with fewer rows
    than shards some shards are empty.

    Both rankings sum by buckets of a key that is uniform by construction (the hash, then the fractional
    rank), so a source with a third of all rows is spread evenly. More than per_bucket rows of one id (null, say)
    are shuffled by their texts and places in the input instead.
    """
    text = F.col("text").cast("string")
    base = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("__u", unit_hash(seed, F.col("doc_id")))
    base = staged(base.withColumn("__row", F.monotonically_increasing_id()), "shard-keys")
    base = spread(base, "__u", per_bucket, F.col("text_crc32"), F.col("__row")).drop("__row")
    n = base.groupBy("source").agg(F.count(F.lit(1)).alias("__n")).select(F.col("source").alias("__source"), "__n")
    n = staged(n.withColumn("__all", F.sum("__n").over(Window.partitionBy(F.lit(0)))), "shard-sources")
    rows = base.join(n, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    tie = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32").asc(), F.col("size").asc()]
    rows = prefix_within(bucketed(rows, "source", "__u", "__n", per_bucket), ["source"], [F.col("__u").asc(), *tie], F.lit(1))
    rows = rows.withColumn("__rank", F.col("__before")).withColumn("__part", (F.col("__rank") + 0.5) / F.col("__n")).drop("__before", "__bucket")
    order = [F.col("__part").asc(), F.col("source").asc_nulls_last(), F.col("__rank").asc()]
    rows = prefix_within(bucketed(rows, None, "__part", "__all", per_bucket), [], order, F.lit(1))
    shard = F.floor(F.col("__before") * shards / F.col("__all"))
    first = F.ceil(F.col("shard") * F.col("__all") / F.lit(shards))
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("__before") - first).cast("long"))
    return rows.select("doc_id", "size", "text_crc32", "source", F.lit("rows").alias("law"), "shard", "slot")
