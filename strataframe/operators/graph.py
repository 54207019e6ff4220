"""Shortest paths, reachability and networks by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage between rounds; the folder is the session's, and is set here only where a local session names none."""
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = conf.get("spark.checkpoint.dir", None)
        if not folder and not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "/tmp/strataframe-shared")
    return df.checkpoint()


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, cost): least cost from any source(node, cost) along edges(src, dst, w) with w >= 0.

    Each round relaxes from the nodes that improved in the last one only; it ends when none did, as it must
    after at most as many rounds as there are nodes. A negative weight, which could go on for ever, is an error.
    """
    edges = edges.withColumn("w", F.when(F.col("w") >= 0, F.col("w")).otherwise(F.raise_error(F.lit("a weight is negative or missing"))))
    best = _checkpointed(sources.groupBy("node").agg(F.min("cost").alias("cost")))
    frontier = best
    while True:
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("new")).groupBy("node").agg(F.min("new").alias("new"))
        joined = _checkpointed(best.join(step, "node", "full").select("node", F.least("cost", "new").alias("cost"), F.coalesce(F.col("new") < F.coalesce("cost", F.lit(float("inf"))), F.lit(False)).alias("better")))
        best, frontier = joined.select("node", "cost"), joined.where("better").select("node", "cost")
        if not frontier.take(1):
            return best


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node): everything that edges(src, dst) lead to from sources(node), sources included."""
    zero = edges.select("src", "dst", F.lit(0.0).alias("w"))
    return shortest_paths(zero, sources.select("node", F.lit(0.0).alias("cost"))).select("node")


def undirected(ties: DataFrame) -> DataFrame:
    return ties.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(ties.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


def tie_flow(ties: DataFrame, times: DataFrame) -> DataFrame:
    """(a, b, flow): forward if a fires before b, backward, together, or dead if either never fires."""
    t = times.select(F.col("node"), F.col("cost"))
    j = ties.join(t.select(F.col("node").alias("a"), F.col("cost").alias("ta")), "a", "left").join(t.select(F.col("node").alias("b"), F.col("cost").alias("tb")), "b", "left")
    flow = F.when(F.col("ta").isNull() | F.col("tb").isNull(), "dead").when(F.col("ta") < F.col("tb"), "forward").when(F.col("ta") > F.col("tb"), "backward").otherwise("together")
    return j.select("a", "b", flow.alias("flow"))


def network_issues(nodes: DataFrame, edges: DataFrame, steep: float) -> DataFrame:
    """(kind, id): dead ends (one road), lone nodes (none) and roads steeper than `steep`."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    j = nodes.select("node").join(degree, "node", "left")
    ends = j.where("n = 1").select(F.lit("dead end").alias("kind"), F.col("node").alias("id"))
    lone = j.where("n IS NULL").select(F.lit("no road").alias("kind"), F.col("node").alias("id"))
    hard = edges.where(F.abs("grade") > steep).select(F.lit("steep").alias("kind"), F.col("road").alias("id"))
    return ends.unionByName(lone).unionByName(hard)
