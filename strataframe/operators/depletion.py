"""How much of each block is gone at any time, from the spans of work on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals as I

#: What was worked may differ from what is gone by this share, or so many tonnes.
SHARE, LEAST = 1e-7, 1e-5


def curves(work: DataFrame, balances: DataFrame) -> DataFrame:
    """(block, at, mined, rate, started, final): knots of each block's mined tonnes, which go on at `rate` until the next.

    work(block, start, end, tonnes) are spans, several at a time; balances(block, started, remaining). final is the
    share that is gone in the end: 1 without a remainder. Tonnes that don't agree with the balance are an error, and so are
    tonnes in no time, negative ones, and a missing number. Spans without time and tonnes say nothing. Blocks of no
    tonnes have no curve.
    """
    bad = ~F.coalesce((F.col("tonnes") >= 0) & (F.col("end") >= F.col("start")) & ((F.col("end") > F.col("start")) | (F.col("tonnes") == 0)), F.lit(False))
    checked = work.withColumn("tonnes", F.when(bad, F.raise_error(F.concat(F.lit("invalid work on block "), F.col("block").cast("string"))).cast("double")).otherwise(F.col("tonnes")))
    spans = checked.where("end > start")
    sums = checked.groupBy("block").agg(F.sum("tonnes").alias("__sum")).withColumnRenamed("block", "__b")
    gone = F.col("started") - F.col("remaining")
    off = F.abs(F.coalesce("__sum", F.lit(0.0)) - gone) > F.greatest(F.col("started") * SHARE, F.lit(LEAST))
    text = F.concat(F.lit("block "), F.col("block").cast("string"), F.lit(": worked "), F.coalesce("__sum", F.lit(0.0)).cast("string"), F.lit(", gone "), gone.cast("string"))
    kept = balances.where("started > 0").join(sums, F.col("block") == F.col("__b"), "left")
    final = F.when(off, F.raise_error(text).cast("double")).when(F.col("remaining") <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), gone / F.col("started"))))
    kept = kept.select(F.col("block").alias("__of"), "started", final.alias("final"))
    knots = I.rate_knots(spans, ["block"], F.col("tonnes") / (F.col("end") - F.col("start")))
    w = Window.partitionBy("block").orderBy("at")
    step = F.coalesce(F.lag("rate").over(w) * (F.col("at") - F.lag("at").over(w)), F.lit(0.0))
    mined = knots.withColumn("__step", step).withColumn("mined", F.sum("__step").over(w))
    return mined.join(kept, F.col("block") == F.col("__of")).select("block", "at", "mined", "rate", "started", "final")


def fractions(asked: DataFrame, knots: DataFrame, instant: DataFrame) -> DataFrame:
    """asked(block, time) with `gone`: the share of the block that is gone at the time, 0 to 1.

    knots are those of curves; instant(block, emptied) are blocks of no tonnes, whole until then. A block with neither is
    whole. After a block's last span the share is its final one.
    """
    last = knots.groupBy("block").agg(F.max("at").alias("__last"), F.max("started").alias("__started"), F.max("final").alias("__final")).withColumnRenamed("block", "__k")
    now = I.asof(asked, knots.select("block", F.col("at").alias("__at"), "mined", "rate").withColumn("__since", F.col("__at")), ["block"], "time", "__since", ["__at", "mined", "rate"])
    j = now.join(last, F.col("block") == F.col("__k"), "left").join(instant.select(F.col("block").alias("__i"), "emptied"), F.col("block") == F.col("__i"), "left")
    mined = F.coalesce(F.col("mined") + F.col("rate") * (F.col("time") - F.col("__at")), F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mined / F.col("__started")))
    out = F.when(F.col("__i").isNotNull(), F.coalesce(F.col("time") >= F.col("emptied"), F.lit(False)).cast("double")).when(F.col("__k").isNull(), 0.0).when(F.col("time") >= F.col("__last"), F.col("__final")).otherwise(share)
    return j.select(*asked.columns, out.alias("gone"))
