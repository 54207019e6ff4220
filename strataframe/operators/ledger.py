"""Stockpile ledgers: lots in, reclaims out, first or last in first out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Less than this is dust and goes with the draw that leaves it.
DUST = 1e-9


def fifo(lots: DataFrame, draws: DataFrame, pile: str, order: str, amount: str) -> DataFrame:
    """(pile, lot, draw, tonnes): what each draw takes of each lot, the oldest first.

    Lots and draws of a pile are ranges of one running total; they meet where the ranges overlap, found by
    a merge of both ends in one ordered pass, not by a range join.
    """
    w = Window.partitionBy(pile).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = [df.withColumn("hi", F.sum(amount).over(w)).select(pile, F.col(order).alias(n), "hi") for df, n in ((lots, "lot"), (draws, "draw"))]
    both = ends[0].withColumn("draw", F.lit(None).cast("long")).unionByName(ends[1].withColumn("lot", F.lit(None).cast("long")))
    v = Window.partitionBy(pile).orderBy("hi", F.coalesce("lot", F.lit(1 << 60)), "draw")
    ahead = v.rowsBetween(0, Window.unboundedFollowing)
    cut = both.withColumn("__lo", F.coalesce(F.lag("hi").over(v), F.lit(0.0)))
    cut = cut.withColumn("lot", F.first("lot", True).over(ahead)).withColumn("draw", F.first("draw", True).over(ahead))
    out = cut.where("lot IS NOT NULL AND draw IS NOT NULL").withColumn("tonnes", F.col("hi") - F.col("__lo")).where(F.col("tonnes") > DUST)
    return out.groupBy(pile, "lot", "draw").agg(F.sum("tonnes").alias("tonnes"))


def run_ledger(key, pdf, last_first: bool = True):
    """Path-dependent draws of one pile: pdf(order, kind, amount, lot content), kind 0 a receipt and 1 a reclaim."""
    import pandas as pd

    held: list[list[float]] = []
    out = []
    for r in pdf.sort_values(["order", "kind"]).itertuples():
        if r.kind == 0:
            held.append([r.order, r.amount])
            continue
        want = r.amount
        while want > DUST and held:
            lot = held[-1 if last_first else 0]
            take = min(want, lot[1])
            if lot[1] - take <= DUST:
                take = lot[1]
                held.pop(-1 if last_first else 0)
            else:
                lot[1] -= take
            out.append((key[0], int(lot[0]), int(r.order), take))
            want -= take
    return pd.DataFrame(out, columns=["pile", "lot", "draw", "tonnes"])


def lifo(events: DataFrame, pile: str) -> DataFrame:
    """(pile, lot, draw, tonnes), the newest lot first; one pile is one sequence, piles run in parallel."""
    from functools import partial

    kind = events.schema[pile].dataType.simpleString()
    rows = events.withColumnRenamed(pile, "pile").groupBy("pile").applyInPandas(partial(run_ledger, last_first=True), f"pile {kind}, lot long, draw long, tonnes double")
    return rows.withColumnRenamed("pile", pile)
