"""List ranking by pointer jumping: where each element stands in its path, and the cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def _jumped(links: DataFrame, key: str | None = None) -> DataFrame:
    """(elem, ptr, dist, done, and best with a key) of links(elem, prev, key): ptr is the path's head where done, else the cycle goes round.

    dist counts the steps from ptr; best is the least key from elem back to ptr, of a cycle the least of all. Each
    round doubles the steps, so n elements in a row take log2(n) rounds; each is an equi-join, staged. Each round moves
    every element, so a key is carried only where one is asked for.
    """
    own = [] if key is None else [F.col(key).alias("best")]
    now = links.select("elem", F.coalesce("prev", "elem").alias("ptr"), F.col("prev").isNotNull().cast("long").alias("dist"), F.col("prev").isNull().alias("done"), *own)
    now, was = staged(now, "list-steps"), None
    while True:
        told = now.where("done").select("elem", "ptr", "dist", "done", *(["best", F.lit(False).alias("moved")] if own else []))
        open_ = now.where("NOT done")
        at = now.select(F.col("elem").alias("__at"), F.col("ptr").alias("__ptr"), F.col("dist").alias("__dist"), F.col("done").alias("__done"), *([F.col("best").alias("__best")] if own else []))
        step = open_.join(at, F.col("ptr") == F.col("__at"))
        # a cycle's dist would double for ever; it means nothing there
        dist = F.col("dist") + F.col("__dist")
        dist = F.when(F.col("__done"), dist).otherwise(F.least(dist, F.lit(1 << 60)))
        best = F.least("best", "__best")
        step = step.select("elem", F.col("__ptr").alias("ptr"), dist.alias("dist"), F.col("__done").alias("done"), *([best.alias("best"), (best != F.col("best")).alias("moved")] if own else []))
        after = staged(told.unionByName(step), "list-steps")
        moving = F.coalesce(F.max(F.col("moved").cast("int")), F.lit(0)) if own else F.lit(0)
        left, moved = after.where("NOT done").agg(F.count(F.lit(1)), moving).first()
        now = after.drop("moved")
        # each round ends some element of every path that is left, so once their number stands still there are only cycles; a cycle has gone round once no least key changes
        if not left or (left == was and not moved):
            return now
        was = left


def ranked(links: DataFrame, key: str = "key") -> DataFrame:
    """(elem, head, rank, closed) of links(elem, prev, key): the list that each element is in, by its head, and its place in it, from 0.

    prev is the element before, null for a head; no two elements share one. A cycle is cut before the element with
    the least key (keys are unique), which is then its head. No list is gathered in one task, however long. Keys are
    read for the elements of cycles only.
    """
    first = _jumped(links)
    places = lambda done, closed: done.select("elem", F.col("ptr").alias("head"), F.col("dist").alias("rank"), F.lit(closed).alias("closed"))
    paths, rings = places(first.where("done"), False), first.where("NOT done").select(F.col("elem").alias("__ring"))
    if rings.isEmpty():
        return paths
    round_ = staged(links.join(rings, F.col("elem") == F.col("__ring"), "left_semi").select("elem", "prev", key), "list-rings")
    least = _jumped(round_, key).select(F.col("elem").alias("__ring"), "best")
    cut = round_.join(least, F.col("elem") == F.col("__ring")).select("elem", F.when(F.col(key) != F.col("best"), F.col("prev")).alias("prev"))
    return paths.unionByName(places(_jumped(cut), True))
