"""Haul roads: where a block meets the network, and the time of a drive along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .economics import speed_at
from .spatial import _neighbours, cell

#: Networks up to this many nodes are searched as one array in a block's own row; larger ones by plan cells.
FEW_NODES = 2_000


def access_length(a: list[Column], b: list[Column], max_grade: float) -> Column:
    """A straight drive that climbs no steeper than max_grade: the distance, or the height change at that grade if longer."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    return F.greatest(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.abs(d[2]) / max_grade)


def network_joins(blocks: DataFrame, links: DataFrame, nodes: DataFrame, max_grade: float) -> DataFrame:
    """(block, node, metres): all existing nodes that a block is linked to, else the one node with the shortest access.

    blocks(block, x, y, z), links(block, node), nodes(node, x, y, z); ties go to the lesser node. Of a small network
    the nodes are one array, in which a block finds its nearest in its own row; of a larger one see nearest_nodes.
    """
    at = nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"))
    metres = access_length([F.col(c) for c in "xyz"], [F.col(c) for c in ("nx", "ny", "nz")], max_grade)
    linked = blocks.join(links, "block").join(at, "node").select("block", "node", metres.alias("metres"))
    alone = blocks.join(linked.select("block").distinct(), "block", "left_anti")
    if nodes.limit(FEW_NODES + 1).count() > FEW_NODES:
        return linked.unionByName(nearest_nodes(alone, nodes, max_grade))
    every = at.agg(F.collect_list(F.struct("node", "nx", "ny", "nz")).alias("nodes"))
    far = F.transform("nodes", lambda n: F.struct(access_length([F.col(c) for c in "xyz"], [n["nx"], n["ny"], n["nz"]], max_grade).alias("metres"), n["node"].alias("node")))
    nearest = alone.crossJoin(F.broadcast(every)).select("block", F.array_min(far).alias("n")).where("n IS NOT NULL")
    return linked.unionByName(nearest.select("block", "n.node", "n.metres"))


def nearest_nodes(blocks: DataFrame, nodes: DataFrame, max_grade: float) -> DataFrame:
    """(block, node, metres): the node with the shortest access to each block, ties to the lesser node; for networks of any size.

    A block looks in its plan cell and the eight around it. What it finds is sure if it is no further than a cell is
    wide, as an access is at least the distance in plan; blocks that aren't sure look again in cells twice as wide.
    Cells start at about four nodes each, so most blocks are done in a round or two, and there are as many rounds as
    doublings to the extent at most. Without nodes there is no row.
    """
    n, *extent = nodes.agg(F.count(F.lit(1)), *[f(c) for c in "xy" for f in (F.min, F.max)]).first()
    lows = blocks.agg(*[f(c) for c in "xy" for f in (F.min, F.max)]).first()
    if not n or lows[0] is None:
        return blocks.select("block").crossJoin(nodes.select("node").limit(0)).withColumn("metres", F.lit(None).cast("double"))
    wide = max(max(extent[i + 1], lows[i + 1]) - min(extent[i], lows[i]) for i in (0, 2))
    area = max(extent[1] - extent[0], 1e-9) * max(extent[3] - extent[2], 1e-9)
    size = max((4 * area / n) ** 0.5, wide / 1e6, 1e-9)
    left, out = blocks.select("block", "x", "y", "z"), None
    while True:
        last = size >= wide
        at = nodes.select("node", *[F.col(c).alias(f"n{c}") for c in "xyz"], cell(F.col("x"), size).alias("gx"), cell(F.col("y"), size).alias("gy"))
        around = _neighbours(left.withColumns({"gx": cell(F.col("x"), size), "gy": cell(F.col("y"), size)}), ["gx", "gy"])
        metres = access_length([F.col(c) for c in "xyz"], [F.col(c) for c in ("nx", "ny", "nz")], max_grade)
        best = around.join(at, ["gx", "gy"]).withColumn("metres", metres).groupBy("block").agg(F.min(F.struct("metres", "node")).alias("n"))
        found = staged(best.select("block", "n.node", "n.metres").where(F.lit(last) | (F.col("metres") <= size)), "nearest-nodes")
        out = found if out is None else out.unionByName(found)
        left = staged(left.join(found.select("block"), "block", "left_anti"), "nearest-left")
        if last or left.isEmpty():
            return out
        size *= 2


def leg_times(points: DataFrame, keys: list[str], order: str, grades: list[tuple[float, float]], top: float, limit: str | None = None) -> DataFrame:
    """(keys, km, hours, rise, first_speed, last_speed) of a drive along points(keys, order, x, y, z).

    Each stretch goes at the speed of its grade (rise over plan length), capped by the truck and the road;
    stretches without length count for nothing.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    p = points.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"__d{c}") for c in "xyz"])
    length = F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy") + F.col("__dz") * F.col("__dz"))
    p = p.withColumn("__m", length).where(F.col("__m") > 1e-9)
    steep = F.col("__dz") / F.greatest(F.hypot("__dx", "__dy"), F.lit(1e-9))
    p = p.withColumn("__kph", speed_at(grades, steep, top, F.col(limit) if limit else None))
    km = F.col("__m") / 1000.0
    return p.groupBy(*keys).agg(
        F.sum(km).alias("km"),
        F.sum(km / F.col("__kph")).alias("hours"),
        F.sum(F.greatest("__dz", F.lit(0.0))).alias("rise"),
        F.min_by("__kph", order).alias("first_speed"),
        F.max_by("__kph", order).alias("last_speed"),
    )


def acceleration_loss(speed: Column, kph_per_second: float) -> Column:
    """Hours lost in reaching a speed from a stand, or in stopping from it."""
    return speed / (2.0 * kph_per_second) / 3600.0
