"""Matching references to ground that was cut anew: which block a reference means, or why none, and what took its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import in_ring
from .spatial import cell

#: Levels within this are one level; volumes within the greater of this and this share are the same.
LEVEL, VOLUME = 1e-6, 1e-6


def _same_volume(was: Column, now: Column) -> Column:
    near = F.abs(was - now) <= F.greatest(F.lit(VOLUME), F.abs(was) * VOLUME)
    return F.when(was.isNull() & now.isNull(), True).when(was.isNull() | now.isNull(), False).otherwise(near)


def _holding(refs: DataFrame, ground: DataFrame, size: float) -> DataFrame:
    """refs with the blocks of their solid, under g_*, whose outline holds their point; outlines are dealt to the plan cells of their box."""
    span = lambda v: F.sequence(cell(F.array_min(F.col(f"outline.{v}")), size), cell(F.array_max(F.col(f"outline.{v}")), size))
    g = ground.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))
    g = g.select(F.col("solid").alias("__solid"), "gx", "gy", *[F.col(c).alias(f"g_{c}") for c in ("block", "base", "top", "outline", "footprint", "area", "volume")])
    r = refs.withColumns({"rx": cell(F.col("x"), size), "ry": cell(F.col("y"), size)})
    j = r.join(g, (F.col("solid") == F.col("__solid")) & (F.col("rx") == F.col("gx")) & (F.col("ry") == F.col("gy")))
    return j.where(in_ring(F.col("g_outline"), F.col("x"), F.col("y"))).drop("g_outline", "__solid", "rx", "ry", "gx", "gy")


def resolve(refs: DataFrame, ground: DataFrame, size: float) -> DataFrame:
    """(ref, status, block, was, now) of each of refs(ref, solid, source, base, top, x, y, footprint, area, volume).

    ground(block, solid, source, base, top, outline: array of struct x, y, footprint, area, volume) is the present cut,
    one row a block. The first of these that holds is the status: solid missing; source changed (of the solid's least
    block); flitch missing (no block of the solid has the base); flitch top changed (was, now; none with both levels holds
    the point and the least block of the base has another top); ground missing; ground ambiguous (now: how many hold it);
    ground changed (another footprint; was, now: areas); volume changed (was, now); resolved, with the block.

    Levels are equal within 1e-6. A null volume is that of a piece that isn't closed, and equals only another. A
    reference without a finite point and levels, or without a positive area, is malformed. Equal references fare alike.

    Solids are summed up first, to a row a solid and a row a base; points meet outlines by plan cell.
    """
    finite = F.lit(True)
    for c in ("base", "top", "x", "y", "area"):
        finite = finite & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    r = refs.withColumn("__id", F.monotonically_increasing_id()).withColumn("__sound", finite & (F.col("area") > 0) & F.coalesce(F.col("volume") >= 0, F.lit(True)))
    solids = ground.groupBy(F.col("solid").alias("__solid")).agg(F.min_by("source", "block").alias("__source"))
    level = lambda c: F.floor(F.col(c) / LEVEL).cast("long")
    bases = ground.groupBy("solid", "base").agg(F.min(F.struct("block", "top")).alias("first"))
    near = F.explode(F.array(*[level("base") + k for k in (-1, 0, 1)]))
    asked = r.where("__sound").select("__id", "solid", F.col("base").alias("__base"), near.alias("bucket"))
    held = bases.select(F.col("solid").alias("__s"), "base", "first", level("base").alias("__bucket"))
    seen = asked.join(held, (F.col("solid") == F.col("__s")) & (F.col("bucket") == F.col("__bucket"))).where(F.abs(F.col("base") - F.col("__base")) <= LEVEL)
    seen = seen.groupBy("__id").agg(F.min("first").alias("__first"))
    band = (F.abs(F.col("g_base") - F.col("base")) <= LEVEL) & (F.abs(F.col("g_top") - F.col("top")) <= LEVEL)
    over = _holding(r.where("__sound"), ground, size).where(band)
    over = over.groupBy("__id").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("g_block", "g_footprint", "g_area", "g_volume")).alias("__g"))
    j = r.join(solids, F.col("solid") == F.col("__solid"), "left").join(seen.withColumnRenamed("__id", "__i1"), F.col("__id") == F.col("__i1"), "left").join(over.withColumnRenamed("__id", "__i2"), F.col("__id") == F.col("__i2"), "left")
    n, g = F.coalesce("__n", F.lit(0)), F.col("__g")
    status = (
        F.when(~F.col("__sound"), "malformed")
        .when(F.col("__solid").isNull(), "solid missing")
        .when(~F.col("__source").eqNullSafe(F.col("source")), "source changed")
        .when(F.col("__first").isNull(), "flitch missing")
        .when((n == 0) & (F.abs(F.col("__first.top") - F.col("top")) > LEVEL), "flitch top changed")
        .when(n == 0, "ground missing")
        .when(n > 1, "ground ambiguous")
        .when(~g["g_footprint"].eqNullSafe(F.col("footprint")), "ground changed")
        .when(~_same_volume(F.col("volume"), g["g_volume"]), "volume changed")
        .otherwise("resolved")
    )
    out = j.withColumn("status", status)
    figure = lambda top, ground, volume: F.when(F.col("status") == "flitch top changed", top).when(F.col("status") == "ground changed", ground).when(F.col("status") == "volume changed", volume)
    was = figure(F.col("top"), F.col("area"), F.col("volume"))
    now = figure(F.col("__first.top"), g["g_area"], g["g_volume"])
    return out.select("ref", "status", F.when(F.col("status") == "resolved", g["g_block"]).alias("block"), was.cast("double").alias("was"), F.when(F.col("status") == "ground ambiguous", n).otherwise(now).cast("double").alias("now"))


def successors(refs: DataFrame, ground: DataFrame, size: float) -> DataFrame:
    """(ref, place, block) of the blocks that stand where a reference's ground stood: of its solid, with an overlap of levels and the point inside; top first, from 1 (ties: lesser block)."""
    higher = F.least("g_top", "top") - F.greatest("g_base", "base") > LEVEL
    hits = _holding(refs, ground, size).where(higher)
    nth = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("g_top"), "g_block"))
    return hits.withColumn("place", nth).select("ref", "place", F.col("g_block").alias("block"))


def heirs(old: DataFrame, new: DataFrame, size: float) -> DataFrame:
    """(block, old, share) of each block of a new cut that has a volume in common with the old one: the old block that most of it lies in.

    old and new are upright boxes (block, solid, x0..z1). A new block goes to the old one with the greatest common
    volume (ties: the lesser old block), so an old block may have several heirs and a new one has one; share is the
    part of the new block. Boxes meet by solid and plan cell, a pair in the first cell that both reach.
    """
    def dealt(df: DataFrame, p: str) -> DataFrame:
        cols = ["block", "solid", "x0", "y0", "z0", "x1", "y1", "z1"]
        out = df.where("x1 > x0 AND y1 > y0 AND z1 > z0").select(*[F.col(c).alias(p + c) for c in cols])
        out = out.withColumns({f"{p}cx": cell(F.col(f"{p}x0"), size), f"{p}cy": cell(F.col(f"{p}y0"), size)})
        return out.withColumn(f"{p}gx", F.explode(F.sequence(f"{p}cx", cell(F.col(f"{p}x1"), size)))).withColumn(f"{p}gy", F.explode(F.sequence(f"{p}cy", cell(F.col(f"{p}y1"), size))))

    j = dealt(old, "o").join(dealt(new, "n"), (F.col("osolid") == F.col("nsolid")) & (F.col("ogx") == F.col("ngx")) & (F.col("ogy") == F.col("ngy")))
    j = j.where((F.col("ogx") == F.greatest("ocx", "ncx")) & (F.col("ogy") == F.greatest("ocy", "ncy")))
    side = lambda c: F.greatest(F.lit(0.0), F.least(F.col(f"o{c}1"), F.col(f"n{c}1")) - F.greatest(F.col(f"o{c}0"), F.col(f"n{c}0")))
    whole = (F.col("nx1") - F.col("nx0")) * (F.col("ny1") - F.col("ny0")) * (F.col("nz1") - F.col("nz0"))
    j = j.withColumn("common", side("x") * side("y") * side("z")).where("common > 0").withColumn("part", F.col("common") / whole)
    best = j.groupBy("nblock").agg(F.min(F.struct((-F.col("common")).alias("c"), F.col("oblock"), F.col("part"))).alias("b"))
    return best.select(F.col("nblock").alias("block"), F.col("b.oblock").alias("old"), F.col("b.part").alias("share"))
