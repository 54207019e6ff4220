"""Terrain thinned by a quadtree of plane fits: mergeable moments rolled up level by level, and a cut that meets a vertex budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import morton
from ..session import staged
from .spatial import cell

#: Sums of a plane fit z = ax + by + c; they merge by addition.
MOMENTS = ("n", "sx", "sy", "sz", "sxx", "sxy", "syy", "sxz", "syz", "szz")
#: A spread of this share of the axes' product has no plane (fixed value).
FLAT = 1e-6
#: Bins of a round of the search for the cut, and candidates that are put in order at once.
BINS, ORDERED = 1024, 20_000


def leaves(points: DataFrame, size: float, x0: float, y0: float, digits: int = 9) -> DataFrame:
    """(code, x, y, z, boundary): the mean of each occupied cell, less the origin, by its Morton code.

    Means are of fixed-point sums, so the order of points doesn't matter. boundary: one of the cell's eight
    neighbours is empty. Points left of or below the origin, or with a coordinate that isn't finite, aren't taken.
    """
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    p = points.where(ok).select(cell(F.col("x"), size, x0).alias("kx"), cell(F.col("y"), size, y0).alias("ky"), (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), "z").where("kx >= 0 AND ky >= 0")
    fixed = [F.sum(F.round(F.col(c) * 10**digits).cast("decimal(38,0)")).alias(c) for c in "xyz"]
    cells = p.groupBy("kx", "ky").agg(F.count(F.lit(1)).alias("n"), *fixed)
    cells = cells.select("kx", "ky", *[(F.col(c).cast("double") / 10**digits / F.col("n")).alias(c) for c in "xyz"])
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    # each cell tells its neighbours; a cell that eight others and itself have told is inside
    told = cells.select("kx", "ky", F.explode(offsets).alias("o")).groupBy((F.col("kx") + F.col("o.i")).alias("kx"), (F.col("ky") + F.col("o.j")).alias("ky")).agg(F.count(F.lit(1)).alias("told"))
    return cells.join(told, ["kx", "ky"]).select(morton(F.col("kx"), F.col("ky"), 31).alias("code"), "x", "y", "z", (F.col("told") < 9).alias("boundary"))


def residual(n="n") -> Column:
    """The sum of squared heights over the best plane; over the mean height with fewer than three points or no spread in plan."""
    m = lambda a: F.col(f"s{a}")
    c = lambda a, b: m(a + b) - m(a) * m(b) / F.col(n)
    czz = F.greatest(F.lit(0.0), c("z", "z"))
    det = c("x", "x") * c("y", "y") - c("x", "y") * c("x", "y")
    a = (c("y", "y") * c("x", "z") - c("x", "y") * c("y", "z")) / det
    b = (c("x", "x") * c("y", "z") - c("x", "y") * c("x", "z")) / det
    plane = F.greatest(F.lit(0.0), czz - a * c("x", "z") - b * c("y", "z"))
    return F.when(F.col(n) < 2, 0.0).when((F.col(n) < 3) | (det <= FLAT * c("x", "x") * c("y", "y")), czz).otherwise(plane)


def levels(cells: DataFrame, depth: int | None = None) -> DataFrame:
    """(level, code, MOMENTS, residual, children, children_residual, boundary) of every node: leaves are level 0, a parent's code is its child's >> 2.

    Each level is summed from the one below, a quarter of its size, until one node is left (or `depth` levels); levels
    are staged, as every one is read twice.
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    values = dict(zip(MOMENTS, (F.lit(1).cast("long"), x, y, z, x * x, x * y, y * y, x * z, y * z, z * z), strict=True))
    now = cells.select(F.lit(0).alias("level"), "code", *[v.alias(k) for k, v in values.items()], F.lit(0.0).alias("residual"), F.lit(0).cast("long").alias("children"), F.lit(0.0).alias("children_residual"), "boundary")
    now = staged(now, "quadtree")
    out, level = now, 0
    while (depth is None and now.limit(2).count() > 1) or (depth is not None and level < depth):
        level += 1
        up = now.groupBy(F.shiftright("code", 2).alias("code")).agg(*[F.sum(m).alias(m) for m in MOMENTS], F.count(F.lit(1)).alias("children"), F.sum("residual").alias("children_residual"), F.max("boundary").alias("boundary"))
        up = up.withColumn("level", F.lit(level)).withColumn("residual", residual())
        now = staged(up.select(*now.columns), "quadtree")
        out = out.unionByName(now)
    return out


def _priorities(nodes: DataFrame) -> DataFrame:
    """Nodes that can be split, with cost and key: the gain a vertex, but not more than that of the nodes above it.

    So in order of key (parents first) a node comes after all that must be split before it. Boundary nodes have no
    key; they go level by level before all others.
    """
    gain = F.greatest(F.lit(0.0), F.col("residual") - F.col("children_residual"))
    own = F.when(F.col("children") > 1, F.round(gain / F.greatest(F.lit(1), F.col("children") - 1), 9)).otherwise(0.0)
    able = nodes.where("children > 0").select("level", "code", "boundary", (F.col("children") - 1).alias("cost"), own.alias("own"))
    top = nodes.agg(F.max("level")).first()[0]
    if top is None:
        return able.withColumn("key", F.lit(None).cast("double")).drop("own")
    out, above = None, None
    for level in range(top, 0, -1):
        mine = able.where(F.col("level") == level)
        if above is None:
            now = mine.withColumn("key", F.col("own"))
        else:
            up = above.select(F.col("code").alias("__up"), F.col("key").alias("__limit"), F.col("boundary").alias("__edge"))
            now = mine.join(up, F.shiftright("code", 2) == F.col("__up")).withColumn("key", F.when(F.col("__edge"), F.col("own")).otherwise(F.least("own", "__limit")))
        above = staged(now.select("level", "code", "boundary", "cost", "key"), "quadtree-keys")
        out = above if out is None else out.unionByName(above)
    return out if out is not None else able.withColumn("key", F.col("own")).drop("own")


def _within(df: DataFrame, value: str, budget: int) -> tuple[float | None, DataFrame, int]:
    """The value under which rows of df(value, cost) in descending order no longer fit the budget, the rows of that value's bin, and what is left for them.

    Found over histograms of equal bins: each round keeps the one bin in which the budget ends.
    """
    here = df
    while True:
        lo, hi, n, total = here.agg(F.min(value), F.max(value), F.count(F.lit(1)), F.sum("cost")).first()
        if not n or total <= budget:
            return None, here.limit(0), budget - (total or 0)
        if n <= ORDERED or lo == hi:
            return hi, here, budget
        width = (hi - lo) / BINS
        at = F.least(F.lit(BINS - 1), F.floor((F.lit(hi) - F.col(value)) / F.lit(width)).cast("long")) if width > 0 else F.when(F.col(value) == hi, 0).otherwise(BINS - 1)
        bins = sorted((r["b"], r["cost"]) for r in here.groupBy(at.alias("b")).agg(F.sum("cost").alias("cost")).collect())
        for b, cost in bins:
            if cost > budget:
                break
            budget -= cost
        here = here.where(at == b)


def _first(df: DataFrame, values: list[str], budget: int) -> DataFrame:
    """The rows of df(level, code, cost, ...) that come first by `values`, each descending, as long as their costs fit the budget."""
    if not values:
        return df.limit(0)
    value, inside, left = _within(df, values[0], budget)
    if value is None:
        return df
    before = df.where(F.col(values[0]) > inside.agg(F.max(values[0])).first()[0])
    if inside.limit(ORDERED + 1).count() <= ORDERED:
        order = Window.orderBy(*[F.desc(v) for v in values]).rowsBetween(Window.unboundedPreceding, 0)
        return before.unionByName(inside.withColumn("__sum", F.sum("cost").over(order)).where(F.col("__sum") <= left).select(*df.columns))
    return before.unionByName(_first(inside, values[1:], left))


def cut(cells: DataFrame, budget: int, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(level, code, n, x, y, z): at most `budget` nodes of the quadtree that between them hold every cell, as mean points in the world.

    Starting from the root, nodes are split into their occupied children: first those that touch the edge of the
    footprint, level by level, then the others by gain (the fall of the squared residuals) a vertex that a split adds,
    as long as there is some gain. Ties go to the higher level, then to the greater code. Splits are taken in that
    order until the next one would exceed the budget. (A node with one occupied child touches the edge, and costs
    nothing.) An empty table gives none; a budget under 1 is as 1.

    The order is cut by histograms of keys, so nothing but bins reaches the driver and no task orders more than
    ORDERED nodes.
    """
    nodes = staged(levels(cells), "quadtree-nodes")
    keyed = staged(_priorities(nodes).withColumn("place", F.col("code").cast("double")).withColumn("height", F.col("level").cast("double")), "quadtree-order")
    left = max(1, budget) - 1
    edge = keyed.where("boundary")
    taken = _first(edge, ["height", "place"], left)
    spent = taken.agg(F.sum("cost")).first()[0] or 0
    if edge.agg(F.sum("cost")).first()[0] in (None, spent):
        taken = taken.unionByName(_first(keyed.where("NOT boundary AND key > 0"), ["key", "height", "place"], left - spent))
    split = staged(taken.select("level", "code"), "quadtree-splits")
    top = nodes.agg(F.max("level")).first()[0] or 0
    own = split.select(F.col("level").alias("__l"), F.col("code").alias("__c"))
    up = split.select((F.col("level") - 1).alias("__ul"), F.col("code").alias("__uc"))
    out = nodes.join(own, (F.col("level") == F.col("__l")) & (F.col("code") == F.col("__c")), "left_anti")
    reached = out.join(up, (F.col("level") == F.col("__ul")) & (F.shiftright("code", 2) == F.col("__uc")), "left_semi").unionByName(out.where(F.col("level") == top))
    mean = lambda s, o: (F.col(s) / F.col("n") + F.lit(float(o))).alias(s[1:])
    return reached.select("level", "code", "n", mean("sx", x0), mean("sy", y0), mean("sz", 0.0))
