"""Drill and blast: decks laid by a rule, relief bands, numbering, and state at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import in_ring

#: A hole shorter than this has no depth; a fill deck needs at least so much left.
NO_DEPTH, LEAST_FILL = 1e-6, 0.1


def deck_table(decks: DataFrame) -> DataFrame:
    """decks(seq, product, length, and kind, density if there are any) of one rule with what lies above and below each.

    The first deck of null length fills; a later one has no length. kind is explosive, stemming or air; without
    the column every deck is explosive. A rule has a handful of decks, so its windows are small.
    """
    own = F.coalesce("length", F.lit(0.0))
    over = Window.partitionBy(F.lit(0)).orderBy("seq")
    total = F.sum(own).over(Window.partitionBy(F.lit(0)))
    above = F.coalesce(F.sum(own).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    fill = F.min(F.when(F.col("length").isNull(), F.col("seq"))).over(Window.partitionBy(F.lit(0)))
    kind = F.coalesce(F.col("kind"), F.lit("stemming")) if "kind" in decks.columns else F.lit("explosive")
    density = F.coalesce(F.col("density").cast("double"), F.lit(0.0)) if "density" in decks.columns else F.lit(0.0)
    return decks.select("seq", "product", own.alias("length"), kind.alias("kind"), density.alias("density"), above.alias("above"), (total - above - own).alias("below"), total.alias("fixed"), fill.alias("fill"))


def charge_holes(holes: DataFrame, decks: DataFrame, primer_offset: float = 0.0) -> DataFrame:
    """holes(hole, top, bottom, ...) with `decks` (an array of seq, product, kind, from, to, density, primer) and `problem`.

    Decks above the first fill deck are laid from the top, those below it from the toe, and the fill takes the
    rest. Without one they are laid from the top until the hole runs out. Each explosive deck that has a length
    has a primer, primer_offset above its end but within it. A hole without depth, one that leaves the fill too
    little, and one in which no explosive deck has a length, has the problem and null decks.

    The rule, a handful of decks, is one array that every task has; every hole is laid in its own row.
    """
    columns = deck_table(decks)
    rule = columns.agg(F.array_sort(F.collect_list(F.struct(*columns.columns)))).scalar()
    depth = F.col("bottom") - F.col("top")

    def laid(d: Column) -> Column:
        filled = d["fill"].isNotNull()
        down, up = F.col("top") + d["above"], F.col("bottom") - d["below"]
        start = F.when(filled & (d["seq"] > d["fill"]), up - d["length"]).otherwise(down)
        end = F.when(~filled, F.least(down + d["length"], F.col("bottom"))).when(d["seq"] < d["fill"], down + d["length"]).otherwise(up)
        return F.struct(d["seq"].alias("seq"), d["product"].alias("product"), d["kind"].alias("kind"), start.alias("from"), end.alias("to"), d["density"].alias("density"))

    def primed(x: Column) -> Column:
        at = F.greatest(x["from"], F.least(x["to"], x["to"] - max(primer_offset, 0.0)))
        return x.withField("primer", F.when((x["kind"] == "explosive") & (x["to"] - x["from"] > NO_DEPTH), at))

    fits = lambda d: d["fill"].isNotNull() | (F.col("top") + d["above"] < F.col("bottom") - NO_DEPTH)
    out = holes.withColumn("__rule", rule)
    out = out.withColumn("__laid", F.transform(F.transform(F.filter("__rule", fits), laid), primed))
    first = F.get("__rule", F.lit(0))
    too_short = (first["fill"].isNotNull() & (first["fixed"] > depth - LEAST_FILL)) | ~F.exists("__laid", lambda x: x["primer"].isNotNull())
    problem = F.when(depth <= NO_DEPTH, F.lit("no depth")).when(F.coalesce(too_short, F.lit(True)), F.lit("too short"))
    out = out.withColumn("problem", problem).withColumn("decks", F.when(F.col("problem").isNull(), F.col("__laid")))
    return out.drop("__laid", "__rule")


def lay_decks(holes: DataFrame, decks: DataFrame, primer_offset: float = 0.0) -> DataFrame:
    """(hole, seq, product, kind, from, to, density, primer, problem): a row a deck of charge_holes, or one with the problem."""
    charged = charge_holes(holes.select("hole", "top", "bottom"), decks, primer_offset)
    return charged.select("hole", "problem", F.explode_outer("decks").alias("d")).select("hole", *[F.col(f"d.{c}").alias(c) for c in ("seq", "product", "kind", "from", "to", "density", "primer")], "problem")


def charge_mass(charged: DataFrame, diameter: Column) -> Column:
    """The mass of a hole's explosive decks: length times density times the hole's section; 0 without any.

    The diameter is in metres and the density in tonnes a cubic metre, so the mass is in tonnes.
    """
    volume = F.aggregate(F.coalesce(charged["decks"], F.array().cast(charged.schema["decks"].dataType)), F.lit(0.0), lambda a, d: a + F.when(d["kind"] == "explosive", (d["to"] - d["from"]) * d["density"]).otherwise(0.0))
    return volume * F.pi() * F.pow(diameter / 2, 2)


def relief_band(time: Column, relief: Column, low: float, high: float) -> Column:
    """unfired without a time, free without a relief, else tight below low, slack above high, good between."""
    return F.when(time.isNull(), "unfired").when(relief.isNull(), "free").when(relief < low, "tight").when(relief > high, "slack").otherwise("good")


def lowest_unused(used: DataFrame, wanted: DataFrame, keys: list[str], number: str, order: list[str]) -> DataFrame:
    """wanted with `number`: in order, the lowest whole numbers from 1 that the key hasn't used.

    The n-th free number follows from the used ones in order: before the i-th used number u lie u - i free
    ones, so a free number is its rank plus the used ones that come before it; a merge along one order.
    """
    taken = used.where(F.col(number) >= 1).select(*keys, F.col(number).cast("long").alias("u")).distinct()
    free = F.col("u") - F.row_number().over(Window.partitionBy(*keys).orderBy("u"))
    marks = taken.select(*keys, free.alias("__at"), F.lit(0).alias("__kind"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # a wanted row of rank n comes after all used numbers that have fewer than n free ones before them
    asks = wanted.withColumn("__at", nth.cast("long")).withColumn("__kind", F.lit(1))
    both = asks.unionByName(marks.withColumn("__at", F.col("__at") + 1), allowMissingColumns=True)
    passed = F.count_if(F.col("__kind") == 0).over(Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("__passed", passed).where("__kind = 1").select(*wanted.columns, (F.col("__at") + F.col("__passed")).alias(number))


def worked(spans: DataFrame, quantity: str, since: Column, until: Column) -> Column:
    """What of a span's quantity falls in [since, until): by its share of the span's time; a span without time has none."""
    length = F.col("end") - F.col("start")
    overlap = F.greatest(F.least(F.col("end"), until) - F.greatest(F.col("start"), since), F.lit(0.0))
    return F.when(length > 0, F.col(quantity) * overlap / length).otherwise(F.lit(0.0))


def stage_at(fired: Column, done: list[Column], names: list[str], at: Column, tolerance: float = 1e-9) -> Column:
    """fired, else the last of the stages that is done by `at`, else not started; a missing time isn't reached."""
    reached = lambda t: F.coalesce(t <= at + tolerance, F.lit(False))
    out = F.when(reached(fired), F.lit("fired"))
    for t, name in reversed(list(zip(done, names, strict=True))):
        out = out.when(reached(t), F.lit(name))
    return out.otherwise(F.lit("not started"))


def done_shares(blasts: DataFrame, work: DataFrame, at: float) -> DataFrame:
    """(blast, activity, share) of blasts(blast, activity, quantity, done) at a time, from work(blast, activity, start, end, quantity).

    done is when the activity is over, null if never: from then on, and from the start if that is 0, the share is 1. Else
    it is what was worked by then, spans in part, of what is needed; 0 if nothing is.
    """
    span = F.col("end") - F.col("start")
    part = F.when(span > 0, F.col("quantity") * (F.least(F.lit(at), F.col("end")) - F.col("start")) / F.when(span > 0, span)).otherwise(F.col("quantity"))
    worked = work.where(F.col("start") < at).groupBy(F.col("blast").alias("__b"), F.col("activity").alias("__a")).agg(F.sum(part).alias("__w"))
    j = blasts.join(worked, (F.col("blast") == F.col("__b")) & (F.col("activity") == F.col("__a")), "left")
    over = F.coalesce((F.col("done") <= at) | (F.col("done") == 0), F.lit(False))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("__w", F.lit(0.0)) / F.when(F.col("quantity") > 0, F.col("quantity"))))
    return j.select("blast", "activity", F.when(over, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("share"))


def hold_at(blasts: DataFrame, work: DataFrame, names: list[str], at: float, tolerance: float = 1e-9) -> DataFrame:
    """(blast, hold) of what each of blasts(blast, fired, cleared, above, done: array by names, unworked) waits for at a time.

    fired; awaiting window (all is done); never clears or above standing (the first step waits for the ground above, which `above`
    says never clears); no machine (unworked names the step that no machine does); working <step> or queued <step>.
    """
    by = lambda t: F.coalesce(t <= at + tolerance, F.lit(False))
    steps = F.array(*map(F.lit, names))
    open_ = F.filter(F.zip_with(steps, "done", lambda n, t: F.struct(n.alias("n"), t.alias("t"))), lambda x: ~by(x["t"]))
    running = work.where((F.col("start") <= at + tolerance) & (F.col("end") > at + tolerance)).select(F.col("blast").alias("__b"), F.col("activity").alias("__a")).distinct()
    step = blasts.withColumn("__step", F.get(open_, F.lit(0))["n"])
    j = step.join(running, (F.col("blast") == F.col("__b")) & (F.col("__step") == F.col("__a")), "left")
    waits = (F.col("__step") == names[0]) & ~by(F.col("cleared"))
    hold = (
        F.when(by(F.col("fired")), "fired")
        .when(F.col("__step").isNull(), "awaiting window")
        .when(waits & (F.col("above") == "never"), "never clears")
        .when(waits, "above standing")
        .when(F.col("unworked") == F.col("__step"), "no machine")
        .when(F.col("__b").isNotNull(), F.concat(F.lit("working "), "__step"))
        .otherwise(F.concat(F.lit("queued "), "__step"))
    )
    return j.select("blast", hold.alias("hold"))


def pattern_collars(boundaries: DataFrame, burden: float, spacing: float, degrees: float = 0.0, staggered: bool = False, most: int = 25_000) -> DataFrame:
    """(boundary, row, column, x, y, z) of a drill grid inside each of boundaries(boundary, ring: array of struct x, y, z).

    The grid is turned anticlockwise from x about the mean corner; spacing runs in a row, burden between rows, and every other row
    of a staggered grid moves half a spacing. It starts half a cell inside the turned bounds (in their middle, if they
    are narrower than a cell). Holes lie inside the ring by even-odd count or within 1e-8 of it, and stand on the
    plane of the ring (its mean corner and Newell normal). Over `most` holes, a scan of over 20 times as many places, or a ring
    without a usable plane is an error.

    Rows and columns are exploded from the ring's own bounds, so places of many rings are worked on at once.
    """
    if not (burden > 0 and spacing > 0):
        raise ValueError("burden and spacing must be greater than 0")
    import math

    s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    mean = lambda a: F.aggregate("ring", F.lit(0.0), lambda t, p: t + p[a]) / F.size("ring")
    b = boundaries.withColumns({f"m{a}": mean(a) for a in "xyz"})
    local = F.transform("ring", lambda p: F.struct(((p["x"] - F.col("mx")) * c + (p["y"] - F.col("my")) * s).alias("x"), ((p["y"] - F.col("my")) * c - (p["x"] - F.col("mx")) * s).alias("y")))
    b = b.withColumn("grid", local)
    ahead = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    newell = lambda u, v, w: F.aggregate(F.zip_with("ring", ahead, lambda p, q: (p[u] - q[u]) * (p[v] + q[v])), F.lit(0.0), lambda t, x: t + x).alias(w)
    edge = lambda f, a: f(F.transform("grid", lambda p: p[a]))
    b = b.select("*", newell("y", "z", "nx"), newell("z", "x", "ny"), newell("x", "y", "nz"), *[edge(f, a).alias(n + a) for a in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    wide, high = F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy")
    columns, rows = F.greatest(F.lit(1), F.ceil(wide / spacing)).cast("long"), F.greatest(F.lit(1), F.ceil(high / burden)).cast("long")
    fault = F.when(columns * rows > 20 * most, "too many places to scan").when(F.abs(F.col("nz")) <= F.greatest(F.abs(wide * high), F.lit(1.0)) * 1e-12, "no usable plane")
    first = lambda lo, hi, size, step: F.when(size < step, (F.col(lo) + F.col(hi)) / 2).otherwise(F.col(lo) + step / 2)
    b = b.withColumns({"x0": first("lox", "hix", wide, spacing), "y0": first("loy", "hiy", high, burden), "columns": F.when(fault.isNotNull(), F.raise_error(fault).cast("long")).otherwise(columns), "rows": rows})
    g = b.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    g = g.withColumn("gy", F.col("y0") + F.col("row") * burden).where("gy < hiy").withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)))
    shift = F.when(F.col("row") % 2 == 1, spacing / 2).otherwise(0.0) if staggered else F.lit(0.0)
    g = g.withColumn("gx", F.col("x0") + F.col("column") * spacing + shift).where("gx < hix")
    following = F.concat(F.slice("grid", 2, F.size("grid") - 1), F.slice("grid", 1, 1))

    def near(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        size = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("gx") - p["x"]) * dx + (F.col("gy") - p["y"]) * dy) / F.when(size > 0, size)))
        return F.coalesce(F.hypot(F.col("gx") - p["x"] - dx * t, F.col("gy") - p["y"] - dy * t) <= 1e-8, F.lit(False))

    on_edge = F.exists(F.zip_with("grid", following, near), lambda x: x)
    inside = g.where(in_ring(F.col("grid"), F.col("gx"), F.col("gy")) | on_edge)
    x, y = F.col("mx") + F.col("gx") * c - F.col("gy") * s, F.col("my") + F.col("gx") * s + F.col("gy") * c
    z = F.col("mz") - (F.col("nx") * (x - F.col("mx")) + F.col("ny") * (y - F.col("my"))) / F.col("nz")
    out = inside.select("boundary", "row", "column", x.alias("x"), y.alias("y"), z.alias("z"))
    n = F.count(F.lit(1)).over(Window.partitionBy("boundary"))
    return out.withColumn("boundary", F.when(n > most, F.raise_error(F.lit(f"a pattern of more than {most} holes")).cast(boundaries.schema["boundary"].dataType)).otherwise(F.col("boundary")))
