"""The reports of a schedule: movements, haulage, loaders, drill and blast, stockpiles, crushers, dumps and trucks, by period.

deliveries(start, end (hours), agent, activity (dig or reclaim), source, destination, truck, tonnes, truck_hours, value,
the haul columns, and a column of contained quantity for each grade) are the one fact table. Everything in a period
is its share of a delivery by time, so a report is one explode into periods and one aggregate; nothing is joined by time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals as I

#: Hours of a tonne's haul by part, then its distance and climb.
HOURS = ("spot_h", "load_h", "loaded_h", "dump_h", "empty_h")
HAUL = (*HOURS, "loaded_km", "rise_m")
GROUPS = {"day": 24.0, "week": 168.0}


def by_period(spans: DataFrame, grouping: str) -> DataFrame:
    """spans(start, end, ...) once for each period they reach, with `period` (from 0), `inside` (hours) and `share` of the span.

    grouping: day, week or whole (one period). A span without length is in no period.
    """
    length = F.col("end") - F.col("start")
    some = spans.where(length > 0)
    if grouping == "whole":
        return some.withColumn("period", F.lit(0).cast("long")).withColumn("inside", length).withColumn("share", F.lit(1.0))
    hours = GROUPS[grouping]
    first, last = F.floor(F.col("start") / hours).cast("long"), F.ceil(F.col("end") / hours).cast("long") - 1
    each = some.withColumn("period", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("end"), (F.col("period") + 1) * hours) - F.greatest(F.col("start"), F.col("period") * hours)
    return each.withColumn("inside", inside).withColumn("share", F.col("inside") / length)


def _grade(contained: Column, tonnes: Column) -> Column:
    return F.when(tonnes > 1e-6, contained / tonnes)


def movements(deliveries: DataFrame, grouping: str, grades: Sequence[str] = ()) -> DataFrame:
    """(period, agent, activity, source, destination, tonnes, truck_hours, value, the grades): who moved what from where to where."""
    part = lambda c: F.sum(F.col(c) * F.col("share"))
    out = by_period(deliveries, grouping).groupBy("period", "agent", "activity", "source", "destination")
    out = out.agg(*[part(c).alias(c) for c in ("tonnes", "truck_hours", "value")], *[part(g).alias(g) for g in grades])
    return out.withColumns({g: _grade(F.col(g), F.col("tonnes")) for g in grades}) if grades else out


def _hauled(spread: DataFrame, keys: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """Tonnes and the nine measures of the haul by keys: minutes of each part and of the cycle, km, climb, and tonne-km."""
    t = F.col("tonnes") * F.col("share")
    sums = spread.groupBy(*keys).agg(F.sum(t).alias("tonnes"), *[F.sum(F.col(c) * t).alias(c) for c in HAUL], *more)
    mean = lambda c: F.when(F.col("tonnes") > 0, c / F.col("tonnes")).otherwise(F.lit(0.0))
    minutes = {c.removesuffix("_h") + "_min": mean(F.col(c)) * 60 for c in HOURS}
    cycle = mean(sum((F.col(c) for c in HOURS), F.lit(0.0))) * 60
    out = sums.withColumns(minutes | {"cycle_min": cycle, "km": mean(F.col("loaded_km")), "rise": mean(F.col("rise_m")), "tonne_km": F.col("loaded_km")})
    return out.drop(*HAUL)


MEASURES = (*[c.removesuffix("_h") + "_min" for c in HOURS], "cycle_min", "km", "rise", "tonne_km")


def haulage(deliveries: DataFrame, grouping: str) -> DataFrame:
    """The nine haul measures, weighed by tonnes, of each row of the movements."""
    return _hauled(by_period(deliveries, grouping), ["period", "agent", "activity", "source", "destination"])


def loaders(deliveries: DataFrame, delays: DataFrame, idle: DataFrame, rates: DataFrame, horizon: float, grouping: str, reasons: Sequence[str]) -> DataFrame:
    """(agent, period, dug, reclaimed, dig_h, reclaim_h, delay_h, a column of idle hours a reason, no_work): where each machine's time went.

    delays(agent, start, end) and idle(agent, start, end, reason) are spans; rates(agent, dig_tph, reclaim_tph) are what
    hours of work follow from (tonnes by rate: a span says when a machine was on a block, not how long its tonnes took).
    Idle time is what no delivery or delay covers: of that, an idle span's reason has what it overlaps, and no_work the
    rest of the period. Every agent of rates has every period up to the horizon.
    """
    hours = GROUPS.get(grouping, horizon)
    periods = max(1, -int(-horizon // hours)) if grouping != "whole" else 1
    spine = rates.select("agent").withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(periods - 1).cast("long"))))
    work = by_period(deliveries, grouping).join(rates, "agent")
    kind = lambda a, c: F.sum(F.when(F.col("activity") == a, c))
    t = F.col("tonnes") * F.col("share")
    rate = lambda c: F.when(F.col(c) > 0, t / F.col(c)).otherwise(F.lit(0.0))
    worked = work.groupBy("agent", "period").agg(kind("dig", t).alias("dug"), kind("reclaim", t).alias("reclaimed"), kind("dig", rate("dig_tph")).alias("dig_h"), kind("reclaim", rate("reclaim_tph")).alias("reclaim_h"))
    delayed = by_period(delays, grouping).groupBy("agent", "period").agg(F.sum("inside").alias("delay_h"))
    covers = deliveries.select("agent", "start", "end").unionByName(delays.select("agent", "start", "end"))
    busy = I.coalesce_spans(covers.where("start < end"), ["agent"]).select("agent", "start", "end")
    taken = by_period(busy, grouping).groupBy("agent", "period").agg(F.sum("inside").alias("__busy"))
    why = by_period(idle, grouping).groupBy("agent", "period").agg(*[F.sum(F.when(F.col("reason") == r, F.col("inside"))).alias(r) for r in reasons])
    out = spine
    for df in (worked, delayed, taken, why):
        out = out.join(df, ["agent", "period"], "left")
    out = out.fillna(0.0, ["dug", "reclaimed", "dig_h", "reclaim_h", "delay_h", "__busy", *reasons])
    whole = F.least(F.lit(float(horizon)), (F.col("period") + 1) * F.lit(float(hours))) - F.col("period") * F.lit(float(hours))
    left = whole - F.col("__busy") - sum((F.col(r) for r in reasons), F.lit(0.0))
    return out.withColumn("no_work", F.when(left > 1e-6, left).otherwise(F.lit(0.0))).drop("__busy")


def drill_blast(work: DataFrame, grouping: str) -> DataFrame:
    """(period, agent, activity, quantity, hours) of work(start, end, agent, activity, quantity)."""
    return by_period(work, grouping).groupBy("period", "agent", "activity").agg(F.sum(F.col("quantity") * F.col("share")).alias("quantity"), F.sum("inside").alias("hours"))


def stockpiles(deliveries: DataFrame, piles: DataFrame, periods: int, grouping: str, grades: Sequence[str] = ()) -> DataFrame:
    """(pile, period, opening, received, reclaimed, closing, closing grades) of piles(pile, opening, and a column of contained quantity for each grade).

    Receipts have the pile as destination, reclaims as source. Balances are running sums over a pile's periods, of
    which there are as many as the report has rows for it.
    """
    spread = by_period(deliveries, grouping)
    measures = ("tonnes", *grades)
    side = lambda c, name: spread.select(F.col(c).alias("pile"), "period", *[(F.col(m) * F.col("share")).alias(m) for m in measures]).groupBy("pile", "period").agg(*[F.sum(m).alias(f"{name}_{m}") for m in measures])
    own = piles.select("pile", F.col("opening").alias("__opening"), *[F.col(g).alias(f"__start_{g}") for g in grades])
    spine = own.withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(periods - 1).cast("long"))))
    j = spine.join(side("destination", "in"), ["pile", "period"], "left").join(side("source", "out"), ["pile", "period"], "left").fillna(0.0, [f"{s}_{m}" for s in ("in", "out") for m in measures])
    run = Window.partitionBy("pile").orderBy("period")
    net = lambda m: F.sum(F.col(f"in_{m}") - F.col(f"out_{m}")).over(run)
    closing = F.col("__opening") + net("tonnes")
    out = j.withColumns({"closing": closing} | {g: F.col(f"__start_{g}") + net(g) for g in grades})
    opening = F.col("closing") - F.col("in_tonnes") + F.col("out_tonnes")
    return out.select("pile", "period", opening.alias("opening"), F.col("in_tonnes").alias("received"), F.col("out_tonnes").alias("reclaimed"), "closing", *[_grade(F.col(g), F.col("closing")).alias(g) for g in grades])


def crushers(deliveries: DataFrame, limits: DataFrame, penalties: DataFrame, periods: int, grouping: str, grades: Sequence[str] = ()) -> DataFrame:
    """(crusher, period, received, limit, grades, penalty) of limits(crusher, day, limit) and penalties(crusher, day, penalty).

    A limit that any day of a period lacks or leaves null is none for the period. Every crusher of limits has every period.
    """
    days = {"day": 1, "week": 7}.get(grouping)
    of = (lambda c: F.floor(c / days).cast("long")) if days else (lambda c: F.lit(0).cast("long"))
    spread = by_period(deliveries, grouping).withColumnRenamed("destination", "crusher")
    got = spread.groupBy("crusher", "period").agg(*[F.sum(F.col(m) * F.col("share")).alias(m) for m in ("tonnes", *grades)])
    spine = limits.select("crusher").distinct().withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(periods - 1).cast("long"))))
    budget = limits.groupBy("crusher", of(F.col("day")).alias("period")).agg(F.when(F.count("limit") == (F.count(F.lit(1)) if not days else F.greatest(F.count(F.lit(1)), F.lit(days))), F.sum("limit")).alias("limit"))
    cost = penalties.groupBy("crusher", of(F.col("day")).alias("period")).agg(F.sum("penalty").alias("penalty"))
    j = spine.join(got, ["crusher", "period"], "left").join(budget, ["crusher", "period"], "left").join(cost, ["crusher", "period"], "left")
    tonnes = F.coalesce("tonnes", F.lit(0.0))
    return j.select("crusher", "period", tonnes.alias("received"), "limit", *[_grade(F.col(g), tonnes).alias(g) for g in grades], F.coalesce("penalty", F.lit(0.0)).alias("penalty"))


def dumps(deliveries: DataFrame, names: DataFrame, periods: int, grouping: str) -> DataFrame:
    """(dump, period, received, to_date) of names(dump); every dump has every period."""
    got = by_period(deliveries, grouping).groupBy(F.col("destination").alias("dump"), "period").agg(F.sum(F.col("tonnes") * F.col("share")).alias("received"))
    spine = names.select("dump").withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(periods - 1).cast("long"))))
    j = spine.join(got, ["dump", "period"], "left").fillna(0.0, ["received"])
    return j.withColumn("to_date", F.sum("received").over(Window.partitionBy("dump").orderBy("period")))


def trucks(deliveries: DataFrame, fleet: DataFrame, horizon: float, grouping: str) -> DataFrame:
    """(truck, period, used, available, and haul measures) of fleet(truck, day, units): units after availability and use.

    available: units by the hours of each day that the horizon reaches. Every truck class of the fleet has every period
    in which it has a day.
    """
    days = {"day": 1, "week": 7}.get(grouping)
    of = F.floor(F.col("day") / days).cast("long") if days else F.lit(0).cast("long")
    open_h = F.greatest(F.lit(0.0), F.least(F.lit(float(horizon)), (F.col("day") + 1) * 24.0) - F.col("day") * 24.0)
    able = fleet.groupBy("truck", of.alias("period")).agg(F.sum(F.col("units") * open_h).alias("available"))
    used = _hauled(by_period(deliveries, grouping), ["truck", "period"], [F.sum(F.col("truck_hours") * F.col("share")).alias("used")])
    out = able.join(used, ["truck", "period"], "left").fillna(0.0, ["used", *MEASURES])
    return out.select("truck", "period", "used", "available", "cycle_min", "km", "rise", "tonne_km")
