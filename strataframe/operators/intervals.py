"""Half-open intervals, step functions and calendars, without nested-loop joins."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap_join(left: DataFrame, right: DataFrame, width: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of left [start, end) and right [r_start, r_end) that overlap, with `overlap`, their common length.

    Both sides are dealt into buckets of `width` and meet by bucket (an equi-join); a pair is kept only in
    the first bucket that both reach, so it comes once.
    """
    keys = keys or []

    def dealt(df: DataFrame, start: str, end: str) -> DataFrame:
        first = F.floor(F.col(start) / width).cast("long")
        last = F.greatest(first, F.ceil(F.col(end) / width).cast("long") - 1)
        return df.withColumn("__first", first).withColumn("__b", F.explode(F.sequence(first, last)))

    a = dealt(left.where("start < end"), "start", "end").withColumnRenamed("__first", "__fa")
    b = dealt(right.where("r_start < r_end"), "r_start", "r_end").withColumnRenamed("__first", "__fb")
    j = a.join(b, [*keys, "__b"]).where((F.col("__b") == F.greatest("__fa", "__fb")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    return j.withColumn("overlap", F.least("end", "r_end") - F.greatest("start", "r_start")).drop("__fa", "__fb", "__b")


def apportion(df: DataFrame, amount: str, period: float = 24.0) -> DataFrame:
    """Split `amount` over the periods that [start, end) covers, by duration; the last takes the remainder.

    Adds `period` and `share`. A span without length falls wholly into the period that holds its start.
    """
    first = F.floor(F.col("start") / period).cast("long")
    last = F.greatest(first, F.ceil(F.col("end") / period).cast("long") - 1)
    length = F.col("end") - F.col("start")
    each = F.least(F.col("end"), (F.col("period") + 1) * period) - F.greatest(F.col("start"), F.col("period") * period)
    part = F.when(length > 0, F.col(amount) * each / length).otherwise(F.col(amount))
    # what earlier periods took has a closed form: everything up to the last period's start
    before = F.when(length > 0, F.col(amount) * (F.col("__last") * period - F.col("start")) / length).otherwise(F.lit(0.0))
    out = df.withColumn("__first", first).withColumn("__last", last).withColumn("period", F.explode(F.sequence("__first", "__last")))
    share = F.when(F.col("period") < F.col("__last"), part).when(F.col("__first") == F.col("__last"), F.col(amount)).otherwise(F.col(amount) - before)
    return out.withColumn("share", share).drop("__first", "__last")


def _merged(df: DataFrame, keys: list[str], rows: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    grouped = marked.withColumn("__run", F.sum("__new").over(w))
    return grouped.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), rows.alias("n")).drop("__run")


def coalesce_spans(df: DataFrame, keys: list[str], width: float = 1024.0) -> DataFrame:
    """(keys, start, end, n): overlapping and touching spans become one.

    Spans that start within one stretch of `width` are merged first, so that a busy key is many tasks; only
    what is left of them, a few spans a stretch where they are dense, is put in order together.
    """
    part = df.where("start < end").withColumn("__b", F.floor(F.col("start") / width))
    return _merged(_merged(part, [*keys, "__b"], F.count(F.lit(1))).drop("__b"), keys, F.sum("n"))


def gaps(df: DataFrame, keys: list[str], least: float = 1e-6) -> DataFrame:
    """(keys, start, end): time between the first start and the last end that nothing covers, gaps up to `least` left out."""
    w = Window.partitionBy(*keys).orderBy("start")
    reach = F.lag("end").over(w)
    return coalesce_spans(df, keys).withColumn("__reach", reach).where(F.col("start") - F.col("__reach") > least).select(*keys, F.col("__reach").alias("start"), F.col("start").alias("end"))


def covered(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hours): length of the union of the spans."""
    return coalesce_spans(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("hours"))


def asof(facts: DataFrame, steps: DataFrame, keys: list[str], at: str, since: str, values: list[str], initial: dict | None = None) -> DataFrame:
    """Each fact with the step's values at its time: the last step at or before it (inclusive), else `initial`.

    A union ordered by time and filled forward: one shuffle by key, no range join.
    """
    # a marker holds the step's values, nulls included; of steps at one time the greatest values win
    mark = F.struct(*[F.col(v) for v in values])
    one = steps.select(*keys, F.col(since).alias("__t"), F.lit(0).alias("__kind"), mark.alias("__step"))
    one = one.groupBy(*keys, "__t", "__kind").agg(F.max("__step").alias("__step"))
    two = facts.withColumn("__t", F.col(at)).withColumn("__kind", F.lit(1))
    w = Window.partitionBy(*keys).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = two.unionByName(one, allowMissingColumns=True).withColumn("__now", F.last("__step", ignorenulls=True).over(w)).where("__kind = 1")
    cols = [F.when(F.col("__now").isNotNull(), F.col(f"__now.{v}")).otherwise(F.lit((initial or {}).get(v))).alias(v) for v in values]
    return both.select(*facts.columns, *cols)


def balance(events: DataFrame, keys: list[str], at: str, change: str) -> DataFrame:
    """Knots of a running balance: changes at one time are one knot; never below 0 in what is shown."""
    sums = events.groupBy(*keys, at).agg(F.sum(change).alias("change"))
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("running", F.sum("change").over(w)).withColumn("balance", F.greatest("running", F.lit(0.0)))


def balance_at(facts: DataFrame, knots: DataFrame, keys: list[str], at: str) -> DataFrame:
    """facts with `balance` at their time, from knots(keys, at, balance, rate): that of the last knot at or before it and its rate since; 0 before the first, never below 0.

    A fact within 1e-9 of a knot has that knot's balance.
    """
    k = knots.select(*keys, (F.col("at") - 1e-9).alias("__since"), F.col("at").alias("__at"), "balance", "rate")
    found = asof(facts, k, keys, at, "__since", ["__at", "balance", "rate"])
    since = F.greatest(F.col(at) - F.col("__at"), F.lit(0.0))
    return found.withColumn("balance", F.greatest(F.coalesce(F.col("balance") + F.col("rate") * since, F.lit(0.0)), F.lit(0.0))).select(*facts.columns, "balance")


def labelled(spans: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, label): spans(keys, start, end) cut where edges(keys, since, label) change, and neighbours of one label that touch put together again.

    Before a key's first edge the label is null. A span is cut at the edges inside it by a merge along time: spans'
    starts and edges are one order, so no span is compared with an edge outside it.
    """
    cut = split_at(spans, edges.select(*keys, F.col("since").alias("at")), keys)
    named = asof(cut.select(*keys, "start", "end"), edges, keys, "start", "since", ["label"])
    w = Window.partitionBy(*keys).orderBy("start", "end")
    new = F.when(F.lag("end").over(w).eqNullSafe(F.col("start")) & F.lag("label").over(w).eqNullSafe(F.col("label")), 0).otherwise(1)
    runs = named.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label")).drop("__run")


def rate_knots(spans: DataFrame, keys: list[str], rate: Column) -> DataFrame:
    """(keys, at, rate): the sum of the rates of the spans that cover each moment, where it changes."""
    events = spans.where("start < end").select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), rate.alias("d")), F.struct(F.col("end").alias("at"), (-rate).alias("d")))).alias("e")).select(*keys, "e.at", "e.d")
    sums = events.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("rate", F.round(F.sum("d").over(w), 9)).drop("d")


def _sweep(spans: list[tuple]) -> list[tuple]:
    """(start, end, winner) of (start, end, rank, winner): the least rank of those that cover each stretch, by a heap along the starts."""
    spans = sorted(spans, key=lambda x: x[0])
    cuts = sorted({t for s in spans for t in s[:2]})
    heap, out, k = [], [], 0
    for at, to in zip(cuts, cuts[1:]):
        while k < len(spans) and spans[k][0] <= at:
            heapq.heappush(heap, (spans[k][2], k))
            k += 1
        while heap and spans[heap[0][1]][1] <= at:
            heapq.heappop(heap)
        if heap:
            winner = spans[heap[0][1]][3]
            if out and out[-1][1] == at and out[-1][2] == winner:
                out[-1] = (out[-1][0], to, winner)
            else:
                out.append((at, to, winner))
    return out


def elementary_winner(df: DataFrame, keys: list[str], order: str, width: float = 1024.0) -> DataFrame:
    """(keys, start, end, winner): between neighbouring bounds the shortest covering span wins, ties by `order`; equal neighbours merge.

    Spans are dealt into buckets of `width` and cut there; each bucket of a key is one ordered sweep, whose
    cost is n log n however many spans overlap. What meets at a bucket's edge merges afterwards.
    """
    first = F.floor(F.col("start") / width).cast("long")
    last = F.greatest(first, F.ceil(F.col("end") / width).cast("long") - 1)
    spans = df.where("start < end").dropna(subset=keys).select(*keys, F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"), F.col(order).alias("winner"), F.explode(F.sequence(first, last)).alias("__b"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.select(*keys).schema) + f", `at` double, `to` double, winner {spans.schema['winner'].dataType.simpleString()}"
    types = {f.name: f.dataType for f in spans.schema}

    def run(key, t):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        lo = key[-1].as_py() * width
        rows = zip(*(t.column(c).to_pylist() for c in ("s", "e", "winner")))
        # a null order comes first, as in Spark
        found = _sweep([(max(s, lo), min(e, lo + width), (e - s, o is not None, o), o) for s, e, o in rows])
        at, to, winner = zip(*found) if found else ((), (), ())
        named = [pa.array([k.as_py()] * len(at), to_arrow_type(types[n])) for k, n in zip(key, keys)]
        return pa.table([*named, pa.array(at, pa.float64()), pa.array(to, pa.float64()), pa.array(winner, to_arrow_type(types["winner"]))], [*keys, "at", "to", "winner"])

    best = spans.groupBy(*keys, "__b").applyInArrow(run, schema)
    w = Window.partitionBy(*keys).orderBy("at")
    new = F.when((F.lag("winner").over(w) == F.col("winner")) & (F.lag("to").over(w) == F.col("at")), 0).otherwise(1)
    return best.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w)).groupBy(*keys, "__run").agg(F.min("at").alias("start"), F.max("to").alias("end"), F.first("winner").alias("winner")).drop("__run")


def split_at(df: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Each span cut at the distinct points of cuts(keys, at) inside it: one row a piece."""
    points = cuts.groupBy(*keys).agg(F.collect_set("at").alias("__cuts"))
    j = df.join(points, keys, "left")
    inner = F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda x: (x > F.col("start")) & (x < F.col("end")))
    edges = F.array_sort(F.array_union(F.array(F.col("start").cast("double"), F.col("end").cast("double")), inner))
    j = j.withColumn("__edges", edges).withColumn("__i", F.explode(F.sequence(F.lit(1), F.size("__edges") - 1)))
    return j.withColumn("start", F.element_at("__edges", F.col("__i"))).withColumn("end", F.element_at("__edges", F.col("__i") + 1)).drop("__cuts", "__edges", "__i")


def build_intervals(points: DataFrame, at: str = "at", tolerance: float = 1e-9, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end) between neighbouring points of a key; a point within tolerance of the last one kept is passed over.

    A point further than that from the one before it is kept for sure, so only points in a chain of close ones
    are gone through one after another, a chain at a time.
    """
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(at)
    apart = F.when(F.col(at) - F.lag(at).over(w) <= tolerance, 0).otherwise(1)
    chains = points.where(F.col(at).isNotNull()).select(*keys, at).distinct().withColumn("__apart", apart).withColumn("__chain", F.sum("__apart").over(w))
    chains = chains.groupBy(*keys, "__chain").agg(F.array_sort(F.collect_list(at)).alias("__points"))
    keep = lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).when(x - F.element_at(kept, -1) > tolerance, F.array_append(kept, x)).otherwise(kept)
    one = F.col("__points")
    kept = F.when(F.size(one) == 1, one).otherwise(F.aggregate(one, F.slice(one, 1, 0), keep))
    kept = chains.select(*keys, F.explode(kept).alias(at))
    return kept.select(*keys, F.col(at).alias("start"), F.lead(at).over(w).alias("end")).where("end IS NOT NULL")


def occurrences(rules: DataFrame, horizon: float) -> DataFrame:
    """Recurring spans (start, length, every, until) up to the horizon, clipped; every null or 0 is once."""
    last = F.least(F.coalesce("until", F.lit(horizon)), F.lit(horizon))
    n = F.when(F.coalesce("every", F.lit(0.0)) > 0, F.greatest(F.lit(0), F.ceil((last - F.col("start")) / F.col("every")) - 1)).otherwise(F.lit(0)).cast("int")
    out = rules.where(F.col("start") < last).withColumn("__last", last).withColumn("k", F.explode(F.sequence(F.lit(0), n)))
    begin = F.col("start") + F.col("k") * F.coalesce("every", F.lit(0.0))
    return out.withColumn("__s", begin).withColumn("end", F.least(F.col("__s") + F.col("length"), F.lit(horizon))).withColumn("start", F.col("__s")).drop("__s", "__last", "k")


def effective(spine: DataFrame, defaults: DataFrame, overrides: DataFrame, owner: str, period: str, columns: list[str]) -> DataFrame:
    """Sparse per-period overrides over an owner's defaults; no override is not 0."""
    base = spine.join(defaults, owner)
    over = overrides.select(owner, period, *[F.col(c).alias(f"__{c}") for c in columns])
    j = base.join(over, [owner, period], "left")
    return j.select(owner, period, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def change_points(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The rows at which a value differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(at)
    was = F.lag(F.struct(value)).over(w)
    return df.withColumn("__was", was).where(F.col("__was").isNull() | ~F.col("__was").eqNullSafe(F.struct(value))).drop("__was")
