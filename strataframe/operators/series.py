"""Depth and time series: runs, regular sampling, envelopes, percentiles, sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def code_runs(df: DataFrame, keys: list[str], order: list[str], code: str, codes: list[str]) -> DataFrame:
    """(keys, run, roof, floor, runs): maximal runs of matching codes; a null code doesn't break a run, another one does."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = df.where(F.col(code).isNotNull())
    match = F.col(code).isin(*codes)
    marked = known.withColumn("__m", match).withColumn("__new", F.when(F.col("__m") & ~F.coalesce(F.lag("__m").over(w), F.lit(False)), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("__new").over(w)).where("__m").groupBy(*keys, "run").agg(F.min("from").alias("roof"), F.max("to").alias("floor"))
    return runs.withColumn("runs", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def ranked(df: DataFrame, order: list[str], ranges: int = 64) -> DataFrame:
    """Adds `place`, the 1-based row number along `order`: numbered within ranges of its first column, plus what earlier ranges hold.

    The ranges are cut at the values of a few rows; the cuts decide how even the ranges are, never a place.
    """
    first = F.col(order[0])
    cuts = sorted({r[0] for r in df.where(first.isNotNull()).orderBy(F.xxhash64(*order), *order).limit(ranges - 1).select(first).collect()})
    held = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    # nulls come first
    at = F.coalesce(F.size(F.filter(held, lambda c: c <= first)), F.lit(0)) if cuts else F.lit(0)
    # dealt anew, so that a computed column isn't computed again for each cut
    dealt = df.repartition(*order).withColumn("__r", F.when(first.isNull(), -1).otherwise(at))
    sizes = dealt.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = dealt.join(F.broadcast(sizes.select("__r", before.alias("__before"))), "__r")
    return j.withColumn("place", F.row_number().over(Window.partitionBy("__r").orderBy(*order)) + F.col("__before")).drop("__r", "__before")


def settle(df: DataFrame, keys: list[str], depth: str, value: str, order: str) -> DataFrame:
    """One reading at each depth: the one that was read first."""
    return df.groupBy(*keys, depth).agg(F.min_by(value, order).alias(value))


def drop_isolated(df: DataFrame, keys: list[str], at: str, gap: float, least: int) -> DataFrame:
    """Without groups (parted by more than gap) of fewer than `least` readings, unless no group is that large."""
    w = Window.partitionBy(*keys).orderBy(at)
    grouped = df.withColumn("__g", F.sum(F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)).over(w))
    sized = grouped.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "__g")))
    most = sized.withColumn("__most", F.max("__n").over(Window.partitionBy(*keys)))
    return most.where((F.col("__n") >= least) | (F.col("__most") < least)).drop("__g", "__n", "__most")


def rank_percentile(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 64) -> DataFrame:
    """Values at 0-based rank round((n - 1) * p) in order; not the ceil(n * p) of percentile_disc. Missing values have no rank.

    Bins are cut at approximate quantiles of each key, so that they are about even however the values lie; a value
    that is a cut has a bin of its own, so that one which very many rows have needs no order. Exact counts by bin tell in
    which bin each rank lies; only the rows of those bins are put in order, so a key with most rows is no single task.
    """
    v = F.col(value)
    known = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*keys, value)
    at = F.array(*[F.lit(i / max(2, bins)) for i in range(1, max(2, bins))])
    stats = known.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, at, 1000)).alias("__cuts"), F.count(F.lit(1)).alias("__n"))
    place = F.size(F.filter("__cuts", lambda c: c < v)) * 2 + F.array_contains("__cuts", v).cast("int")
    binned = known.join(stats, keys).withColumn("__bin", place)
    counts = binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"), F.min(value).alias("__least"), F.max(value).alias("__most"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in shares.items()]))
    wanted = counts.withColumn("__before", before).withColumn("__s", ranks).withColumn("__r", F.floor((F.col("__n") - 1) * F.col("__s.p") + 0.5))
    wanted = wanted.where((F.col("__before") <= F.col("__r")) & (F.col("__r") < F.col("__before") + F.col("__c")))
    wanted = wanted.select(*keys, "__bin", F.col("__s.name").alias("__name"), (F.col("__r") - F.col("__before") + 1).alias("__nth"), "__least", "__most")
    plain = wanted.where(F.col("__least") == F.col("__most")).select(*keys, "__name", F.col("__least").alias(value))
    inside = binned.select(*keys, "__bin", value).join(wanted.where(F.col("__least") != F.col("__most")), [*keys, "__bin"])
    nth = F.row_number().over(Window.partitionBy(*keys, "__bin", "__name").orderBy(value))
    found = inside.withColumn("__k", nth).where(F.col("__k") == F.col("__nth")).select(*keys, "__name", value).unionByName(plain)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col(value))).alias(name) for name in shares])


def median_step(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumn("__d", F.col(at) - F.lag(at).over(w)).where("__d > 0").groupBy(*keys).agg(F.percentile("__d", 0.5).alias("step"))


def regularise(df: DataFrame, keys: list[str], at: str, value: str, step: float) -> DataFrame:
    """(keys, slot, value): the nearest reading within half a step of each regular position; null ends trimmed.

    Each reading belongs to the one slot it is nearest to, so no range join is needed.
    """
    first = df.groupBy(*keys).agg(F.min(at).alias("__0"))
    placed = df.join(first, keys).withColumn("slot", F.floor((F.col(at) - F.col("__0")) / step + 0.5).cast("long")).withColumn("__off", F.abs(F.col(at) - F.col("__0") - F.col("slot") * step))
    best = placed.groupBy(*keys, "slot").agg(F.min_by(value, F.struct("__off", at)).alias(value))
    ends = best.groupBy(*keys).agg(F.min("slot").alias("__a"), F.max("slot").alias("__b"))
    spine = ends.withColumn("slot", F.explode(F.sequence("__a", "__b"))).select(*keys, "slot")
    return spine.join(best, [*keys, "slot"], "left")


def envelope(df: DataFrame, keys: list[str], at: str, value: str, lo: float, hi: float, buckets: int) -> DataFrame:
    """(keys, bucket, lo, hi): extremes in exactly `buckets` half-open buckets of [lo, hi); an empty one takes the nearest reading's."""
    width = (hi - lo) / buckets
    inside = df.where((F.col(at) >= lo) & (F.col(at) < hi)).withColumn("bucket", F.least(F.floor((F.col(at) - lo) / width), F.lit(buckets - 1)).cast("long"))
    stats = inside.groupBy(*keys, "bucket").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.min(F.struct(at, value)).alias("__first"), F.max(F.struct(at, value)).alias("__last"))
    spine = stats.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    full = spine.join(stats, [*keys, "bucket"], "left")
    w = Window.partitionBy(*keys).orderBy("bucket")
    before = F.last("__last", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("__first", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    full = full.withColumn("__b", before).withColumn("__a", after)
    middle = F.lit(lo) + (F.col("bucket") + 0.5) * width
    near = F.when(F.col("__a").isNull() | (middle - F.col(f"__b.{at}") <= F.col(f"__a.{at}") - middle), F.col(f"__b.{value}")).otherwise(F.col(f"__a.{value}"))
    return full.select(*keys, "bucket", F.coalesce("lo", near).alias("lo"), F.coalesce("hi", near).alias("hi"))


def pyramid(df: DataFrame, keys: list[str], slot: str, value: str, levels: int) -> DataFrame:
    """(keys, level, cell, lo, hi): extremes over 2**level neighbouring slots, in one pass."""
    grid = df.where(F.col(value).isNotNull()).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    cell = F.floor(F.col(slot) / F.pow(F.lit(2.0), "level")).cast("long")
    return grid.withColumn("cell", cell).groupBy(*keys, "level", "cell").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def window_sums(df: DataFrame, keys: list[str], at: str, amount: Column, length: int) -> DataFrame:
    """n and total of [t, t + length) from each row's integer time on."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(0, length - 1)
    return df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("total", F.sum(amount).over(w))


def adjacent_overlaps(df: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Spans that the next one of their key begins before the end of."""
    w = Window.partitionBy(*keys).orderBy("from", "to")
    return df.withColumn("next_from", F.lead("from").over(w)).where(F.col("next_from") < F.col("to") - tolerance)


def interpolate(facts: DataFrame, stations: DataFrame, keys: list[str], at: str, station: str, values: list[str]) -> DataFrame:
    """Linear between the stations around each fact, held at both ends: a union filled from both sides."""
    mark = F.struct(F.col(station).alias("t"), *values)
    both = facts.withColumn("__t", F.col(at)).withColumn("__kind", F.lit(1)).unionByName(stations.select(*keys, F.col(station).alias("__t"), F.lit(0).alias("__kind"), mark.alias("__s")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__kind")
    both = both.withColumn("__p", F.last("__s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__q", F.first("__s", True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("__kind = 1")
    p, q = F.col("__p"), F.col("__q")
    t = F.when(q["t"] > p["t"], (F.col(at) - p["t"]) / (q["t"] - p["t"])).otherwise(F.lit(0.0))
    out = [F.when(p.isNull(), q[v]).when(q.isNull(), p[v]).otherwise(p[v] + (q[v] - p[v]) * t).alias(v) for v in values]
    return both.select(*facts.columns, *out)


def midpoints(logs: DataFrame, trace: DataFrame, keys: list[str], value: str, station: str, position: list[str]) -> DataFrame:
    """Samples at the middle of the usable intervals logs(keys, from, to, value), placed on trace(keys, station, position).

    Usable: a finite value and finite ends, the second beyond the first. Intervals of a key without a trace go.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    ok = logs.where(finite(value) & finite("from") & finite("to") & (F.col("to") > F.col("from")))
    placed = interpolate(ok.withColumn("__mid", (F.col("from") + F.col("to")) * 0.5), trace, keys, "__mid", station, position)
    return placed.where(F.col(position[0]).isNotNull()).drop("__mid")


def trace_pieces(spans: DataFrame, trace: DataFrame, cuts: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, from, to, x0, y0, z0, x1, y1, z1): the straight pieces of a hole's trace within spans(key, from, to).

    trace(key, depth, x, y, z) are stations; a span is clamped to them, and cut at every station and at every depth of
    cuts(key, depth) inside it. Depths within tolerance of the last kept one are it; a piece without length is left out.
    """
    from .intervals import build_intervals

    ends = trace.groupBy(F.col(key).alias("__k")).agg(F.min("depth").alias("__top"), F.max("depth").alias("__bottom"))
    s = spans.join(ends, F.col(key) == F.col("__k")).select(key, F.greatest("from", "__top").alias("from"), F.least("to", "__bottom").alias("to")).where("to > from")
    s = s.withColumn("__span", F.struct(F.col(key), F.col("from"), F.col("to"))).distinct()
    # the cuts inside each span, by the key
    marks = trace.select(F.col(key).alias("__k"), "depth").unionByName(cuts.select(F.col(key).alias("__k"), "depth")).distinct()
    inside = s.join(marks, F.col(key) == F.col("__k")).where("depth > from AND depth < to").select("__span", "depth")
    points = inside.unionByName(s.select("__span", F.col("from").alias("depth"))).unionByName(s.select("__span", F.col("to").alias("depth")))
    pieces = build_intervals(points, "depth", tolerance, ["__span"]).select(F.col(f"__span.{key}").alias(key), F.col("start").alias("from"), F.col("end").alias("to"))
    first = interpolate(pieces, trace, [key], "from", "depth", ["x", "y", "z"]).withColumnsRenamed({c: f"{c}0" for c in "xyz"})
    both = interpolate(first, trace, [key], "to", "depth", ["x", "y", "z"]).withColumnsRenamed({c: f"{c}1" for c in "xyz"})
    size = sum(((F.col(f"{c}1") - F.col(f"{c}0")) * (F.col(f"{c}1") - F.col(f"{c}0")) for c in "xyz"), F.lit(0.0))
    return both.where(size > 1e-18)
