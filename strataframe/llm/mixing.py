"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, staged, unit_hash, unused, word_count


def allocate(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add `target` to (source, source_size): weights in order of source, null last, repeating.

    The targets share `share` times all sizes by weight, none above `most` times its source's size, the
    excess going to the others by weight until none is above: target = min(cap, weight * level). The level
    is found in one pass over the sources in order of cap / weight, as the first (and so the highest) at
    which those not yet capped can take all that is left. One row per source, so the windows are small.
    """
    nth = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(nth) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    by_ratio = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    capped_before = F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("__w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("__left", F.sum("source_size").over(all_rows) * F.lit(float(share)) - capped_before).withColumn("__level", F.col("__left") / open_weight)
    s = s.withColumn("__lambda", F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(all_rows))
    return s.select("source", "source_size", F.least("__cap", F.col("__w") * F.coalesce("__lambda", F.lit(float("inf")))).alias("target"))


def size_class(size: Column) -> Column:
    """Bit length of a size less one; -1 for 0."""
    return F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(-1)


def expected_copies(classes: DataFrame, most: float) -> DataFrame:
    """Add to (source, class, words, target): certain whole copies, inclusion probability of one more, words left for it.

    A document's expected copies grow with the fourth root of its size class, up to `most`, at the level that
    gives the source's words their target: min(most, weight * level). Found as in allocate, over the at most
    64 classes of a source.
    """
    s = classes.withColumn("__g", F.sqrt(F.sqrt(F.pow(F.lit(2.0), F.col("class")))))
    order = Window.partitionBy("source").orderBy(F.col("class").desc())
    whole = Window.partitionBy("source")
    full_before = F.coalesce(F.sum(F.col("words") * F.lit(float(most))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum(F.col("__g") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("__level", (F.col("target") - full_before) / open_weight)
    s = s.withColumn("__lambda", F.max(F.when(F.col("__level") <= F.lit(float(most)) / F.col("__g"), F.col("__level"))).over(whole))
    s = s.withColumn("__e", F.least(F.lit(float(most)), F.col("__g") * F.coalesce("__lambda", F.lit(float("inf")))))
    s = s.withColumn("certain", F.floor(F.col("__e") + F.lit(1e-12)).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("__e") - F.col("certain")))
    return s.withColumn("rest", F.col("target") - F.sum(F.col("certain") * F.col("words")).over(whole)).drop("__g", "__level", "__lambda", "__e")


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds; null where nothing is to be drawn."""
    return F.when(p > 0, u / (1 - u) / (p / (1 - p)))


def mixture_plan(base: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """What decides each document's copies, a row for each source and size class of base(doc_id, source, size, u).

    Within a source the lowest ranks are taken whose words come nearest to what the certain copies leave of
    its target. Where that ends is found in two steps: words by bucket of rank, sqrt(rows) buckets a source,
    then the order within the one bucket in which it lies. So no task holds a source.
    """
    classes = base.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    classes = staged(classes, "mix-classes")
    targets = allocate(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    targets = targets.withColumnRenamed("source", "__source")
    classes = classes.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    drawn = expected_copies(classes.where("class >= 0"), most)
    none = classes.where("class < 0").withColumn("certain", F.lit(0).cast("long")).withColumn("p", F.lit(0.0)).withColumn("rest", F.lit(0.0))
    whole = Window.partitionBy("source")
    some = F.col("p") > 0
    plan = drawn.unionByName(none).withColumn("buckets", F.ceil(F.sqrt(F.sum("rows").over(whole))).cast("long"))
    # the mean odds make the bucket of a rank about uniform
    mean = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.sum(F.when(some, F.col("p") * F.col("rows"))).over(whole) / F.sum(F.when(some, F.col("rows"))).over(whole)))
    plan = staged(plan.withColumn("odds", mean / (1 - mean)), "mix-plan")
    ranked = ranked_by(base, plan).where("rank IS NOT NULL")
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).where("start <= rest")
    last = staged(starts.groupBy("source").agg(F.max(F.struct("bucket", "start")).alias("l")).select(F.col("source").alias("__source"), F.col("l.bucket").alias("last"), "l.start"), "mix-buckets")
    inside = ranked.join(small(last), F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("last")))
    # rows that tie in place are one row here, however many they are
    inside = inside.groupBy("source", "start", "rest", "place").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    earlier = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("before", F.col("start") + earlier)
    # what crosses the rest is taken if that ends nearer to it; of a tie as many rows as do so
    nth = F.floor((F.col("rest") - F.col("before")) / F.col("place.size") + 0.5)
    nth = F.when(F.col("before") + F.col("place.size") * (nth - 0.5) <= F.col("rest"), nth).otherwise(nth - 1)
    inside = inside.withColumn("take", F.greatest(F.lit(0), F.least(F.col("rows"), nth)).cast("long")).where("take > 0")
    cuts = inside.groupBy(F.col("source").alias("__cut_source")).agg(
        F.max(F.when(F.col("take") == F.col("rows"), F.col("place"))).alias("cut"),
        F.max(F.when(F.col("take") < F.col("rows"), F.struct("place", "take"))).alias("part"),
    )
    cuts = staged(cuts.select("__cut_source", "cut", F.col("part.place").alias("tied"), F.col("part.take").alias("take")), "mix-ties")
    rows = _tied_rows(ranked, cuts)
    plan = plan.join(last.drop("start"), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    plan = plan.join(cuts.drop("take"), F.col("source").eqNullSafe(F.col("__cut_source")), "left").drop("__cut_source")
    plan = plan.join(rows, F.col("source").eqNullSafe(F.col("__tied_source")), "left").drop("__tied_source")
    return staged(plan, "mix-cuts")


def _tied_rows(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """(__tied_source, tied_row): up to which row_id the rows that tie at a source's cut are taken, where that is a part of them.

    They may be a third of all rows: they are counted by the partition that numbered them, and only the rows of the
    partition in which the count is reached are put in order.
    """
    ties = cuts.where("tied IS NOT NULL").select(F.col("__cut_source").alias("__source"), F.col("tied").alias("__tied"), "take")
    if ties.isEmpty():
        return ties.select(F.col("__source").alias("__tied_source"), F.lit(None).cast("long").alias("tied_row")).limit(0)
    rows = ranked.join(small(ties), F.col("source").eqNullSafe(F.col("__source")) & (F.col("place") == F.col("__tied")))
    rows = rows.select("source", "row_id", "take", F.shiftright("row_id", 33).alias("from"))
    counts = rows.groupBy("source", "take", "from").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("need", F.col("take") - before).where("need > 0 AND need <= rows")
    counts = counts.select(F.col("source").alias("__tied_source"), F.col("from").alias("__from"), "need")
    inside = rows.join(small(counts), F.col("source").eqNullSafe(F.col("__tied_source")) & (F.col("from") == F.col("__from")))
    inside = inside.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("row_id"))).where("nth <= need")
    return inside.groupBy("__tied_source").agg(F.max("row_id").alias("tied_row"))


def ranked_by(base: DataFrame, plan: DataFrame) -> DataFrame:
    """base(..., source, size, u) with its row of the plan, and rank, bucket and place (the order of ranks, ties by id and size)."""
    own = plan.withColumnRenamed("source", "__source").withColumnRenamed("class", "__class").drop("words", "rows")
    out = base.join(small(own), F.col("source").eqNullSafe(F.col("__source")) & (size_class(F.col("size")) == F.col("__class"))).drop("__source", "__class")
    out = out.withColumn("rank", pareto_rank(F.col("u"), F.col("p")))
    key = F.col("rank") * F.col("odds")
    out = out.withColumn("bucket", F.least(F.floor(key / (1 + key) * F.col("buckets")), F.col("buckets") - 1))
    return out.withColumn("place", F.struct("rank", F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "size"))


def copies_by_plan() -> Column:
    """The copies of a row of ranked_by, once the plan has its cuts."""
    early = F.coalesce(F.col("place") <= F.col("cut"), F.lit(False)) | ((F.col("place") == F.col("tied")) & (F.col("row_id") <= F.col("tied_row")))
    more = (F.col("bucket") < F.col("last")) | ((F.col("bucket") == F.col("last")) & early)
    return (F.col("certain") + F.coalesce((F.col("rank").isNotNull() & more).cast("long"), F.lit(0))).cast("long")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """What the plan is made of, a row a document; row_id tells rows of one id and size apart."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), unit_hash(seed, F.col("doc_id")).alias("u"), F.monotonically_increasing_id().alias("row_id"))


def pareto_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """How many copies of each document a mixture of the sources takes.

    docs needs doc_id, text, source; other columns are ignored. Returns one row per input row: doc_id, size
    (words), source, source_size, target (words of its source), rank, copies, taken (copies * size).

    A document's expected copies differ by source and by size class (see expected_copies), `most` at most.
    It gets their whole part for certain. One more goes to a Pareto sample in which its inclusion probability
    p is the rest: documents are ranked by random odds u / (1 - u) divided by inclusion odds p / (1 - p), and
    a fixed number of the lowest ranks of each source is taken, the number that brings its words nearest the
    target. Every document has its own u, from its id, so reruns agree. A fractional `most` bounds expected
    copies; copies themselves are whole and may be the next larger number.

    A null text has size 0 and takes 0; an all-null source has target 0; null is a source of its own;
    ties in rank are ordered by id (null last) and size; of rows of one source, id and size as many are taken as
    bring the words nearest the target, those that stand first in the input (they are alike in all that returns); an
    empty table gives none.
    """
    base = staged(sized(docs, seed), "mix-sizes")
    out = ranked_by(base, mixture_plan(base, weights, share, most)).withColumn("copies", copies_by_plan())
    return out.select("doc_id", "size", "source", "source_size", "target", "rank", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with each row as often as the mixture takes it, with the columns of docs.

    Rows without words have no weight in any target and stay once each. Texts are never shuffled: a row's
    copies follow from its own id, source, size and place in the input and from the plan, which has a row for each
    source and size class. Columns of any names return unchanged; an empty table gives none.
    """
    plan = mixture_plan(staged(sized(docs, seed), "mix-sizes"), weights, share, most)
    row = unused("__row", docs)
    packed = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), unit_hash(seed, F.col("doc_id")).alias("u"), F.monotonically_increasing_id().alias("row_id"))
    copies = F.when(F.col("size") > 0, copies_by_plan()).otherwise(1).cast("int")
    out = ranked_by(packed, plan).withColumn("copies", copies).where("copies > 0")
    return out.select(row, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(f"{row}.*")
