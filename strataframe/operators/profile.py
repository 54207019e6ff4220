"""Profiles, data quality, dictionaries and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import usable
from .series import ranked


def attribute_profile(df: DataFrame, numeric: list[str], labels: list[str]) -> DataFrame:
    """(attribute, lo, hi, labels, used): extremes of usable numbers, number of distinct labels; one pass."""
    cells = [F.struct(F.lit(c).alias("attribute"), F.col(c).cast("double").alias("v"), F.lit(None).cast("string").alias("s")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("attribute"), F.lit(None).cast("double").alias("v"), F.nullif(F.trim(F.col(c)), F.lit("")).alias("s")) for c in labels]
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    ok = usable(F.col("v"))
    return long.groupBy("attribute").agg(F.min(F.when(ok, F.col("v"))).alias("lo"), F.max(F.when(ok, F.col("v"))).alias("hi"), F.countDistinct("s").alias("labels"), F.count_if(ok | F.col("s").isNotNull()).alias("used"))


def dictionary(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """(label, code): codes from 0 by first appearance in the given total order; labels are numbered by ranges of it, not in one task."""
    firsts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(F.struct(*order)).alias("__first"))
    names = [f"__o{i}" for i in range(len(order))]
    placed = ranked(firsts.select(label, *[F.col(f"__first.{c}").alias(n) for c, n in zip(order, names, strict=True)]), names)
    return placed.select(label, (F.col("place") - 1).cast("long").alias("code"))


def encode(df: DataFrame, codes: DataFrame, label: str) -> DataFrame:
    return df.join(codes, label, "left")


def duplicates(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Repeated keys with their first repeat; -0.0 is 0.0."""
    normal = df.withColumn(key, F.when(F.col(key) == 0, F.abs(F.col(key))).otherwise(F.col(key)))
    w = Window.partitionBy(key).orderBy(*order)
    return normal.withColumn("__n", F.row_number().over(w)).where("__n = 2").drop("__n")


def orphans(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return df.join(parents.select(key).distinct(), key, "left_anti")


def first_of_equal(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Each row with the least index of the rows that equal it on keys."""
    return df.withColumn("first", F.min(index).over(Window.partitionBy(*keys)))


def union_reconciled(frames: list[DataFrame], optional: dict[str, Column], common: list[str]) -> DataFrame:
    """Rows of all frames: an optional column is filled where it's missing if any has it; a common one stays only if all have it."""
    kept = [c for c in common if all(c in f.columns for f in frames)]
    some = [c for c in optional if any(c in f.columns for f in frames)]
    base = [c for c in frames[0].columns if c not in optional and c not in common]
    out = None
    for f in frames:
        one = f.select(*base, *[F.col(c) if c in f.columns else optional[c].alias(c) for c in some], *kept)
        out = one if out is None else out.unionByName(one)
    return out


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(problem, rows) for each rule that some row violates; one pass over the data."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(f"`{n}`").alias("rows")) for n in rules])).alias("x")
    return counts.select(pairs).select("x.*").where("rows > 0")


def regular_grid(df: DataFrame, at: list[str], size: list[str], tolerance: float = 1e-6, most: int = 1 << 29) -> DataFrame:
    """One row: whether all boxes have one size and lattice positions, and the number of cells each way."""
    first = df.agg(*[F.min(c).alias(f"__0{c}") for c in at], *[F.min(c).alias(f"__s{c}") for c in size], *[F.max(c).alias(f"__m{c}") for c in size])
    j = df.crossJoin(F.broadcast(first))
    step = [(F.col(c) - F.col(f"__0{c}")) / F.col(f"__s{s}") for c, s in zip(at, size, strict=True)]
    off = F.lit(True)
    for t in step:
        off = off & (F.abs(t - F.round(t)) <= tolerance)
    same = F.lit(True)
    for s in size:
        same = same & (F.col(f"__m{s}") - F.col(f"__s{s}") <= tolerance)
    dims = [(F.max(F.round(t)).cast("long") + 1).alias(f"n_{c}") for t, c in zip(step, at, strict=True)]
    out = j.agg(F.bool_and(off & same).alias("regular"), *dims)
    cells = F.lit(1).cast("double")
    for c in at:
        cells = cells * F.col(f"n_{c}")
    return out.withColumn("regular", F.col("regular") & (cells <= most))


def blend(df: DataFrame, keys: list[str], tonnes: str, averages: list[str], sums: list[str], labels: list[str]) -> DataFrame:
    """Tonnes-weighted averages, sums and unanimous labels; a field that any portion lacks is null."""
    n = F.count(F.lit(1))
    t = F.sum(tonnes)
    cols = [F.when(F.count(c) == n, F.sum(F.col(c) * F.col(tonnes)) / F.when(t > 0, t)).alias(c) for c in averages]
    cols += [F.when(F.count(c) == n, F.sum(c)).alias(c) for c in sums]
    cols += [F.when((F.count(c) == n) & (F.min(c) == F.max(c)), F.min(c)).alias(c) for c in labels]
    return df.groupBy(*keys).agg(t.alias(tonnes), *cols)


def auto_map(fields: DataFrame, columns: DataFrame, mapped: DataFrame) -> DataFrame:
    """(field, mapped): fields(field, category) not mapped yet, each with the column(name, category) of its name and kind."""
    open_ = fields.join(mapped.select("field").distinct(), "field", "left_anti")
    named = columns.select(F.col("name").alias("field"), "category", F.col("name").alias("mapped")).distinct()
    return open_.join(named, ["field", "category"]).select("field", "mapped")


def field_users(objects: DataFrame) -> DataFrame:
    """(field, object): which objects(object, fields) name each field, a row a use; a field that all objects name is no large row."""
    return objects.select(F.explode("fields").alias("field"), "object").distinct()


def merge_equivalent(rows: DataFrame, keys: list[str], same: list[str], amount: str) -> DataFrame:
    """(keys, same, amount, merged): rows that are identical in every field count once; of what is left those that agree in keys and same are one, amounts added."""
    return rows.distinct().groupBy(*keys, *same).agg(F.sum(amount).alias(amount), F.count(F.lit(1)).alias("merged"))


def merge_projects(target: DataFrame, imported: DataFrame) -> DataFrame:
    """(id, name, origin) of target(id, name) and imported(id, name): what is imported gets new ids beyond the target's, in order of its own, and a name that is taken is numbered from 2 on.

    Names are compared as they stand; of the imported ones the first in order keeps the plain name if the target leaves
    it. A number is by how many rows had the plain name before; a name that looks numbered already is a name like any.
    """
    top = target.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("top"))
    placed = ranked(imported.select("id", "name"), ["id"]).crossJoin(F.broadcast(top))
    used = target.groupBy(F.col("name").alias("__name")).agg(F.count(F.lit(1)).alias("__n"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    named = placed.withColumn("__nth", nth).join(used, F.col("name") == F.col("__name"), "left")
    number = F.col("__nth") + F.when(F.col("__n").isNotNull(), 1).otherwise(0)
    new = named.select((F.col("top") + F.col("place")).alias("id"), F.when(number > 1, F.concat("name", F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("name"), F.lit("imported").alias("origin"))
    return target.select("id", "name", F.lit("target").alias("origin")).unionByName(new)


def first_claims(claims: DataFrame, section: str, code: str) -> DataFrame:
    """(section, code, verdict) of the distinct claims: the least section that claims a code keeps it, for the others it is claimed.

    The keepers are a pre-aggregated minimum, so a code that very many sections claim is no large task.
    """
    each = claims.select(section, code).distinct()
    keeper = each.groupBy(F.col(code).alias("__code")).agg(F.min(section).alias("__first"))
    j = each.join(keeper, F.col(code) == F.col("__code"))
    return j.select(section, code, F.when(F.col(section) == F.col("__first"), "kept").otherwise("claimed").alias("verdict"))
