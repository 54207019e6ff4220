"""Rule tables: first match, sum of matches, union of matches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import finite

#: Rules are matched in blocks of so many; a block is one row that every task has.
RULE_LIMIT = 10_000


def _rules(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(RULE_LIMIT + 1).count() <= RULE_LIMIT else rules


def _blocks(facts: DataFrame, rules: DataFrame, seq: str | None = None) -> tuple[DataFrame, list[str]]:
    """facts with columns of the enabled rules as ordered arrays (by seq, null last, then by value), and their names.

    Each is a scalar subquery, one array of RULE_LIMIT rules at most that is computed once.
    """
    rules = rules.where("enabled")
    order = F.col(seq) if seq else F.lit(0)
    each = F.struct(order.isNull().alias("none"), order.alias("seq"), F.struct(*[F.col(f"`{c}`") for c in rules.columns]).alias("rule"))
    n = rules.count()
    listed = lambda df: df.agg(F.transform(F.array_sort(F.collect_list("each")), lambda x: x["rule"]).alias("rules")).scalar()
    rows = rules.select(each.alias("each"))
    if n <= RULE_LIMIT:
        return facts.withColumn("__rules0", listed(rows)), ["__rules0"]
    nth = rows.withColumn("block", F.floor((F.row_number().over(Window.orderBy("each")) - 1) / RULE_LIMIT))
    blocks = {f"__rules{b}": listed(nth.where(F.col("block") == b)) for b in range(-(-n // RULE_LIMIT))}
    return facts.withColumns(blocks), list(blocks)


def _sure(condition: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda rule: F.coalesce(condition(rule), F.lit(False))


def within(value: Column, lo: Column, hi: Column, lo_inclusive: Column | bool = True, hi_inclusive: Column | bool = False) -> Column:
    """A condition's range; a null bound is open; a missing value fails."""
    a = F.lit(lo_inclusive) if isinstance(lo_inclusive, bool) else lo_inclusive
    b = F.lit(hi_inclusive) if isinstance(hi_inclusive, bool) else hi_inclusive
    return finite(value) & F.coalesce((value > lo) | (a & (value == lo)), F.lit(True)) & F.coalesce((value < hi) | (b & (value == hi)), F.lit(True))


def any_of(values: Column, value: Column) -> Column:
    """Membership in a rule's set; a null set admits everything."""
    return values.isNull() | F.coalesce(F.array_contains(values, value), F.lit(False))


def first_match(facts: DataFrame, rules: DataFrame, condition: Callable[[Column], Column], seq: str) -> DataFrame:
    """Each fact row with its first matching enabled rule (by seq, null last; ties by the rule's values); without one, nulls.

    condition(rule) is over the fact's columns and the rule's fields. Every row finds its own match in place, so
    nothing is shuffled and rows that share a key don't meet; equal fact rows match alike.
    """
    name = "__hit"
    ruled, blocks = _blocks(facts, rules, seq)
    hits = [F.get(F.filter(block, _sure(condition)), F.lit(0)) for block in blocks]
    return ruled.withColumn(name, F.coalesce(*hits)).select(*[F.col(f"`{c}`") for c in facts.columns], *[F.col(name)[c].alias(c) for c in rules.columns])


def sum_matches(facts: DataFrame, rules: DataFrame, condition: Callable[[Column], Column], key: list[str], value: str) -> DataFrame:
    """(key, total, matches) of each fact row: the sum over all matching enabled rules, in their order; none is 0; a value that isn't finite is an error."""
    checked = rules.where("enabled").withColumn(value, F.when(finite(F.col(value)), F.col(value)).otherwise(F.raise_error(F.lit("a rule's value isn't finite"))))
    ruled, blocks = _blocks(facts, checked)
    got = F.concat(*[F.transform(F.filter(block, _sure(condition)), lambda r: r[value].cast("double")) for block in blocks])
    out = ruled.withColumn("__values", got)
    return out.select(*key, F.aggregate("__values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("__values").cast("long").alias("matches"))


def union_matches(facts: DataFrame, rules: DataFrame, condition: Callable[[Column], Column], key: list[str], items: str) -> DataFrame:
    """(key, item): the distinct items of all enabled rules that a fact row matches; a fact without a match has none."""
    ruled, blocks = _blocks(facts, rules)
    got = F.flatten(F.concat(*[F.transform(F.filter(block, _sure(condition)), lambda r: r[items]) for block in blocks]))
    return ruled.select(*key, F.explode(F.array_distinct(got)).alias("item"))


def unmatched(facts: DataFrame, rules: DataFrame, condition: Callable[[Column], Column]) -> DataFrame:
    """The fact rows that no enabled rule matches."""
    ruled, blocks = _blocks(facts, rules)
    return ruled.where(~reduce(or_, [F.exists(block, _sure(condition)) for block in blocks])).drop(*blocks)


def missing_references(wanted: DataFrame, known: DataFrame, column: str) -> DataFrame:
    return wanted.join(known, column, "left_anti").select(column).distinct()
