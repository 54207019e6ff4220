"""Block values, route choice and nested-shell reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def method_values(blocks: DataFrame, methods: DataFrame, key: str, code: str, grade: str, tonnes: str, waste_cost: float, price: float) -> DataFrame:
    """(key, destination, value): the best of waste and each admissible method; waste, then the earlier method, wins a tie.

    methods: seq, method, accepts (codes; null: any), lo, hi (lo <= grade < hi), recovery, cost. The method
    table is small by nature; blocks are only projected, never shuffled: the methods become one expression.
    """
    waste = -F.col(tonnes) * waste_cost
    best_value, best = waste, F.lit("waste")
    for m in methods.orderBy("seq").collect():
        admit = F.lit(True) if m["accepts"] is None else F.coalesce(F.col(code).isin(*m["accepts"]), F.lit(False))
        admit = admit & F.coalesce(F.col(grade) >= m["lo"], F.lit(False)) & F.coalesce(F.col(grade) < m["hi"], F.lit(False))
        value = F.col(tonnes) * (F.col(grade) * m["recovery"] * price - m["cost"] - waste_cost)
        better = admit & (value > best_value)
        best, best_value = F.when(better, F.lit(m["method"])).otherwise(best), F.when(better, value).otherwise(best_value)
    return blocks.select(key, best.alias("destination"), best_value.alias("value"))


def shell_report(blocks: DataFrame, shell: str, destination: str, sums: dict[str, Column]) -> DataFrame:
    """Increments and running totals of each sum by shell and destination, for every pair."""
    parts = blocks.groupBy(shell, destination).agg(F.count(F.lit(1)).alias("blocks"), *[c.alias(n) for n, c in sums.items()])
    spine = parts.select(shell).distinct().crossJoin(F.broadcast(parts.select(destination).distinct()))
    full = spine.join(parts, [shell, destination], "left").fillna(0)
    w = Window.partitionBy(destination).orderBy(shell).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(shell, destination, *[x for n in ("blocks", *sums) for x in (F.col(n), F.sum(n).over(w).alias(f"cum_{n}"))])


def pushback(report: DataFrame, shell: str, destination: str, after: int, upto: int, names: list[str]) -> DataFrame:
    """What lies between two shells, by destination."""
    return report.where((F.col(shell) > after) & (F.col(shell) <= upto)).groupBy(destination).agg(*[F.sum(n).alias(n) for n in names])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def with_totals(df: DataFrame, keys: list[str], over: str, sums: list[str], label: str = "Total") -> DataFrame:
    """Rows by keys and `over`, and a row labelled Total for each of the keys."""
    out = df.rollup(*keys, over).agg(*[F.sum(c).alias(c) for c in sums], F.grouping_id().alias("__g")) if not keys else df.groupBy(*keys, over).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("__g", F.lit(0))
    if keys:
        totals = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).withColumn(over, F.lit(label)).withColumn("__g", F.lit(1))
        out = out.unionByName(totals)
    return out.withColumn(over, F.coalesce(over, F.lit(label))).drop("__g")


def truck_hours_per_tonne(cycle_hours: Column, payload: Column, queue_hours: Column) -> Column:
    return F.when(payload > 0, (cycle_hours + queue_hours) / payload)


def speed_at(grades: list[tuple[float, float]], grade: Column, top: float, limit: Column | None = None) -> Column:
    """The last grade row at or below the grade, else the first; capped by the class and the road."""
    out = F.lit(grades[0][1])
    for from_grade, kph in grades:
        out = F.when(grade >= from_grade, F.lit(kph)).otherwise(out)
    out = F.least(out, F.lit(top))
    return out if limit is None else F.least(out, F.coalesce(limit, F.lit(top)))
