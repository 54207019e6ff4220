"""A metric registry compiled to one aggregation, with explicit accounting of what is missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import finite


@dataclass(frozen=True)
class Metric:
    """kind: sum, weighted (by `weight`, a column), volume (by `volume`) or category (counts a label)."""

    name: str
    kind: str
    value: Column | str | float
    weight: Column | str | None = None

    def column(self) -> Column:
        if isinstance(self.value, (int, float)):
            return F.lit(float(self.value))
        return F.col(self.value) if isinstance(self.value, str) else self.value

    def weights(self) -> Column | None:
        return F.col(self.weight) if isinstance(self.weight, str) else self.weight


def _parts(m: Metric, share: Column | None, negatives_as_zero: bool) -> dict[str, Column]:
    v, w = m.column(), m.weights()
    ok = finite(v)
    taken = F.greatest(v, F.lit(0.0)) if negatives_as_zero else v
    part = share if share is not None else F.lit(1.0)
    n = f"{m.name}__"
    out = {n + "missing": F.count_if(~ok), n + "negative": F.count_if(ok & (v < 0)), n + "min": F.min(F.when(ok, v)), n + "max": F.max(F.when(ok, v))}
    if w is None:
        return out | {n + "used": F.count_if(ok), n + "sum": F.sum(F.when(ok, taken * part))}
    good = ok & finite(w) & (w > 0)
    return out | {
        n + "used": F.count_if(good),
        n + "unusable": F.count_if(ok & ~(finite(w) & (w > 0))),
        n + "sum": F.sum(F.when(good, taken * w * part)),
        n + "weight": F.sum(F.when(good, w * part)),
    }


def partials(df: DataFrame, metrics: list[Metric], keys: list[str], share: Column | None = None, negatives_as_zero: bool = False) -> DataFrame:
    """Mergeable accumulators of each metric by keys; `share` is the fraction of a row that counts."""
    cols = [c.alias(k) for m in metrics for k, c in _parts(m, share, negatives_as_zero).items()]
    return df.groupBy(*keys).agg(*cols)


def merge(parts: DataFrame, metrics: list[Metric], keys: list[str]) -> DataFrame:
    """Accumulators of several inputs as one."""
    out = []
    for m in metrics:
        for k in _parts(m, None, False):
            how = F.min if k.endswith("__min") else F.max if k.endswith("__max") else F.sum
            out.append(how(k).alias(k))
    return parts.groupBy(*keys).agg(*out)


def finalise(parts: DataFrame, metrics: list[Metric], keys: list[str], digits: int = 6) -> DataFrame:
    """Figures: null without a contribution; a sum; or sum over weight if the weight is positive."""
    cols: list[Column] = [F.col(k) for k in keys]
    for m in metrics:
        n = f"{m.name}__"
        value = F.col(n + "sum")
        if m.weights() is not None:
            value = F.when(F.col(n + "weight") > 0, value / F.col(n + "weight"))
            cols.append(F.col(n + "unusable").cast("long").alias(m.name + "_unusable"))
        cols += [
            F.round(F.when(F.col(n + "used") > 0, value), digits).alias(m.name),
            F.col(n + "missing").cast("long").alias(m.name + "_missing"),
            F.col(n + "min").alias(m.name + "_min"),
            F.col(n + "max").alias(m.name + "_max"),
        ]
    return parts.select(*cols)


def totals(df: DataFrame, metrics: list[Metric], keys: list[str] | None = None, **options) -> DataFrame:
    return finalise(partials(df, metrics, keys or [], **options), metrics, keys or [])


def category_totals(df: DataFrame, metrics: list[Metric], categories: list[str]) -> DataFrame:
    """All rows, and each category by itself: (category, label) with one scan; a blank label is its own group."""
    grid = F.explode(F.array(*[F.struct(F.lit(c or "all").alias("category"), (F.col(c).cast("string") if c else F.lit(None).cast("string")).alias("label")) for c in [None, *categories]]))
    return totals(df.withColumn("__g", grid).select("*", "__g.category", "__g.label"), metrics, ["category", "label"])


def default_kind(column: str) -> str:
    """volume for densities, sum for tonnages and the like, else weighted."""
    c = column.lower()
    if any(x in c for x in ("density", "sg")):
        return "volume"
    return "sum" if any(x in c for x in ("ton", "volume", "mass", "metal")) else "weighted"


def binding_issue(name: str, columns: dict[str, str], kind: str, weight: str | None, sums: set[str]) -> str | None:
    """Why a metric can't be computed, or None."""
    if name not in columns:
        return "ColumnMissing"
    numeric = columns[name] in ("double", "float", "int", "bigint", "long")
    if kind == "category":
        return None if columns[name] == "string" else "NotACategory"
    if not numeric:
        return "NotNumeric"
    if kind == "weighted":
        if weight is None:
            return "WeightMissing"
        if weight not in columns:
            return "WeightColumnMissing"
        if weight not in sums:
            return "WeightIsNoSum"
    return None


def binding_issues(name: Column, kind: Column, weight: Column, columns: dict[str, str], sums: set[str]) -> Column:
    """binding_issue of a row's own name, kind and weight, against one table's columns (name to type)."""
    typed = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    of = F.try_element_at(typed, name)
    numeric = of.isin("double", "float", "int", "bigint", "long")
    weighted = kind == "weighted"
    return (
        F.when(of.isNull(), "ColumnMissing")
        .when((kind == "category") & (of != "string"), "NotACategory")
        .when(kind == "category", F.lit(None).cast("string"))
        .when(~numeric, "NotNumeric")
        .when(weighted & weight.isNull(), "WeightMissing")
        .when(weighted & F.try_element_at(typed, weight).isNull(), "WeightColumnMissing")
        .when(weighted & ~weight.isin(*sums), "WeightIsNoSum")
    )


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows and share of the total by key; one aggregate and one row of totals."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
