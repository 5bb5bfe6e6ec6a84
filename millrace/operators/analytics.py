"""Analytics on results: chart series, histograms, correlation, row rules."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

AGGREGATES = ("count", "sum", "avg", "max", "min", "last")


def as_number(df: DataFrame, column: str) -> Column:
    """Double; text that is no number counts as NULL."""
    kind = df.schema[column].dataType
    return F.col(column).cast("double") if isinstance(kind, T.NumericType) else F.col(column).try_cast("double")


def _series(df: DataFrame, column: str, agg: str, order: str | None) -> Column:
    v = F.coalesce(as_number(df, column), F.lit(0.0))
    if agg == "last":
        if order is None:
            raise ValueError("the last value needs an order column")
        return F.max_by(v, F.col(order))
    if agg == "count":
        return F.count(F.lit(1))
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; one of {AGGREGATES}")
    return getattr(F, agg)(v)


def chart_agg(df: DataFrame, x: str, ys: Sequence[tuple[str, str]], order: str | None = None,
              last_rows: int | None = None, groups: int | None = None) -> DataFrame:
    """One row per X (as text, NULL = "null") and a column ``<y>_<agg>`` per series; non-numbers count as 0.

    ``last_rows`` looks at the newest rows only and ``groups`` keeps the first X values; both need ``order``.
    """
    if last_rows is not None:
        df = df.orderBy(F.desc(order)).limit(last_rows)
    aggs = [_series(df, y, a, order).alias(f"{y}_{a}") for y, a in ys]
    if groups is not None:
        aggs.append(F.min(order).alias("_first"))
    out = df.groupBy(F.coalesce(F.col(x).cast("string"), F.lit("null")).alias(x)).agg(*aggs)
    return out.orderBy("_first").limit(groups).drop("_first") if groups is not None else out


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts per equal-width bin between the bounds (the column's own by default); empty bins are absent."""
    v = as_number(df, column)
    if low is None or high is None:
        bounds = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
        df = df.join(F.broadcast(bounds))  # a single row
        lo = F.col("lo") if low is None else F.lit(float(low))
        hi = F.col("hi") if high is None else F.lit(float(high))
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    width = (hi - lo) / bins
    number = F.when(width == 0, F.lit(1)).otherwise(F.least(F.floor((v - lo) / width) + 1, F.lit(bins)))
    placed = df.where(v.isNotNull() & (v >= lo) & (v <= hi)).select(
        number.cast("int").alias("bin"), lo.alias("_lo"), width.alias("_w"))
    out = placed.groupBy("bin", "_lo", "_w").agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin", (F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("bin_start"),
                      (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_end"), "n")


def heatmap_norm(df: DataFrame, label: str, value: str) -> DataFrame:
    """Values scaled by (v - min) / (max - min), where max is at least 1 and min at most 0."""
    v = F.coalesce(as_number(df, value), F.lit(0.0))
    base = df.select(label, v.alias(value))
    bounds = base.agg(F.greatest(F.max(value), F.lit(1.0)).alias("hi"), F.least(F.min(value), F.lit(0.0)).alias("lo"))
    return base.join(F.broadcast(bounds)).select(  # a single row
        label, value, ((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("norm"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson coefficients of all column pairs in one pass; 0 if undefined, 1 on the diagonal."""
    if len(columns) < 2:
        raise ValueError("a correlation matrix needs two columns")
    named = df.select(*[as_number(df, c).alias(c) for c in columns])
    pairs = list(combinations(range(len(columns)), 2))

    def coefficient(a: str, b: str) -> Column:
        # over rows with both values; corr() itself fails on a constant column in ANSI mode
        spread = F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))
        return F.try_divide(F.covar_pop(a, b), spread)

    row = named.agg(*[coefficient(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs])

    def cell(i: int, j: int) -> Column:
        if i == j:
            return F.lit(1.0)
        r = F.col(f"c{min(i, j)}_{max(i, j)}")
        return F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0))

    cells = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), cell(i, j).alias("r"))
             for i in range(len(columns)) for j in range(len(columns))]
    return row.select(F.inline(F.array(*cells)))


def mostly_numeric(df: DataFrame, share: float = 0.4) -> DataFrame:
    """Columns with more than ``share`` numbers, with that share: the candidates for a correlation matrix."""
    flat = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType))]
    row = df.agg(*[(F.count(as_number(df, c)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(c) for c in flat])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in flat])
    return row.select(F.inline(cells)).where(F.col("share") > share)


def _valid_regex(df: DataFrame, pattern: str) -> bool:
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # noqa: BLE001 - the JVM refuses the pattern
        return False


def rule_condition(df: DataFrame, field: str, op: str, value: str) -> Column | None:
    """Condition of one row rule; None if the field is unknown. NULL cells read as empty text."""
    if field not in df.columns:
        return None
    text = F.coalesce(F.col(field).cast("string"), F.lit(""))
    low, number = value.lower(), as_number(df, field)
    try:
        wanted = float(value)
    except ValueError:
        wanted = None
    both = number.isNotNull() if wanted is not None else F.lit(False)
    if op in ("==", "!="):
        same = (F.when(both, number == wanted).otherwise(text == value)) if wanted is not None else text == value
        return same if op == "==" else ~same
    if op in ("<", "<=", ">", ">="):
        if wanted is None:
            return F.lit(False)
        test = {"<": number < wanted, "<=": number <= wanted, ">": number > wanted, ">=": number >= wanted}[op]
        return F.coalesce(test, F.lit(False))
    if op == "contains":
        return F.lower(text).contains(low)
    if op == "starts":
        return F.lower(text).startswith(low)
    if op == "ends":
        return F.lower(text).endswith(low)
    if op == "regex":
        return text.rlike("(?i)" + value) if _valid_regex(df, value) else F.lit(False)
    return F.lit(False)


def row_rules(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Add ``rule`` and ``colour`` of the first matching rule: dicts with field, op, value, label, colour."""
    label, colour = F, F
    for r in rules:
        test = rule_condition(df, r["field"], r["op"], str(r["value"]))
        if test is not None:
            label = label.when(test, F.lit(r["label"]))
            colour = colour.when(test, F.lit(r["colour"]))
    empty = F.lit(None).cast("string")
    return df.withColumns({"rule": empty if label is F else label, "colour": empty if colour is F else colour})
