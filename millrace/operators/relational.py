"""Filter, projection, CASE builders, routing, set operations, paging and search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.operators import ranges, slices as sl


def where_all(df: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """AND of free-text conditions, each in its own parentheses."""
    return df.where(" AND ".join(f"({c})" for c in conditions)) if conditions else df


def project(df: DataFrame, lines: Sequence[str]) -> DataFrame:
    """One SELECT expression per line; none means every column."""
    return df.selectExpr(*lines) if lines else df


def computed_view(df: DataFrame, columns: dict[str, str], condition: str | None = None,
                  view: str | None = None) -> DataFrame:
    """All columns plus computed ones, optionally filtered and registered as a view."""
    out = df.where(condition) if condition else df
    out = out.withColumns({n: F.expr(e) for n, e in columns.items()})
    if view:
        out.createOrReplaceTempView(view)
    return out


def case_of_column(column: str, branches: Sequence[tuple[str, object]], default: object = None) -> Column:
    """CASE whose branches are comparisons of one column: ``(">= 100", "BIG")``."""
    return case_of([(f"{column} {test}", value) for test, value in branches], default)


def case_of(branches: Sequence[tuple[str, object]], default: object = None) -> Column:
    """CASE over full conditions; the first true one wins."""
    (first, value), *rest = branches
    chain = F.when(F.expr(first), F.lit(value))
    for condition, value in rest:
        chain = chain.when(F.expr(condition), F.lit(value))
    return chain.otherwise(F.lit(default))


def split_route(df: DataFrame, routes: dict[str, str], rest: str | None = None) -> dict[str, DataFrame]:
    """One DataFrame per condition; a row may match several. ``rest`` names the unmatched rows."""
    out = {name: df.where(c) for name, c in routes.items()}
    if rest:
        missed = reduce(lambda a, b: a & b, [~F.coalesce(F.expr(c), F.lit(False)) for c in routes.values()])
        out[rest] = df.where(missed)
    return out


def union(first: DataFrame, second: DataFrame, distinct: bool = False) -> DataFrame:
    """By position, as in SQL."""
    both = first.union(second)
    return both.distinct() if distinct else both


def page(df: DataFrame, order: Sequence[str], first: int, last: int, cap: int | None = None) -> DataFrame:
    """Rows ``first``..``last`` (1-based) of an ordered result; a range of more than ``cap`` rows is an error, never shortened."""
    rows = last - first + 1
    if cap is not None and rows > cap:
        raise ValueError(f"a page of {rows} rows; at most {cap} are allowed")
    return df.orderBy(*sl.order_columns(order)).offset(first - 1).limit(rows)


def deep_page(df: DataFrame, order: Sequence[str], first: int, last: int, parts: int | None = None) -> DataFrame:
    """Rows ``first``..``last`` (1-based) of an ordered result, wherever the page lies.

    The table is cut into ranges of like size along ``order`` (borders from a bounded sample); their counts, one number each, say which of them hold the
    page, and only those are read and sorted. ``order`` must be unique. A page beyond the end is shorter or empty.
    """
    parts = parts or max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    borders = ranges.Borders(df, [], order, parts)
    if not borders.marks:
        return page(df, order, first, last)
    cut = borders.cut(df)
    before, chosen, skipped = 0, [], None
    for r in cut.groupBy(sl.SLICE).count().orderBy(sl.SLICE).collect():
        if before < last and before + r["count"] >= first:
            chosen.append(r[sl.SLICE])
            skipped = before if skipped is None else skipped
        before += r["count"]
    if not chosen:
        return df.limit(0)
    inside = cut.where(F.col(sl.SLICE).between(chosen[0], chosen[-1])).select(*df.columns)
    return page(inside, order, first - skipped, last - skipped)


def search_any(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where any column contains the text, ignoring case."""
    needle = text.lower()
    names = columns or [f.name for f in df.schema.fields
                        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in names]
    return df.where(reduce(lambda a, b: a | b, hits))


def redistribute(df: DataFrame, strategy: str, keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Edge types of a pipeline: forward, hash, rebalance, broadcast, rescale."""
    from millrace.operators.joins import broadcast_if_small
    s = strategy.lower()
    if s == "forward":
        return df
    if s == "hash":
        if not keys:
            raise ValueError("a hash edge needs keys")
        return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    if s == "rebalance":
        # AQE splits and merges what this hint produces, so no partition count is needed
        return df.repartition(partitions) if partitions else df.hint("rebalance")
    if s == "broadcast":
        return broadcast_if_small(df)
    if s == "rescale":
        return df.coalesce(partitions) if partitions else df
    raise ValueError(f"unknown edge type: {strategy}")
