"""Ordered per-key functions that keep one busy key from landing in a single task.

``Window.partitionBy(key)`` sends all rows of a key to one task. Here keys with more than
``hot_rows`` rows are cut into slices of the leading order column (an hour of event time, say),
and what a slice needs from its neighbours travels separately:

* ``prefix`` - aggregates of all earlier slices (row numbers, running sums, as-of values),
* ``edge rows`` - the last or first n rows of the neighbouring slices (lag, lead, ROWS frames),
* ``time halo`` - rows within a time distance of the slice (RANGE frames, patterns).

Keys at or below ``hot_rows`` form one slice and need none of it. There are at most
total rows / ``hot_rows`` busy keys, which bounds the list that is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace import durations

HOT_ROWS = 1_000_000
SLICE = "_slice"
HOT = "_hot"

_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def order_columns(order: Sequence[str]) -> list[Column]:
    """``"ts"`` ascending, ``"-ts"`` descending; NULLs first ascending and last descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def same_keys(left: DataFrame, right: DataFrame, by: Sequence[str], prefix: str) -> Column:
    """NULL-safe equality between ``by`` and its prefixed copies."""
    tests = [left[k].eqNullSafe(right[prefix + k]) for k in by]
    return reduce(lambda a, b: a & b, tests)


def busy_keys(df: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, columns prefixed with ``_h_``."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > hot_rows)
              .select(*[F.col(k).alias("_h_" + k) for k in by], F.lit(True).alias(HOT)))


def mark_busy(df: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame:
    """Add ``_hot``; a table that has it already keeps it, so that keys are counted once per plan."""
    if HOT in df.columns:
        return df
    hot = F.broadcast(busy_keys(df, by, hot_rows))
    joined = df.join(hot, same_keys(df, hot, by, "_h_"), "left")
    return joined.select(*[df[c] for c in df.columns],
                         F.coalesce(hot[HOT], F.lit(False)).alias(HOT))


def slice_number(df: DataFrame, column: str, width: str | float) -> Column:
    """Monotone slice number: of a time (duration text), a number (step), or the first bytes of a text.

    NaN stands after all numbers, as the order has it. Numbers beyond the bounds share the outermost slices.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, _TIME_TYPES):
        return F.floor(durations.since_epoch(column) / F.lit(durations.micros(str(width))))
    if isinstance(kind, T.NumericType):
        edge = float(2 ** 60)
        inside = F.greatest(F.least(F.col(column).cast("double") / F.lit(float(width) if _is_number(width) else 1.0), F.lit(edge)), F.lit(-edge))
        return F.when(F.isnan(F.col(column).cast("double")), F.lit(2 ** 61)).when(F.col(column).isNotNull(), F.floor(inside).cast("long"))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")
    if isinstance(kind, T.BooleanType):
        return F.col(column).cast("long")
    raise ValueError(f"cannot slice {column!r}: no order of {kind.simpleString()} is known here")


def _is_number(width) -> bool:
    return isinstance(width, (int, float)) or str(width).replace(".", "", 1).isdigit()


def cut(df: DataFrame, by: Sequence[str], order: Sequence[str], width: str | float,
        hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_hot`` and ``_slice``; slices of a busy key ascend along ``order``.

    NULLs of the leading order column go where the order puts them: first if ascending,
    last if descending.
    """
    lead = order[0].lstrip("-")
    number = slice_number(df, lead, width)
    if order[0].startswith("-"):
        number = F.coalesce(-number, F.lit(2 ** 62))
    else:
        number = F.coalesce(number, F.lit(-2 ** 62))
    marked = mark_busy(df, by, hot_rows)
    return marked.withColumn(SLICE, F.when(F.col(HOT), number).otherwise(F.lit(0)).cast("long"))


def with_prefix(cut_df: DataFrame, source: DataFrame, by: Sequence[str], aggregates: dict[str, Column],
                combine: dict[str, Column]) -> DataFrame:
    """Add to each slice of a busy key one row with ``combine`` over the aggregates of all earlier slices.

    ``source`` holds the rows to aggregate, cut alike. The added rows have ``_data`` = 0, the others 1, and
    their values in the struct ``_past``; windows order by ``_data`` first, so no join brings them in and
    the rows are shuffled once. The per-key window below runs over slices, not over rows.
    """
    per_slice = (source.where(HOT).groupBy(*by, SLICE)
                 .agg(*[a.alias(n) for n, a in aggregates.items()]))
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*by, SLICE, F.lit(True).alias(HOT), F.lit(0).alias("_data"),
                               F.struct(*[c.over(earlier).alias(n) for n, c in combine.items()]).alias("_past"))
    kind = carried.schema["_past"].dataType
    data = cut_df.withColumns({"_data": F.lit(1), "_past": F.lit(None).cast(kind)})
    return data.unionByName(carried, allowMissingColumns=True)


def slice_window(by: Sequence[str], *order: Column):
    """Window over one slice, the row that ``with_prefix`` added first."""
    return Window.partitionBy(*by, SLICE).orderBy("_data", *order)


def past(name: str, w) -> Column:
    """Value carried into the slice; NULL in the first slice and for other keys."""
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.first("_past", ignorenulls=True).over(rows)[name]


def with_edge_rows(cut_df: DataFrame, by: Sequence[str], order: Sequence[str],
                   before: int = 0, after: int = 0) -> DataFrame:
    """Add copies (``_own`` = false) of the ``before``/``after`` rows next to each busy slice."""
    columns = [c for c in cut_df.columns if c not in (SLICE, HOT)]
    keep = [*[F.col(c) for c in columns], F.col(SLICE), F.col(HOT)]
    result = cut_df.select(*keep, F.lit(True).alias("_own"))
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    for count, step in ((before, -1), (after, 1)):
        if not count:
            continue
        inward = order_columns(order) if step > 0 else \
            order_columns([o[1:] if o.startswith("-") else "-" + o for o in order])
        place = Window.partitionBy(*by, SLICE).orderBy(*inward)
        edges = (cut_df.where(HOT).withColumn("_place", F.row_number().over(place))
                 .where(F.col("_place") <= count)
                 .groupBy(*by, SLICE)
                 .agg(F.sort_array(F.collect_list(F.struct("_place", row.alias("_row"))))
                      .alias("_edge")))
        # every slice holds at least one row, so `count` neighbours are enough
        near = Window.partitionBy(*by).orderBy(F.col(SLICE) * -step).rowsBetween(-count, -1)
        borrowed = (edges
                    .withColumn("_edges", F.reverse(F.collect_list("_edge").over(near)))
                    .select(SLICE, F.explode(F.slice(F.flatten("_edges"), 1, count)).alias("_e")))
        result = result.unionByName(
            borrowed.select(*[F.col("_e._row." + c).alias(c) for c in columns],
                            F.col(SLICE), F.lit(True).alias(HOT), F.lit(False).alias("_own")))
    return result


def with_time_halo(df: DataFrame, by: Sequence[str], ts: str, width: str, reach: str,
                   backward: bool, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Give each busy slice the rows within ``reach`` before (or after) it, ``_own`` = false.

    Adds ``_hot``, ``_slice`` and ``_own``. Slices are at least as wide as the reach, so that a row is in two of them at most.

    ``backward`` = true serves frames that look back in time, false those that look ahead.
    """
    span = durations.micros(reach)
    step = max(durations.micros(width), span)
    at = durations.since_epoch(ts)
    own = F.floor(at / F.lit(step))
    other = F.floor((at + F.lit(span if backward else -span)) / F.lit(step))
    slices = F.sequence(own, other) if backward else F.sequence(other, own)
    marked = mark_busy(df, by, hot_rows)
    home = F.when(F.col(HOT), own).otherwise(F.lit(0)).cast("long")
    return (marked
            .withColumn("_home", home)
            .withColumn(SLICE, F.explode(F.when(F.col(HOT) & F.col(ts).isNotNull(),
                                                slices.cast("array<bigint>"))
                                         .otherwise(F.array(F.col("_home")))))
            .withColumn("_own", F.col(SLICE).eqNullSafe(F.col("_home")))
            .drop("_home"))
