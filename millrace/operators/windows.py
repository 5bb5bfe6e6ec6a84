"""Event-time windows: tumbling, sliding, session and cumulating. Batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace import durations
from millrace.operators import slices as sl


def _flat(grouped: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return grouped.select(F.col("window.start").alias("window_start"),
                          F.col("window.end").alias("window_end"), *by, *names)


def _agg(grouped, aggs: dict[str, Column]):
    return grouped.agg(*[a.alias(n) for n, a in aggs.items()])


def tumble(df: DataFrame, ts: str, size: str, by: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Fixed windows ``[start, start + size)`` aligned to the epoch."""
    return _flat(_agg(df.groupBy(F.window(ts, size).alias("window"), *by), aggs), by, list(aggs))


def hop(df: DataFrame, ts: str, slide: str, size: str, by: Sequence[str],
        aggs: dict[str, Column]) -> DataFrame:
    """Sliding windows; the slide comes before the size."""
    return _flat(_agg(df.groupBy(F.window(ts, size, slide).alias("window"), *by), aggs), by, list(aggs))


def session(df: DataFrame, ts: str, gap: str, by: Sequence[str], aggs: dict[str, Column],
            slice_width: str = "1 hour", hot_rows: int = sl.HOT_ROWS) -> DataFrame:
    """Sessions per key; the end is the last event plus the gap.

    Streams use ``session_window``. Bounded tables use ``assign_sessions``, whose final grouping is
    by session, with partial aggregation, so that neither a busy key nor a long session is one task.
    """
    if not by:
        raise ValueError("session windows need a key")
    if df.isStreaming:
        grouped = df.groupBy(F.session_window(ts, gap).alias("window"), *by)
        return _flat(_agg(grouped, aggs), by, list(aggs))
    marked = assign_sessions(df, ts, gap, by, slice_width, hot_rows)
    grouped = marked.groupBy(*by, "session_start").agg(
        F.max(ts).alias("_last"), *[a.alias(n) for n, a in aggs.items()])
    return grouped.select(F.col("session_start").alias("window_start"),
                          (F.col("_last") + durations.interval(gap)).alias("window_end"), *by, *aggs)


def assign_sessions(df: DataFrame, ts: str, gap: str, by: Sequence[str],
                    slice_width: str = "1 hour", hot_rows: int = sl.HOT_ROWS) -> DataFrame:
    """Add ``session_start``. Events at most ``gap`` apart share a session; NULL times are dropped.

    In a slice only the first session can be the tail of an earlier one. Its true start follows from
    the slices' first and last sessions, one row per busy slice.
    """
    limit = durations.micros(gap)
    c = sl.cut(df.where(F.col(ts).isNotNull()), by, [ts], slice_width, hot_rows)
    w = Window.partitionBy(*by, sl.SLICE, sl.HOT).orderBy(ts)  # _hot, so that its filters pass the window
    apart = durations.since_epoch(ts) - durations.since_epoch(F.lag(ts).over(w))
    local = (c.withColumn("_opens", F.when(apart.isNull() | (apart > limit), F.col(ts)))
             .withColumn("_start", F.last("_opens", ignorenulls=True).over(
                 w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))

    # per slice of a busy key: its first and last event and the start of its last session
    edges = (local.where(sl.HOT).groupBy(*by, sl.SLICE)
             .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max("_start").alias("_tail")))
    over_slices = Window.partitionBy(*by).orderBy(sl.SLICE)
    gap_before = durations.since_epoch("_first") - durations.since_epoch(F.lag("_last").over(over_slices))
    # a slice made of a single session that touches its predecessor passes the earlier start on
    linked = edges.withColumn("_joins", F.coalesce(gap_before <= limit, F.lit(False)))
    opens = F.when(~F.col("_joins") | (F.col("_tail") > F.col("_first")), F.col("_tail"))
    carried = (linked.withColumn("_from", F.last(opens, ignorenulls=True).over(
                   over_slices.rowsBetween(Window.unboundedPreceding, -1)))
               .where("_joins")
               .select(*by, sl.SLICE, F.col("_first").alias("_start"), F.col("_from").alias("session_start")))
    # the heads of slices that continue a session; few, and only of busy keys
    keys = [*by, sl.SLICE, "_start"]
    renamed = carried.select(*[F.col(k).alias("_p_" + k) for k in keys], "session_start")
    cold = local.where(~F.col(sl.HOT)).select(*df.columns, F.col("_start").alias("session_start"))
    hot = local.where(sl.HOT)
    joined = hot.join(renamed, sl.same_keys(hot, renamed, keys, "_p_"), "left")
    return cold.unionByName(joined.select(*[hot[x] for x in df.columns],
                                          F.coalesce("session_start", "_start").alias("session_start")))


def cumulate(df: DataFrame, ts: str, step: str, max_size: str, by: Sequence[str],
             aggs: dict[str, Column]) -> DataFrame:
    """Windows that share a start and grow by ``step`` up to ``max_size``.

    A row counts in its own step and every later one; steps before a window's first row are absent.
    """
    width, whole = durations.micros(step), durations.micros(max_size)
    if whole % width:
        raise ValueError("the maximal size must be a multiple of the step")
    steps = whole // width
    placed = df.withColumn("_w", F.window(ts, max_size))
    at = F.floor((durations.since_epoch(ts) - durations.since_epoch("_w.start")) / F.lit(width)) + 1
    grown = placed.withColumn("_k", F.explode(F.sequence(at.cast("int"), F.lit(steps))))
    end = F.col("_w.start") + F.make_dt_interval(
        secs=(F.col("_k").cast("bigint") * F.lit(width) / F.lit(1_000_000)).cast("decimal(18,6)"))
    if df.isStreaming:
        # the watermark closes groups by the window column, so it stays a grouping key
        grouped = _agg(grown.groupBy(F.window(ts, max_size).alias("_w2"), "_k", *by), aggs)
        out = grouped.withColumnRenamed("_w2", "_w")
        return out.select(F.col("_w.start").alias("window_start"), end.alias("window_end"), *by, *aggs)
    grouped = _agg(grown.groupBy("_w", "_k", *by), aggs)
    return grouped.select(F.col("_w.start").alias("window_start"), end.alias("window_end"), *by, *aggs)


def tumble_distinct(df: DataFrame, ts: str, size: str, by: Sequence[str], column: str, alias: str) -> DataFrame:
    """Exact COUNT(DISTINCT column) per tumbling window, on streams too.

    Streams refuse distinct aggregates; two chained ones do the same, and no group gathers its values.
    """
    each = df.where(F.col(column).isNotNull()).groupBy(F.window(ts, size).alias("_w"), *by, column).agg(
        F.count(F.lit(1)).alias("_n"))
    return _flat(_agg(each.groupBy(F.window("_w", size).alias("window"), *by), {alias: F.count(F.lit(1))}), by, [alias])


def multi_tumble(df: DataFrame, ts: str, sizes: Sequence[str], by: Sequence[str],
                 aggs: dict[str, Column]) -> DataFrame:
    """The same aggregates over several window sizes, tagged with ``window_size``.

    A table is read once, each row counting once for every size; on a stream every size is a branch with its own state.
    """
    if df.isStreaming:
        parts = [tumble(df, ts, s, by, aggs).withColumn("window_size", F.lit(s)) for s in sizes]
        return reduce(lambda a, b: a.unionByName(b), parts)
    kind, us = df.schema[ts].dataType.simpleString(), durations.since_epoch(ts)
    start = [F.floor(us / F.lit(durations.micros(s))) * durations.micros(s) for s in sizes]
    windows = F.array(*[F.struct(F.lit(s).alias("size"), durations.at_micros(b, kind).alias("start"),
                                 durations.at_micros(b + durations.micros(s), kind).alias("end")) for s, b in zip(sizes, start)])
    rows = df.where(F.col(ts).isNotNull()).withColumn("_w", F.explode(windows))
    return _agg(rows.groupBy(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, F.col("_w.size").alias("window_size")),
                aggs).select("window_start", "window_end", *by, *aggs, "window_size")
