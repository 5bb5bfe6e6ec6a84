"""Sliding and cumulating windows put together from panes, so that no row is copied into the windows that hold it.

Rows are aggregated once into panes (the widest stretches that no window border cuts); windows then merge the partial aggregates of their
panes. On tables that is a window frame over the panes of a key, of which there are at most the time span over the pane's width. On streams it
is a second aggregation over the panes that the watermark has closed. Aggregates are given as ``(kind, column)``: count (column None counts
rows), sum, min, max, avg, var_pop, var_samp, stddev_pop, stddev_samp, approx_distinct, and on tables distinct (exact).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace import durations

Aggregates = dict[str, tuple[str, str | None]]

SPREAD = {"var_pop": (0, False), "var_samp": (1, False), "stddev_pop": (0, True), "stddev_samp": (1, True)}
KINDS = ("count", "sum", "min", "max", "avg", "approx_distinct", "distinct", *SPREAD)


def partials(aggregates: Aggregates) -> dict[str, Column]:
    """What a pane keeps of its rows."""
    out = {}
    for name, (kind, column) in aggregates.items():
        if kind not in KINDS:
            raise ValueError(f"unknown aggregate {kind!r}; one of {KINDS}")
        if kind in ("count", "avg", *SPREAD):
            out[f"_n_{name}"] = F.count(F.lit(1) if column is None else F.col(column))
        if kind in ("sum", "avg"):
            out[f"_s_{name}"] = F.sum(column)
        if kind in SPREAD:
            out[f"_m_{name}"], out[f"_v_{name}"] = F.avg(column), F.var_pop(column)
        if kind in ("min", "max"):
            out[f"_x_{name}"] = F.min(column) if kind == "min" else F.max(column)
        if kind == "approx_distinct":
            out[f"_h_{name}"] = F.hll_sketch_agg(column)
    return out


def merged(name: str, kind: str, over, shift: Column | None = None) -> Column:
    """The aggregate of several panes; ``over`` turns an aggregate into one over the panes of a window."""
    col = lambda mark: F.col(f"_{mark}_{name}")
    if kind == "count":
        return F.coalesce(over(F.sum(col("n"))), F.lit(0))
    if kind == "sum":
        return over(F.sum(col("s")))
    if kind == "avg":
        return F.try_divide(over(F.sum(col("s"))), over(F.sum(col("n"))))
    if kind in ("min", "max"):
        return over((F.min if kind == "min" else F.max)(col("x")))
    if kind == "approx_distinct":
        return F.coalesce(F.hll_sketch_estimate(over(F.hll_union_agg(col("h")))), F.lit(0))
    less, root = SPREAD[kind]
    # means are taken from a value near them, so that their squares do not cancel
    off = col("m") - (F.lit(0.0) if shift is None else shift)
    n, total, squares = over(F.sum(col("n"))), over(F.sum(col("n") * off)), over(F.sum(col("n") * (col("v") + off * off)))
    around = squares - total * total / F.nullif(n, F.lit(0))
    var = F.when(around < 0, 0.0).otherwise(around) / F.nullif(n - less, F.lit(0))
    return F.sqrt(var) if root else var


def _pane(ts: str, width: int) -> Column:
    return F.floor(durations.since_epoch(ts) / F.lit(width)).cast("bigint")


def hop(df: DataFrame, ts: str, slide: str, size: str, by: Sequence[str], aggregates: Aggregates) -> DataFrame:
    """Sliding windows with a row in them: ``window_start``, ``window_end``, keys, aggregates. Rows without a time are in none."""
    step, whole = durations.micros(slide), durations.micros(size)
    if df.isStreaming:
        return _stream(df, ts, F.window("pane", size, slide), f"{math.gcd(step, whole)} microseconds", by, aggregates)
    width = math.gcd(step, whole)
    n = whole // width
    kind = df.schema[ts].dataType.simpleString()
    rows = df.where(F.col(ts).isNotNull()).withColumn("_p", _pane(ts, width))
    dense = _dense(_panes(rows, [*by], aggregates), by, F.col("_p") + (n - 1))
    frame = Window.partitionBy(*by).orderBy("_p").rangeBetween(-(n - 1), 0)
    first = (F.col("_p") - (n - 1)) * width
    out = _windows(dense, by, aggregates, frame).where(F.pmod(first, F.lit(step)) == 0)
    exact = {a: c for a, (k, c) in aggregates.items() if k == "distinct"}
    for name, column in exact.items():
        out = _with_distinct(out, rows, by, name, column, n)
    return out.select(durations.at_micros(first, kind).alias("window_start"), durations.at_micros(first + whole, kind).alias("window_end"), *by, *aggregates)


def cumulate(df: DataFrame, ts: str, step: str, max_size: str, by: Sequence[str], aggregates: Aggregates) -> DataFrame:
    """Windows that share a start and grow by ``step`` up to ``max_size``, from the first step with a row on."""
    width, whole = durations.micros(step), durations.micros(max_size)
    if whole % width:
        raise ValueError("the maximal size must be a multiple of the step")
    steps = whole // width
    if df.isStreaming:
        return _stream_cumulate(df, ts, step, max_size, by, aggregates)
    kind = df.schema[ts].dataType.simpleString()
    rows = df.where(F.col(ts).isNotNull()).withColumn("_p", _pane(ts, width)).withColumn("_w", F.floor(F.col("_p") / steps).cast("bigint"))
    keys = [*by, "_w"]
    dense = _dense(_panes(rows, keys, aggregates), keys, F.col("_w") * steps + (steps - 1))
    frame = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _windows(dense, keys, aggregates, frame)
    exact = {a: c for a, (k, c) in aggregates.items() if k == "distinct"}
    for name, column in exact.items():
        # a value counts from the first step that has it on
        seen = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.min("_p").alias("_p")).groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_d"))
        out = _summed(out, seen, keys, name)
    start = F.col("_w") * whole
    return out.select(durations.at_micros(start, kind).alias("window_start"), durations.at_micros((F.col("_p") + 1) * width, kind).alias("window_end"), *by, *aggregates)


def _panes(rows: DataFrame, keys: Sequence[str], aggregates: Aggregates) -> DataFrame:
    return rows.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in partials(aggregates).items()])


def _dense(panes: DataFrame, keys: Sequence[str], upto: Column) -> DataFrame:
    """Panes and the empty places after them where a window ends that still holds them: as many rows as there are windows."""
    after = F.lead("_p").over(Window.partitionBy(*keys).orderBy("_p"))
    ends = panes.withColumn("_end", F.least(F.coalesce(after - 1, upto), upto))
    own = [c for c in panes.columns if c not in (*keys, "_p")]
    spread = ends.withColumn("_at", F.explode(F.sequence("_p", "_end")))
    return spread.select(*keys, F.col("_at").alias("_p"), *[F.when(F.col("_at") == F.col("_p"), F.col(c)).alias(c) for c in own])


def _windows(dense: DataFrame, keys: Sequence[str], aggregates: Aggregates, frame) -> DataFrame:
    shifts = {name: F.avg(f"_m_{name}").over(Window.partitionBy(*keys)) for name, (kind, _) in aggregates.items() if kind in SPREAD}
    ready = dense.withColumns({f"_c_{n}": c for n, c in shifts.items()}) if shifts else dense
    values = [merged(n, kind, lambda a: a.over(frame), F.col(f"_c_{n}") if kind in SPREAD else None).alias(n)
              for n, (kind, _) in aggregates.items() if kind != "distinct"]
    return ready.select(*keys, "_p", *values)


def _with_distinct(out: DataFrame, rows: DataFrame, by: Sequence[str], name: str, column: str, n: int) -> DataFrame:
    """Exact distinct counts of sliding windows: a value is counted by the windows that end from its pane on, up to ``n - 1`` panes later.

    Each pane of a value adds one where its stretch of windows begins, unless the pane before still covers them, and takes it back where
    the stretch ends, so the sum up to a window is its count.
    """
    each = rows.where(F.col(column).isNotNull()).select(*by, column, "_p").distinct()
    w = Window.partitionBy(*by, column).orderBy("_p")
    near = each.withColumns({"_before": F.lag("_p").over(w), "_after": F.lead("_p").over(w)})
    opens = F.when(F.col("_before").isNull() | (F.col("_p") - F.col("_before") > n - 1), F.struct(F.col("_p").alias("_p"), F.lit(1).alias("_d")))
    closes = F.when(F.col("_after").isNull() | (F.col("_after") - F.col("_p") > n - 1), F.struct((F.col("_p") + n).alias("_p"), F.lit(-1).alias("_d")))
    marks = near.select(*by, F.explode(F.filter(F.array(opens, closes), lambda m: m.isNotNull())).alias("_k")).select(*by, "_k.*")
    return _summed(out, marks.groupBy(*by, "_p").agg(F.sum("_d").alias("_d")), by, name)


def _summed(out: DataFrame, changes: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add the running sum of ``_d`` of each key at the rows of ``out``."""
    both = out.withColumn("_own", F.lit(True)).unionByName(changes.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("_p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.coalesce(F.sum("_d").over(upto), F.lit(0)).cast("bigint")).where("_own").drop("_own", "_d")


def _stream_panes(df: DataFrame, ts: str, width: str, by: Sequence[str], aggregates: Aggregates) -> DataFrame:
    if any(kind == "distinct" for kind, _ in aggregates.values()):
        raise ValueError("exact distinct counts over panes need a table; on streams use approx_distinct")
    return df.groupBy(F.window(ts, width).alias("pane"), *by).agg(*[c.alias(n) for n, c in partials(aggregates).items()])


def _stream(df: DataFrame, ts: str, window: Column, width: str, by: Sequence[str], aggregates: Aggregates) -> DataFrame:
    panes = _stream_panes(df, ts, width, by, aggregates)
    sums = {f"{n}": merged(n, kind, lambda a: a) for n, (kind, _) in aggregates.items()}
    out = panes.groupBy(window.alias("window"), *by).agg(*[c.alias(n) for n, c in sums.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *aggregates)


def _stream_cumulate(df: DataFrame, ts: str, step: str, max_size: str, by: Sequence[str], aggregates: Aggregates) -> DataFrame:
    width, whole = durations.micros(step), durations.micros(max_size)
    panes = _stream_panes(df, ts, step, by, aggregates)
    at = F.floor(F.pmod(durations.since_epoch(F.col("pane.start")), F.lit(whole)) / width) + 1
    grown = panes.withColumn("_k", F.explode(F.sequence(at.cast("int"), F.lit(whole // width))))
    sums = {n: merged(n, kind, lambda a: a) for n, (kind, _) in aggregates.items()}
    out = grown.groupBy(F.window("pane", max_size).alias("window"), "_k", *by).agg(*[c.alias(n) for n, c in sums.items()])
    end = F.col("window.start") + F.make_dt_interval(secs=(F.col("_k").cast("bigint") * F.lit(width) / F.lit(1_000_000)).cast("decimal(18,6)"))
    return out.select(F.col("window.start").alias("window_start"), end.alias("window_end"), *by, *aggregates)
