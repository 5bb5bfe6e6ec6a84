"""OVER-window functions per key: ranks, shifts, running values and frames.

Keys that hold a large share of the rows are cut into ranges with borders from a sample (``ranges``); a scan over one summary for each
range carries on what the rows after it need. Without such keys the plan is one scan, one shuffle and one window. ``parts`` is
the number of ranges that the whole table would be cut into (see ``ranges.cut``). Rows that are equal in ``order`` (peers) stay in one
range; where their order is free (row_number, ntile, LAG, LEAD, ROWS frames) a hash of the row parts them too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.operators import ranges, slices as sl

RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
FREE = {"row_number", "ntile"}


def whole(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*sl.order_columns(order))


def cut_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None) -> tuple[DataFrame | None, list[str]]:
    """Ranges of rows whose peers may stand in any order, and the order with a hash of the row as its last column."""
    hashed = df.withColumn("_tie", F.xxhash64(*[f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]))
    return ranges.cut(hashed, by, [*order, "_tie"], parts), [*order, "_tie"]


def rank_over(df: DataFrame, by: Sequence[str], order: Sequence[str], functions: dict[str, str], parts: int | None = None) -> DataFrame:
    """Add numbering columns, e.g. ``{"rn": "row_number", "q": "ntile(4)"}``.

    Functions: row_number, rank, dense_rank, percent_rank, cume_dist, ntile(n).
    """
    names = [f.split("(")[0] for f in functions.values()]
    unknown = set(names) - set(RANKS)
    if unknown:
        raise ValueError(f"not a numbering function: {sorted(unknown)}")
    if set(names) <= FREE:
        c, sort = cut_rows(df, by, order, parts)
    else:
        c, sort = ranges.cut(df, by, order, parts), order
    if c is None:
        w = whole(by, order)
        plain = {n: F.ntile(int(f.split("(")[1].rstrip(") "))) if f.startswith("ntile") else getattr(F, f.split("(")[0])() for n, f in functions.items()}
        doubles = ("percent_rank", "cume_dist")
        return df.withColumns({n: p.over(w) if functions[n] in doubles else p.over(w).cast("long") for n, p in plain.items()})
    aggregates, combine = {"_c": F.count(F.lit(1))}, {"before": F.sum("_c")}
    if "dense_rank" in names:
        keys = [F.col(o.lstrip("-")) for o in order]
        aggregates["_d"] = F.count_distinct(F.struct(*keys))
        combine["dbefore"] = F.sum("_d")
    w = sl.slice_window(by, *sl.order_columns(sort))
    local = {"_before": F.coalesce(sl.past("before", w), F.lit(0)),
             "_extra": F.count_if(F.col("_data") == 0).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    if {"row_number", "ntile"} & set(names):
        local["_rn"] = F.row_number().over(w)
    if {"rank", "percent_rank"} & set(names):
        local["_rk"] = F.rank().over(w)
    if "dense_rank" in names:
        local["_dr"] = F.dense_rank().over(w)
        local["_dbefore"] = F.coalesce(sl.past("dbefore", w), F.lit(0))
    if "cume_dist" in names:
        local["_le"] = F.sum("_data").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    totals = {"percent_rank", "cume_dist", "ntile"} & set(names)
    if totals:
        local["_tn"] = F.sum("_data").over(Window.partitionBy(*by, sl.SLICE))
    joined = sl.with_prefix(c, c, by, aggregates, combine).withColumns(local).where("_data = 1")
    if totals:
        size = (c.where(sl.HOT).groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
                .select(*[F.col(k).alias("_t_" + k) for k in by], "_all"))
        size = F.broadcast(size)  # one row per busy key
        joined = joined.join(size, sl.same_keys(joined, size, by, "_t_"), "left")
        total = F.coalesce(F.col("_all"), F.col("_tn"))
    before = F.col("_before") - F.col("_extra")  # the added row was numbered too

    def value(spec: str) -> Column:
        name = spec.split("(")[0]
        if name == "row_number":
            return (F.col("_rn") + before).cast("long")
        if name == "rank":
            return (F.col("_rk") + before).cast("long")
        if name == "dense_rank":
            return (F.col("_dr") - F.col("_extra") + F.col("_dbefore")).cast("long")
        if name == "percent_rank":
            return F.when(total > 1, (F.col("_rk") + before - 1) / (total - 1)).otherwise(F.lit(0.0))
        if name == "cume_dist":
            return (F.col("_le") + F.col("_before")) / total
        n = int(spec.split("(")[1].rstrip(") "))
        at, small = F.col("_rn") + before - 1, F.floor(total / n)
        extra = total % n
        big = extra * (small + 1)  # the first `extra` buckets hold one row more
        return (F.when(at < big, F.floor(at / (small + 1)))
                .otherwise(extra + F.floor((at - big) / F.greatest(small, F.lit(1)))) + 1).cast("long")

    return joined.select(*[F.col(x) for x in df.columns],
                         *[value(s).alias(n) for n, s in functions.items()])


def shift(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, tuple], parts: int | None = None) -> DataFrame:
    """LAG / LEAD: ``{"prev": ("lag", "value", 1, None)}`` - kind, column, offset, default."""
    before = max([s[2] for s in columns.values() if s[0] == "lag"], default=0)
    after = max([s[2] for s in columns.values() if s[0] == "lead"], default=0)
    c, sort = cut_rows(df, by, order, parts)
    full = df.withColumn("_own", F.lit(True)) if c is None else sl.with_edge_rows(c, by, sort, before, after)
    w = whole(by, order) if c is None else whole([*by, sl.SLICE], sort)
    added = {}
    for name, spec in columns.items():
        kind, column, offset = spec[:3]
        default = spec[3] if len(spec) > 3 else None
        added[name] = getattr(F, kind)(column, offset, default).over(w)
    return (full.withColumns(added).where("_own")
            .select(*df.columns, *columns))


def rows_frame(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int,
               aggregates: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Aggregates over ``ROWS BETWEEN before PRECEDING AND after FOLLOWING``.

    A negative ``after`` ends the frame before the current row.
    """
    c, sort = cut_rows(df, by, order, parts)
    full = df.withColumn("_own", F.lit(True)) if c is None else sl.with_edge_rows(c, by, sort, before, max(after, 0))
    w = (whole(by, order) if c is None else whole([*by, sl.SLICE], sort)).rowsBetween(-before, after)
    added = {n: a.over(w) for n, a in aggregates.items()}
    return full.withColumns(added).where("_own").select(*df.columns, *aggregates)


def time_range(df: DataFrame, by: Sequence[str], ts: str, reach: str,
               aggregates: dict[str, Column], slice_width: str = "1 hour",
               hot_rows: int = sl.HOT_ROWS) -> DataFrame:
    """Aggregates over ``RANGE BETWEEN INTERVAL reach PRECEDING AND CURRENT ROW``."""
    from millrace import durations
    full = sl.with_time_halo(df, by, ts, slice_width, reach, backward=True, hot_rows=hot_rows)
    full = full.withColumn("_at", durations.since_epoch(ts))
    w = (Window.partitionBy(*by, sl.SLICE).orderBy("_at")
         .rangeBetween(-durations.micros(reach), Window.currentRow))
    added = {n: a.over(w) for n, a in aggregates.items()}
    return full.withColumns(added).where("_own").select(*df.columns, *aggregates)


_RUNNING = {
    "sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max),
}


def running(df: DataFrame, by: Sequence[str], order: Sequence[str],
            aggregates: dict[str, tuple[str, str]], parts: int | None = None) -> DataFrame:
    """Running ``{"total": ("sum", "value")}``; peers of the current row are included.

    Kinds: sum, count, min, max, avg.
    """
    c = ranges.cut(df, by, order, parts)
    if c is None:
        frame = whole(by, order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: getattr(F, kind)(column).over(frame) for n, (kind, column) in aggregates.items()})
    w = sl.slice_window(by, *sl.order_columns(order))
    frame = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    parts: dict[str, tuple[str, str]] = {}
    for name, (kind, column) in aggregates.items():
        for part in (("sum", "count") if kind == "avg" else (kind,)):
            parts[f"_{part}_{name}"] = (part, column)
    full = sl.with_prefix(c, c, by, {"c" + n: _RUNNING[k][0](col) for n, (k, col) in parts.items()},
                          {"p" + n: _RUNNING[k][1]("c" + n) for n, (k, _) in parts.items()})
    here = {n: _RUNNING[k][0](F.when(F.col("_data") == 1, F.col(col))).over(frame) for n, (k, col) in parts.items()}
    before = {"p" + n: sl.past("p" + n, w) for n in parts}
    joined = full.withColumns({**here, **before}).where("_data = 1")

    def merged(n: str) -> Column:
        kind, here, past = parts[n][0], F.col(n), F.col("p" + n)
        if kind in ("sum", "count"):
            return F.coalesce(here + past, here, past)
        return F.least(here, past) if kind == "min" else F.greatest(here, past)

    out = []
    for name, (kind, _) in aggregates.items():
        if kind == "avg":
            value = F.try_divide(merged(f"_sum_{name}"), merged(f"_count_{name}"))
        else:
            value = merged(f"_{kind}_{name}")
        out.append(value.alias(name))
    return joined.select(*[F.col(x) for x in df.columns], *out)


def last_values(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, str],
                tie: Sequence[str] = ()) -> DataFrame:
    """LAST_VALUE with the default frame: ``{"last": "value"}`` of the last peer along ``tie``.

    Peers (rows equal in ``order``) are aggregated first and joined back, so a busy key is spread by its order values.
    """
    names = [o.lstrip("-") for o in order]
    last = df.groupBy(*by, *names).agg(*[F.max_by(c, F.struct(*(tie or names))).alias("_v_" + a) for a, c in columns.items()])
    named = last.select(*[F.col(k).alias("_k_" + k) for k in [*by, *names]], *["_v_" + a for a in columns])
    joined = df.join(named, sl.same_keys(df, named, [*by, *names], "_k_"), "left")
    return joined.select(*[df[c] for c in df.columns], *[F.col("_v_" + a).alias(a) for a in columns])


def nth_values(df: DataFrame, by: Sequence[str], order: Sequence[str],
               columns: dict[str, tuple[str, int]], tie: Sequence[str] = ()) -> DataFrame:
    """FIRST_VALUE (n = 1) and NTH_VALUE with the default frame: ``{"second": ("value", 2)}``.

    The frame ends with the last peer of the row. ``tie`` orders peers among themselves and must make the order unique within a key
    (or ``order`` itself must be). Only the first n rows of each key are looked up, so the ranking stays small
    even for a busy key; rows whose frame ends before the nth row get NULL.
    """
    deepest = max(n for _, n in columns.values())
    names = [o.lstrip("-") for o in order]
    w = whole(by, [*order, *tie])
    heads = (df.select(*dict.fromkeys([*by, *names, *[t.lstrip("-") for t in tie], *[c for c, _ in columns.values()]]))
             .withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= deepest))
    picks = [F.max(F.when(F.col("_place") == n,
                          F.struct(F.struct(*names).alias("at"), F.col(c).alias("v")))).alias("_v_" + a)
             for a, (c, n) in columns.items()]
    per_key = heads.groupBy(*by).agg(*picks).select(
        *[F.col(k).alias("_k_" + k) for k in by], *["_v_" + a for a in columns])
    joined = df.join(per_key, sl.same_keys(df, per_key, by, "_k_"), "left")

    def reached(alias: str) -> Column:
        test = F.lit(True)
        for o in reversed(order):
            name = o.lstrip("-")
            mark, here = F.col(f"_v_{alias}.at.{name}"), df[name]
            after = here < mark if o.startswith("-") else here > mark
            test = after | (here.eqNullSafe(mark) & test)
        return test

    return joined.select(*[df[c] for c in df.columns],
                         *[F.when(reached(a), F.col(f"_v_{a}.v")).alias(a) for a in columns])
