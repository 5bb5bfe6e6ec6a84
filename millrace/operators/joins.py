"""Joins: regular, interval, as-of (temporal) and lookup."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace import durations
from millrace.operators import slices as sl
from millrace.session import plan_bytes

BROADCAST_LIMIT = 64 * 1024 * 1024
#: Band joins: as many pairs are looked at in the time that one more row of a shuffle takes; cells in which one band is filed, at most.
ROW_PAIRS, MOST_CELLS = 64, 2 ** 17


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast hint only while Catalyst's size estimate is below ``limit``.

    Above it the join is left to Spark: a shuffled join, with AQE splitting busy keys.
    """
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def regular_join(left: DataFrame, right: DataFrame, on: Column | Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, on, how)


def lookup_join(df: DataFrame, dim: DataFrame, on: Sequence[str], columns: Sequence[str],
                how: str = "left", limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Add ``columns`` of a dimension table; the stream (or table) may be unbounded."""
    side = broadcast_if_small(dim.select(*on, *columns), limit)
    return df.join(side, list(on), how)


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str,
                  lower: str, upper: str, how: str = "inner") -> DataFrame:
    """Pairs with equal keys and ``right_ts BETWEEN left_ts + lower AND left_ts + upper``.

    ``lower`` is usually negative ("-5 minutes"). ``how``: inner, left or right. Key columns are kept
    once; all other column names must differ. For bounded tables time is cut into buckets as wide as
    the interval: the preserved side lies in one bucket, the other side in the two or so it may
    meet, so a busy key is spread over time and only near rows are compared.
    """
    lo, hi = durations.micros(lower), durations.micros(upper)
    if hi < lo:
        raise ValueError("upper bound before lower bound")
    if how not in ("inner", "left", "right"):
        raise ValueError(f"unsupported interval join: {how}")
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"rename right columns {sorted(clash)}")
    r = right.select(*[F.col(k).alias("_r_" + k) for k in on],
                     *[c for c in right.columns if c not in on])
    in_time = (F.col(right_ts) >= F.col(left_ts) + durations.interval(lower)) & \
              (F.col(right_ts) <= F.col(left_ts) + durations.interval(upper))
    keys = [F.col(k) == F.col("_r_" + k) for k in on]
    left_out = left
    if not (left.isStreaming or right.isStreaming):
        width = max(hi - lo, 1_000_000)
        lt, rt = durations.since_epoch(left_ts), durations.since_epoch(right_ts)

        def bucket(us: Column) -> Column:
            return F.floor(us / F.lit(width))

        def near(first: Column, last: Column, t: str) -> Column:
            # rows without a time stay in the table and match nothing
            return F.explode_outer(F.when(F.col(t).isNotNull(), F.sequence(bucket(first), bucket(last))))

        if how == "right":
            left_out = left.withColumn("_lb", near(lt + lo, lt + hi, left_ts)).where(F.col("_lb").isNotNull())
            r = r.withColumn("_rb", bucket(rt))
        else:
            left_out = left.withColumn("_lb", bucket(lt))
            r = r.withColumn("_rb", near(rt - hi, rt - lo, right_ts)).where(F.col("_rb").isNotNull())
        keys.append(F.col("_lb") == F.col("_rb"))
    condition = in_time
    for k in keys:
        condition = k & condition
    joined = left_out.join(r, condition, how)
    key_side = "_r_" if how == "right" else ""
    return joined.select(*[F.col(key_side + k).alias(k) for k in on],
                         *[F.col(c) for c in left.columns if c not in on],
                         *[F.col(c) for c in right.columns if c not in on])


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              how: str = "inner", ttl: str | None = None, slice_width: str = "1 hour",
              hot_rows: int = sl.HOT_ROWS) -> DataFrame:
    """Each left row with the latest right version valid at its time (``right_ts <= left_ts``).

    ``how="left"`` keeps left rows without a version; ``ttl`` rejects versions older than that. Rows
    with a NULL key or time match nothing. Both sides are merged into one ordered table per key and the
    last version is carried forward; busy keys are cut into time slices. Versions must be unique per
    key and time; of equal times the greatest row is taken.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported as-of join: {how}")
    versions = [c for c in right.columns if c not in by]
    clash = set(versions) & set(left.columns)
    if clash:
        raise ValueError(f"rename right columns {sorted(clash)}")
    version = F.struct(*versions)
    keys = [F.col(k) for k in by]
    rows = F.struct(*[F.col(c).alias(c) for c in left.columns if c not in by])
    l = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), rows.alias("_row"),
                    F.lit(None).cast(right.select(version.alias("v")).schema["v"].dataType).alias("_v"))
    known = F.col(right_ts).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    r = right.where(known).select(
        *keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
        F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), version.alias("_v"))
    c = sl.cut(l.unionByName(r), by, ["_t", "_side"], slice_width, hot_rows)
    at_version = F.when(F.col("_side") == 0, F.struct("_t", "_v"))
    full = sl.with_prefix(c, c, by, {"_lastv": F.max_by("_v", at_version)}, {"v": F.last("_lastv", ignorenulls=True)})
    w = sl.slice_window(by, "_t", "_side", "_v")
    here = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (full.withColumns({"_here": here, "_before": sl.past("v", w)}).where("_data = 1 AND _side = 1")
             .withColumn("_match", F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_before"))))
    if ttl is not None:
        age = F.col("_t") - durations.interval(ttl)
        found = found.withColumn("_match", F.when(F.col("_match." + right_ts) >= age, F.col("_match")))
    if how == "inner":
        found = found.where(F.col("_match").isNotNull())
    restored = [F.col(c) if c in by else F.col("_row." + c).alias(c) for c in left.columns]
    return found.select(*restored, *[F.col("_match." + v).alias(v) for v in versions])


def _share(edges: Sequence[float], width: float) -> float:
    """Share of the rows that a stretch of ``width`` holds at most, where as many rows lie between one edge (ascending quantiles) and the next."""
    def below(x: float, find) -> float:
        i = find(edges, x)
        if 0 < i < len(edges):
            return (i - 1 + (x - edges[i - 1]) / (edges[i] - edges[i - 1])) / (len(edges) - 1)
        return float(i > 0)

    return max(max(below(e + width, bisect_right) - below(e, bisect_left), below(e, bisect_right) - below(e - width, bisect_left)) for e in edges)


def _filed(bands: dict[int, int], rows: int, edges: Sequence[float]) -> dict[int, int]:
    """Where the bands of each level (``bands``: how many) are filed, at the least cost.

    Each level in use takes a copy of all ``rows``. A level with few bands is cheaper without: its bands are filed in the wider cells of a level above and
    look at more rows, or in more of the narrower cells of a level below. That these look at fewer rows does not count, or copies of bands would grow faster than the tables.
    """
    own, share = sorted(bands), {k: _share(edges, 2.0 ** k) for k in bands}

    def cost(k: int, at: int) -> float:
        cells = 2 + math.floor(2.0 ** (k - at) / 0.7)
        pairs = rows * min(1.0, cells * share[at] if at > k else 3 * share[k])
        return bands[k] * (cells * ROW_PAIRS + pairs) if cells <= MOST_CELLS else math.inf

    best: list[tuple[float, list[int]]] = [(0, [])]  # least cost of the levels up to one in use, and those in use; the first entry has none, the last one all levels
    for i in range(len(own) + 1):
        here = own[i:i + 1]
        best.append(min((so_far + len(here) * rows * ROW_PAIRS + sum(min((cost(k, at) for at in used[-1:] + here), default=math.inf) for k in own[j:i + 1]), used + here)
                        for j, (so_far, used) in enumerate(best)))
    return {k: min(best[-1][1], key=lambda at: cost(k, at)) for k in own}


def band_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, how: str = "inner", parts: int | None = None) -> DataFrame:
    """Pairs with ``low <= value <= high`` where ``value`` is a column of ``left`` and the bounds are columns of ``right``; no equal key is needed.

    The span of ``value`` is cut into cells at several widths, each the double of the one before. A band is filed at the width next above its own, where it touches
    three cells at most; a row of ``left`` lies in one cell of each width in use, and rows meet on the cell. So the pairs looked at grow with the matches, not
    with the product of the tables. As each width in use copies ``left``, few bands of a width (such as those cut short by an end of the span) are filed at another one.
    A cell that holds more than one in ``parts`` of the rows (by quantiles; by default two for each shuffle partition) is dealt over several tasks. A null bound
    means no bound on that side; a null value, or a band that is empty, matches nothing. ``how``: inner or left. Column names must differ.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported band join: {how}")
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"rename right columns {sorted(clash)}")
    if how == "left":
        # whether a row has a match depends on its value alone
        found = band_join(left, right, value, low, high, "inner", parts)
        matched = found.select(F.col(value).alias("_matched")).distinct()
        alone = left.join(matched, F.col(value) == F.col("_matched"), "left_anti")
        return found.unionByName(alone, allowMissingColumns=True)
    parts = parts or max(64, 2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = lambda df, c: durations.since_epoch(c).cast("double") if df.schema[c].dataType.typeName().startswith(("timestamp", "date")) else F.col(c).cast("double")
    place = number(left, value)
    finite = F.when(F.abs(place) < float("inf"), place)
    seen = left.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.min(finite).alias("a"), F.max(finite).alias("b"), F.count(value).alias("n"),
                    F.percentile_approx(finite, [k / parts for k in range(1, parts)], 10 * parts).alias("q")).first()
    start, stop, borders = (0.0, 0.0, []) if seen.a is None else (seen.a, seen.b, seen.q)
    smallest = math.ceil(math.log2(max((stop - start) / 2 ** 40, 2.0 ** -900)))
    largest = max(smallest, math.ceil(math.log2(max(stop - start, 2.0 ** -900))) + 1)

    def clipped(c: Column) -> Column:
        # keeps the order of values, of which NaN is the greatest
        return F.when(F.isnan(c), stop).otherwise(F.least(F.greatest(c, F.lit(start)), F.lit(stop)))

    def cell(c: Column, level: Column) -> Column:
        return F.floor((clipped(c) - start) / F.pow(F.lit(2.0), level))

    r = right.where((F.col(low).isNull() | F.col(high).isNull() | (F.col(low) <= F.col(high)))
                    & (F.col(low).isNull() | (F.col(low) <= F.lit(seen.most))) & (F.col(high).isNull() | (F.col(high) >= F.lit(seen.least))))
    first, last = F.coalesce(number(right, low), F.lit(start)), F.coalesce(number(right, high), F.lit(stop))
    width = clipped(last) - clipped(first)
    # equal widths differ by rounding, so the border between two levels lies off the powers of two
    level = F.when(width > 0, F.least(F.greatest(F.ceil(F.log2(width * 0.7)), F.lit(smallest)), F.lit(largest))).otherwise(F.lit(smallest)).cast("int")
    r = r.withColumn("_r_level", level)
    filed = _filed({k: n for k, n in r.groupBy("_r_level").count().collect()}, seen.n, [start, *borders, stop])
    levels = sorted(set(filed.values()))
    l = left.where(F.col(value).isNotNull())  # noqa: E741
    if len(levels) == 1:
        # the level stands in no row
        r, r_level, l_level = r.drop("_r_level"), F.lit(levels[0]), F.lit(levels[0])
    else:
        r_level, l_level = F.col("_r_level"), F.col("_level")
        r = r.withColumn("_r_level", F.coalesce(F.lit(None).cast("int"), *[F.when(r_level == k, F.lit(at)) for k, at in filed.items()]))
        l = l.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))  # noqa: E741
    r = r.withColumn("_r_cell", F.explode(F.sequence(cell(first, r_level), cell(last, r_level))))
    l = l.withColumn("_cell", cell(place, l_level))  # noqa: E741
    on = F.col("_cell") == F.col("_r_cell")
    if len(levels) != 1:
        on = on & (l_level == r_level)
    held = {(k, c): n for k in levels for c, n in Counter(math.floor((b - start) / 2.0 ** k) for b in borders).items() if n > 1}
    if held:
        crowded = left.sparkSession.createDataFrame([(k, c, n) for (k, c), n in held.items()], "_b_level int, _b_cell bigint, _places int")
        many = F.coalesce("_places", F.lit(1))
        l = l.join(F.broadcast(crowded), (l_level == F.col("_b_level")) & (F.col("_cell") == F.col("_b_cell")), "left")  # noqa: E741
        l = l.withColumn("_part", F.pmod(F.xxhash64(*left.columns), many).cast("int")).drop("_b_level", "_b_cell", "_places")  # noqa: E741
        r = r.join(F.broadcast(crowded), (r_level == F.col("_b_level")) & (F.col("_r_cell") == F.col("_b_cell")), "left")
        r = r.withColumn("_r_part", F.explode(F.sequence(F.lit(0), many - 1))).drop("_b_level", "_b_cell", "_places")
        on = on & (F.col("_part") == F.col("_r_part"))
    inside = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) <= F.col(high)))
    return l.join(r, on & inside).drop("_level", "_cell", "_part", "_r_level", "_r_cell", "_r_part")
