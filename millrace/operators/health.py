"""Stream health over a table of progress metrics, many queries at once.

Metrics: ``query, operator, ts, kind (source/process/sink), rows_in, rows_out, backpressure, busy, idle``
(percent), ``watermark, late, checkpoint_ms``; one row per operator and snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace import durations
from millrace.operators import keyed, over

# Severity bands by back-pressure percent, lag bands in seconds, finding limits.
SEVERITY = ((5, "none"), (25, "low"), (60, "medium"), (85, "high"))
LAG_BANDS = ((5, "green"), (30, "yellow"))
SLOW_CHECKPOINT_MS = 30_000
LOW_RATIO, BUSY_ROWS = 0.3, 100
IDLE_SOURCE = 80
MANY_LATE = 100


def severity(backpressure: Column) -> Column:
    chain = F
    for bound, label in SEVERITY:
        chain = chain.when(backpressure < bound, F.lit(label))
    return chain.otherwise(F.lit("critical"))


def bottlenecks(metrics: DataFrame, snapshot: Sequence[str] = ("query", "ts")) -> DataFrame:
    """Per snapshot the operator past the sources with most back-pressure (first by name on ties)."""
    counted = (F.col("kind") != "source") & (F.col("backpressure") > 0)
    worst = F.min_by(F.struct("operator", "kind", "backpressure", "rows_in", "rows_out"),
                     F.when(counted, F.struct(-F.col("backpressure"), "operator")))
    out = metrics.groupBy(*snapshot).agg(worst.alias("b"))
    bp = F.coalesce(F.col("b.backpressure"), F.lit(0.0))
    return out.select(*snapshot, F.col("b.operator").alias("bottleneck"), F.col("b.kind").alias("bottleneck_kind"),
                      F.round(bp).cast("int").alias("severity_score"), severity(bp).alias("severity"),
                      F.col("b.rows_in").alias("rows_in"), F.col("b.rows_out").alias("rows_out"))


def findings(metrics: DataFrame, snapshot: Sequence[str] = ("query", "ts")) -> DataFrame:
    """Findings per snapshot and operator: level and title. Quiet snapshots only report checkpoints."""
    worst = bottlenecks(metrics, snapshot).select(*snapshot, "bottleneck", "severity")
    m = metrics.join(worst, list(snapshot))
    troubled = F.col("severity") != "none"
    here = troubled & (F.col("operator") == F.col("bottleneck"))
    ratio = F.when(F.col("rows_in") > 0, F.col("rows_out") / F.col("rows_in")).otherwise(F.lit(1.0))

    def finding(test: Column, level: str, title: str) -> Column:
        return F.when(test, F.struct(F.lit(level).alias("level"), F.lit(title).alias("title")))

    starved = (ratio < LOW_RATIO) & (F.col("rows_in") > BUSY_ROWS)
    sink = F.col("kind") == "sink"
    rules = F.array(
        finding(F.col("checkpoint_ms") > SLOW_CHECKPOINT_MS, "warn", "slow checkpoints"),
        finding(here & sink, "high", "sink bottleneck"),
        finding(here & ~sink & starved, "high", "processing bottleneck"),
        finding(here & ~sink & ~starved, "high", "bottleneck"),
        finding(troubled & (F.col("kind") == "source") & (F.col("idle") > IDLE_SOURCE), "info", "idle source"),
        finding(troubled & (F.col("late") > MANY_LATE), "warn", "late records"))
    found = m.select(*snapshot, "operator", F.explode(F.filter(rules, lambda f: f.isNotNull())).alias("f"))
    return found.select(*snapshot, "operator", "f.level", "f.title")


def watermark_health(metrics: DataFrame, by: Sequence[str], ts: str = "ts", watermark: str = "watermark",
                     stall: str = "10 seconds") -> DataFrame:
    """Lag (seconds), its band, and whether the watermark stood still for longer than ``stall``.

    It advances when one of the four samples before is lower.
    """
    us = durations.since_epoch
    seen = over.rows_frame(metrics.withColumn("_wm", us(watermark)), by, [ts], 4, -1, {"_low": F.min("_wm")})
    moved = seen.withColumn("_moved", F.when(F.col("_wm").isNotNull() & (F.col("_low").isNull() | (F.col("_low") < F.col("_wm"))),
                                             F.col(ts)))
    run = over.running(moved, by, [ts], {"_advanced": ("max", "_moved")})
    lag = F.greatest((us(ts) - F.col("_wm")) / 1_000_000, F.lit(0.0))
    band = F
    for bound, label in LAG_BANDS:
        band = band.when(lag < bound, F.lit(label))
    stalled = F.coalesce((us(ts) - us("_advanced")) > durations.micros(stall), F.lit(False)) & F.col("_wm").isNotNull()
    return run.select(*by, ts, lag.alias("lag_s"), band.when(lag.isNotNull(), F.lit("red")).alias("band"),
                      stalled.alias("stalled"))


def snapshot_at(metrics: DataFrame, by: Sequence[str], at: str, ts: str = "ts") -> DataFrame:
    """Latest row of every operator at a point in time."""
    return keyed.dedup(metrics.where(F.col(ts) <= F.lit(at).cast(metrics.schema[ts].dataType)), by, [ts], "last")


def peaks(metrics: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.max(c).alias("peak_" + c) for c in columns])


def compare_queries(metrics: DataFrame, ts: str, bucket: str, column: str, queries: Sequence, last: int | None = None,
                    name: str = "query") -> DataFrame:
    """Average of a metric per time bucket, one column per query; all buckets, or the newest ``last``."""
    mine = metrics.where(F.col(name).isin(list(queries)))
    per = mine.groupBy(F.window(ts, bucket)["start"].alias("bucket")).pivot(name, list(queries)).agg(F.avg(column))
    named = per.select("bucket", *[F.col(str(q)).alias(f"q_{q}") for q in queries])
    return named.orderBy(F.desc("bucket")).limit(last) if last else named


def run_deltas(runs: DataFrame, by: Sequence[str], order: str, duration: str, rows: str) -> DataFrame:
    """Rows per second of each run and the percent change of its duration to the run before."""
    seen = over.shift(runs, by, [order], {"_before": ("lag", duration, 1)})
    change = (F.col(duration) - F.col("_before")) / F.nullif(F.col("_before"), F.lit(0)) * 100
    return seen.select(*runs.columns, (F.col(rows) / F.nullif(F.col(duration), F.lit(0))).alias("rows_per_s"),
                       change.alias("delta_pct"))
