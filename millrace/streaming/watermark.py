"""Watermarks and progress metrics of streams."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

STRATEGIES = ("bounded_out_of_order", "ascending", "ascending_timestamps", "none", "no_watermarks")


def assign(df: DataFrame, ts: str, delay: str = "5 seconds", strategy: str = "bounded_out_of_order") -> DataFrame:
    """Watermark on ``ts``; a column without zone becomes one with zone (UTC session), as streams need it."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown watermark strategy {strategy!r}; one of {STRATEGIES}")
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    elif isinstance(df.schema[ts].dataType, (T.LongType, T.IntegerType)):
        df = df.withColumn(ts, F.timestamp_millis(ts))
    if strategy in ("none", "no_watermarks") or not df.isStreaming:
        return df
    return df.withWatermark(ts, "0 seconds" if strategy.startswith("ascending") else delay)


METRICS = ("query STRING, operator STRING, ts TIMESTAMP, kind STRING, rows_in DOUBLE, rows_out DOUBLE, rows_per_s DOUBLE,"
           " backpressure DOUBLE, busy DOUBLE, idle DOUBLE, batch_ms BIGINT, watermark TIMESTAMP, late BIGINT, state_rows BIGINT,"
           " checkpoint_ms BIGINT")


def progress_rows(progress) -> list[tuple]:
    """A row for each source, each stateful operator and the sink of a progress event, as the health jobs take them.

    A source's rows are what it handed out. Back-pressure is the percent by which processing fell behind the input's rate, and
    belongs to all operators of the query. A batch without rows is idle time. Late rows, state and commit times are of the
    stateful operators; the commit of a query without any is that of its log.
    """
    def when(text):
        import datetime
        return datetime.datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None

    at, mark = when(progress.timestamp), when(dict(progress.eventTime).get("watermark"))
    spent = dict(progress.durationMs)
    taken, batch_ms, name = float(progress.numInputRows), int(spent.get("triggerExecution", 0)), progress.name or str(progress.id)
    arriving, handled = float(progress.inputRowsPerSecond or 0), float(progress.processedRowsPerSecond or 0)
    behind = 100 * (1 - handled / arriving) if arriving > handled > 0 else 0.0
    idle = 0.0 if taken else 100.0
    ops = progress.stateOperators or []

    def row(operator, kind, rows_in, rows_out, late=0, kept=0, commit=0):
        return name, operator, at, kind, rows_in, rows_out, handled, behind, 100 - idle, idle, batch_ms, mark, late, kept, commit

    out = [row(f"source {i}", "source", 0.0, float(s.numInputRows)) for i, s in enumerate(progress.sources)]
    out += [row(f"{i}:{o.operatorName}", "process", taken, float(o.numRowsUpdated), o.numRowsDroppedByWatermark, o.numRowsTotal, o.commitTimeMs)
            for i, o in enumerate(ops)]
    written = progress.sink.numOutputRows if progress.sink is not None else -1
    return [*out, row("sink", "sink", float(written if written >= 0 else taken), 0.0, commit=0 if ops else int(spent.get("walCommit", 0)))]


class ProgressRecorder(StreamingQueryListener):
    """Gathers progress of all queries and appends it as files, the input of the health jobs.

    Files are written when ``every`` seconds have passed since the last one, and when a query ends.
    """

    def __init__(self, spark: SparkSession, path: str, every: float = 60.0):
        self.spark, self.path, self.every = spark, path, every
        self.rows: list[tuple] = []
        self.last = time.monotonic()

    def flush(self) -> None:
        rows, self.rows, self.last = self.rows, [], time.monotonic()
        if rows:
            self.spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += progress_rows(event.progress)
        if time.monotonic() - self.last >= self.every:
            self.flush()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.flush()
