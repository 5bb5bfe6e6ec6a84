"""Windows over several sources of which one may fall silent.

Spark's watermark is the least of all sources', so a silent one holds back every window. Here each key follows its sources itself: its time is the least
event time reached by those that are not idle, and a source is idle once it sent the key nothing for ``timeout`` of processing time. Timers of
processing time wake the key when that happens. State of a key: its sources and its open windows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from millrace import durations

KINDS = ("count", "sum", "min", "max", "avg")


class _Windows(StatefulProcessor):
    def __init__(self, keys: Sequence[str], sources: Sequence[str], kinds: Sequence[str], size: int, delay: int, timeout_ms: int):
        self.keys, self.sources, self.kinds = list(keys), list(sources), list(kinds)
        self.size, self.delay, self.timeout_ms = size, delay, timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        fields = ", ".join(f"n{k} BIGINT, s{k} DOUBLE, lo{k} DOUBLE, hi{k} DOUBLE" for k in range(len(self.kinds)))
        self.seen = handle.getMapState("sources", "name STRING", "us BIGINT, ms BIGINT")
        self.open = handle.getMapState("windows", "start BIGINT", fields)
        self.closed = handle.getValueState("closed", "us BIGINT")
        self.timer = handle.getValueState("timer", "ms BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.seen.containsKey((self.sources[0],)):
            for name in self.sources:  # a source that never sent anything is waited for, too
                self.seen.updateValue((name,), (None, now))
        closed = self.closed.get()[0] if self.closed.exists() else None
        parts: dict[int, list] = {}
        for pdf in rows:
            for name, of in pdf.groupby("source_"):
                last = self.seen.getValue((name,))[0]
                top = int(of["us_"].max())
                self.seen.updateValue((name,), (top if last is None else max(last, top), now))
            starts = pdf["us_"] // self.size * self.size
            for start, of in pdf.groupby(starts):
                start = int(start)
                if closed is not None and start + self.size <= closed:
                    continue  # late
                held = parts.get(start) or (list(self.open.getValue((start,))) if self.open.containsKey((start,)) else [0, None, None, None] * len(self.kinds))
                for k in range(len(self.kinds)):
                    values = of[f"v{k}_"].dropna()
                    if len(values):
                        n, s, lo, hi = held[4 * k:4 * k + 4]
                        more = float(values.sum()), float(values.min()), float(values.max())
                        held[4 * k:4 * k + 4] = [n + len(values), more[0] if s is None else s + more[0], more[1] if lo is None else min(lo, more[1]),
                                                 more[2] if hi is None else max(hi, more[2])]
                parts[start] = held
        for start, held in parts.items():
            self.open.updateValue((start,), tuple(held))
        return self._ended(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        return self._ended(key, timerValues.getCurrentProcessingTimeInMs())

    def _ended(self, key, now: int):
        seen = [tuple(v) for _, v in self.seen.iterator()]
        awake = [(us, ms) for us, ms in seen if now - ms < self.timeout_ms]
        reached = [us for us, _ in awake]
        if not awake:  # nobody can hold back: all that was sent is taken as complete
            passed = max(us for us, _ in seen if us is not None)
        else:
            passed = None if None in reached else min(reached)
            self._wake(min(ms for _, ms in awake) + self.timeout_ms)
        if passed is None:
            return iter([])
        passed -= self.delay
        if self.closed.exists():
            passed = max(passed, self.closed.get()[0])
        self.closed.update((passed,))
        done = sorted((start, tuple(held)) for (start,), held in self.open.iterator() if start + self.size <= passed)
        out = []
        for start, held in done:
            self.open.removeKey((start,))
            row = []
            for k, kind in enumerate(self.kinds):
                n, s, lo, hi = held[4 * k:4 * k + 4]
                row.append({"count": float(n), "sum": s, "min": lo, "max": hi, "avg": s / n if n else None}[kind])
            out.append((start, start + self.size, *row))
        if not out:
            return iter([])
        names = ["start_", "end_", *[f"v{k}_" for k in range(len(self.kinds))]]
        frame = pd.DataFrame(out, columns=names).astype(object).where(lambda f: f.notna(), None)
        for k, v in zip(self.keys, key):
            frame[k] = v
        return iter([frame[[*self.keys, *names]]])

    def _wake(self, ms: int) -> None:
        if self.timer.exists():
            now = self.timer.get()[0]
            if now <= ms:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def close(self) -> None:
        pass


def tumble(streams: dict[str, DataFrame], ts: str, size: str, by: Sequence[str], aggregates: dict[str, tuple[str, str | None]], timeout: str,
           delay: str = "0 seconds") -> DataFrame:
    """Tumbling windows over several streams, not held back by a silent one: ``window_start``, ``window_end``, keys, aggregates.

    ``aggregates``: name to (kind, numeric column); kinds count (column None counts rows), sum, min, max, avg. A window ends once every source that
    sent the key something within ``timeout`` has sent an event ``delay`` past its end; if all are silent, once the newest event is that far. Rows for ended windows
    are late and dropped. Rows without a time are left out. Results are doubles, counts bigint.
    """
    unknown = {kind for kind, _ in aggregates.values()} - set(KINDS)
    if unknown or not by or not streams:
        raise ValueError(f"unknown aggregates {sorted(unknown)}" if unknown else "windows need keys and streams")
    whole = None
    for name, df in streams.items():
        values = [(F.lit(1.0) if c is None else F.col(c).cast("double")).alias(f"v{k}_") for k, (_, c) in enumerate(aggregates.values())]
        part = df.where(F.col(ts).isNotNull()).select(*by, F.lit(name).alias("source_"), durations.since_epoch(ts).alias("us_"), *values)
        whole = part if whole is None else whole.unionByName(part)
    first = next(iter(streams.values()))
    schema = T.StructType([*[first.schema[k] for k in by], T.StructField("start_", T.LongType()), T.StructField("end_", T.LongType()),
                           *[T.StructField(f"v{k}_", T.DoubleType()) for k in range(len(aggregates))]])
    kinds = [kind for kind, _ in aggregates.values()]
    processor = _Windows(by, list(streams), kinds, durations.micros(size), durations.micros(delay), durations.micros(timeout) // 1000)
    out = whole.groupBy(*by).transformWithStateInPandas(processor, schema, "append", "ProcessingTime")
    kind = first.schema[ts].dataType.simpleString()
    added = [(F.col(f"v{k}_").cast("bigint") if how == "count" else F.col(f"v{k}_")).alias(n) for k, (n, (how, _)) in enumerate(aggregates.items())]
    return out.select(durations.at_micros(F.col("start_"), kind).alias("window_start"), durations.at_micros(F.col("end_"), kind).alias("window_end"), *by, *added)
