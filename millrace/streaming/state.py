"""Keyed operators on streams that need event-time order.

Rows wait in state until the watermark passes them and are then handled in event-time order, ties by
arrival. The state of a key holds the waiting rows and what the operator carries from row to row.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from millrace import durations

# timestamps keep their microseconds in the JSON bodies
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
         "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: Groups over which the keys of a stream are dealt. A stream that is started again must find its keys where they were.
GROUPS = 512
#: Values of the state over which a group deals what is carried for its keys.
SLOTS = 16
#: Rows given back at once.
OUT = 10_000

# step(carry, rows) -> (carry, [(left body, right body or None, tag)]); rows are (micros, side, body)
Step = Callable[[object, list[tuple[int, int, str]]], tuple[object, list[tuple]]]


class _Waiting:
    """Rows of a group that wait for the watermark, as Arrow batches: a call to the store moves many rows, and a value holds one batch."""

    def __init__(self, handle, schema: pa.Schema):
        self.schema = schema
        self.batches = handle.getMapState("waiting", "at BIGINT", "rows BINARY")
        self.ends = handle.getValueState("ends", "first BIGINT, last BIGINT")

    def append(self, batches) -> int | None:
        """Take batches in; the earliest time in them."""
        first, last = self.ends.get() or (0, 0)
        least, at = None, last
        for batch in batches:
            if batch.num_rows:
                early = pa.compute.min(batch.column("us_")).as_py()
                least = early if least is None else min(least, early)
                self.batches.updateValue((at,), (batch.serialize().to_pybytes(),))
                at += 1
        if at > last:
            self.ends.update((first, at))
        return least

    def frames(self, frames) -> int | None:
        return self.append(pa.RecordBatch.from_pandas(f[self.schema.names], self.schema, preserve_index=False) for f in frames)

    def passed(self, us: int):
        """Batches of the rows up to a time, in the order of their arrival; they leave the state."""
        first, last = self.ends.get() or (0, 0)
        self.least = None
        for at in range(first, last):
            rows = pa.ipc.read_record_batch(pa.py_buffer(self.batches.getValue((at,))[0]), self.schema)
            ready = pa.compute.less_equal(rows.column("us_"), us)
            done, left = rows.filter(ready), rows.filter(pa.compute.invert(ready))
            if left.num_rows == 0:
                self.batches.removeKey((at,))
            else:
                if done.num_rows:
                    self.batches.updateValue((at,), (left.serialize().to_pybytes(),))
                early = pa.compute.min(left.column("us_")).as_py()
                self.least = early if self.least is None else min(self.least, early)
            if at == first and left.num_rows == 0:
                first += 1
            if done.num_rows:
                yield done
        if first == last:
            self.ends.clear()
        else:
            self.ends.update((first, last))


class _Timer:
    """One timer for a group, for its earliest row or its expiry."""

    def __init__(self, handle):
        self.handle, self.state = handle, handle.getValueState("timer", "ms BIGINT")

    def wake(self, us: int) -> None:
        ms = -(-us // 1000)
        now = self.state.get()
        if now is not None:
            if now[0] <= ms:
                return
            self.handle.deleteTimer(now[0])
        self.handle.registerTimer(ms)
        self.state.update((ms,))


class _Carry:
    """What a step carries on for each key of a group, ``(written, JSON)``. Keys share ``SLOTS`` values of the state, read and written once a turn."""

    def __init__(self, handle):
        self.state = handle.getMapState("carry", "slot INT", "text STRING")
        self.begin(False)

    def begin(self, rows: bool) -> None:
        self.slots: dict[int, dict] = {}
        self.changed: set[int] = set()
        self.known = rows and self.state.exists()

    def slot(self, key: str) -> int:
        at = zlib.crc32(key.encode()) % SLOTS
        if at not in self.slots:
            text = self.state.getValue((at,)) if self.known else None
            self.slots[at] = json.loads(text[0]) if text else {}
        return at

    def get(self, key: str) -> tuple[int | None, str]:
        return self.slots[self.slot(key)].get(key) or (None, "null")

    def put(self, key: str, written: int | None, text: str) -> None:
        at = self.slot(key)
        own = self.slots[at]
        if text != "null":
            own[key] = (written, text)
        elif own.pop(key, None) is None:
            return
        self.changed.add(at)

    def every(self):
        """All keys and when they were written."""
        self.known = self.state.exists()
        for (at,) in list(self.state.keys()) if self.known else []:
            if at not in self.slots:
                self.slots[at] = json.loads(self.state.getValue((at,))[0])
        return [(k, written) for own in self.slots.values() for k, (written, _) in own.items()]

    def save(self) -> None:
        for at in self.changed:
            if self.slots[at]:
                self.state.updateValue((at,), (json.dumps(self.slots[at]),))
            elif self.state.containsKey((at,)):
                self.state.removeKey((at,))


class _InOrder(StatefulProcessor):
    """Keys are dealt over groups. A group's rows wait together; what a step carries on is kept for each key."""

    SCHEMA = pa.schema([("key_", pa.string()), ("us_", pa.int64()), ("side_", pa.int32()), ("body_", pa.string())])

    def __init__(self, keys: Sequence[str], step: Step, ttl_us: int | None, whole: bool = False):
        self.keys, self.step, self.ttl_us, self.whole = list(keys), step, ttl_us, whole

    def init(self, handle) -> None:
        self.waiting, self.timer = _Waiting(handle, self.SCHEMA), _Timer(handle)
        self.carry = _Carry(handle)
        self.swept = handle.getValueState("swept", "us BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        least = self.waiting.frames(rows)
        if least is not None:
            self.timer.wake(least)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.state.clear()
        ready = list(self.waiting.passed(passed))
        out, latest = [], None
        self.carry.begin(bool(ready))
        for key_text, rows in self._by_key(ready):
            written, text = old = self.carry.get(key_text)
            state = json.loads(text)
            for run in self._runs(rows):
                if written is not None and self._expired(written, run[0][0]):
                    written, state, text = None, None, "null"
                state, more = self.step(state, run)
                out += [(key_text, *r) for r in more]
                now = json.dumps(state)
                if now != text:
                    text, written = now, run[-1][0]
            if written is not None and self._expired(written, passed):
                text = "null"
            if (written, text) != tuple(old):
                self.carry.put(key_text, written, text)
            if text != "null":
                latest = written if latest is None else max(latest, written)
        self._expire(passed, bool(ready), latest)
        return iter([pd.DataFrame(out[at:at + OUT], columns=[*self.keys, "a_", "b_", "tag_"], dtype=object) for at in range(0, len(out), OUT)])

    def _expire(self, passed: int, ready: bool, latest: int | None) -> None:
        """Forget keys whose time to live has passed: once in that time, and when no rows wait. An expired key that is still kept counts as new."""
        if self.ttl_us is not None:
            swept = self.swept.get()
            if swept is None:
                self.swept.update((passed,))
            elif not ready or passed - swept[0] > self.ttl_us:
                self.swept.update((passed,))
                for k, written in self.carry.every():
                    if self._expired(written, passed):
                        self.carry.put(k, None, "null")
                    else:
                        latest = written if latest is None else max(latest, written)
        self.carry.save()
        if self.waiting.least is not None:
            self.timer.wake(self.waiting.least)
        elif latest is not None and self.ttl_us is not None:
            self.timer.wake(latest + self.ttl_us + 1)

    @staticmethod
    def _by_key(batches):
        """Each key with its rows by time and side, ties by arrival."""
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        keys = table.column("key_").combine_chunks().dictionary_encode()
        code, us, side = keys.indices.to_numpy(), table.column("us_").to_numpy(), table.column("side_").to_numpy()
        order = np.lexsort((side, us, code))
        cuts = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1)).tolist()
        us, side, bodies = us[order].tolist(), side[order].tolist(), table.column("body_").take(pa.array(order)).to_pylist()
        names = keys.dictionary.to_pylist()
        for a, b in zip(cuts, cuts[1:]):
            yield names[code[order[a]]], list(zip(us[a:b], side[a:b], bodies[a:b]))

    def _expired(self, written: int, now: int) -> bool:
        return self.ttl_us is not None and now - written > self.ttl_us

    def _runs(self, rows):
        """With a time to live, row by row, so that state expires between rows; else all at once."""
        if self.ttl_us is None or self.whole:
            return [rows]
        return [[r] for r in rows]

    def close(self) -> None:
        pass


def _key(df: DataFrame, by: Sequence[str]) -> Column:
    """The key as text. Zeros of either sign are one key, as they are to ``groupBy``."""
    def plain(k):
        kind = df.schema[k].dataType
        return (F.col(k) + F.lit(0.0)).cast(kind).alias(k) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(k)

    return F.to_json(F.struct(*map(plain, by)), _JSON).alias("key_")


def _packed(df: DataFrame, by: Sequence[str], ts: str, side: int, body: Column | None = None) -> DataFrame:
    body = F.to_json(F.struct(*df.columns), _JSON) if body is None else body
    return df.select(_key(df, by), F.col(ts).alias("t_"), durations.since_epoch(ts).alias("us_"), F.lit(side).alias("side_"), body.alias("body_"))


def in_order(packed: DataFrame, step: Step, ttl: str | None = None, whole: bool = False) -> DataFrame:
    """Run a step over packed rows per key, whose state expires ``ttl`` of event time after it last changed.

    Rows that are ready go to the step one by one, so that state can expire between them, or all at once (``whole``).
    Keys are dealt over ``GROUPS`` groups, since a group costs Spark as much as thousands of rows.

    Columns: key_, a_, b_, tag_ (Spark renames input columns that start with an underscore).
    """
    out = "key_ string, a_ string, b_ string, tag_ string"
    ttl_us = durations.micros(ttl) if ttl else None
    dealt = packed.withColumn("group_", F.pmod(F.xxhash64("key_"), F.lit(GROUPS)).cast("int"))
    return dealt.groupBy("group_").transformWithStateInPandas(_InOrder(["key_"], step, ttl_us, whole), out, "append", "EventTime")


def _body(column: str, df: DataFrame, names: Sequence[str], prefix: str = ""):
    parsed = F.from_json(column, T.StructType([df.schema[n] for n in df.columns]), _JSON)
    return [parsed[n].alias(prefix + n) for n in names]


def dedup(df: DataFrame, by: Sequence[str], ts: str, ttl: str | None = None) -> DataFrame:
    """First row per key by event time (for the first by arrival use ``dropDuplicatesWithinWatermark``)."""
    def step(seen, rows):
        return True, ([] if seen else [(rows[0][2], None, "")])

    out = in_order(_packed(df, by, ts, 0), step, ttl)
    return out.select(*_body("a_", df, df.columns))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              how: str = "inner", ttl: str | None = None) -> DataFrame:
    """Streaming counterpart of the batch as-of join; both sides carry a watermark."""
    versions = [c for c in right.columns if c not in by]

    def step(version, rows):
        out = []
        for _, side, body in rows:
            if side == 0:
                version = body
            elif version is not None or how == "left":
                out.append((body, version, ""))
        return version, out

    packed = _packed(right, by, right_ts, 0).union(_packed(left, by, left_ts, 1))
    out = in_order(packed, step, ttl)
    return out.select(*_body("a_", left, left.columns), *_body("b_", right, versions))


def lag(df: DataFrame, by: Sequence[str], ts: str, columns: dict[str, tuple[str, int]], ttl: str | None = None) -> DataFrame:
    """LAG on a stream: ``{"prev": ("value", 1)}``. Past rows are forgotten ``ttl`` after the key's last row."""
    deepest = max(n for _, n in columns.values())

    def step(past, rows):
        past, out = past or [], []
        for _, _, body in rows:
            row = json.loads(body)
            seen = {a: (past[-n].get(c) if len(past) >= n else None) for a, (c, n) in columns.items()}
            out.append((body, json.dumps(seen), ""))
            past = [*past, {c: row.get(c) for c, _ in columns.values()}][-deepest:]
        return past, out

    out = in_order(_packed(df, by, ts, 0), step, ttl)
    added = T.StructType([T.StructField(a, df.schema[c].dataType) for a, (c, _) in columns.items()])
    return out.select(*_body("a_", df, df.columns), *[F.from_json("b_", added, _JSON)[a].alias(a) for a in columns])


def range_sum(df: DataFrame, by: Sequence[str], ts: str, value: str, reach: str, alias: str) -> DataFrame:
    """SUM over the rows at most ``reach`` before each row; its peers in time are included.

    A key's state expires once nothing can reach it any more.
    """
    span = durations.micros(reach)

    def step(past, rows):
        # past and new values in time order, with running totals: a frame is a difference of two
        held = [*(past or []), *[[us, json.loads(b).get(value)] for us, _, b in rows]]
        times = [us for us, _ in held]
        totals, counts = [0.0], [0]
        for _, v in held:
            totals.append(totals[-1] + (v or 0.0))
            counts.append(counts[-1] + (v is not None))
        out = []
        for us, _, body in rows:
            i, j = bisect_left(times, us - span), bisect_right(times, us)
            out.append((body, json.dumps({alias: totals[j] - totals[i] if counts[j] > counts[i] else None}), ""))
        return held[bisect_left(times, times[-1] - span):], out

    # Peers in time must be handled together, which a time to live would part; the state is bounded by the reach.
    out = in_order(_packed(df, by, ts, 0), step, reach, whole=True)
    added = T.StructType([T.StructField(alias, T.DoubleType())])
    return out.select(*_body("a_", df, df.columns), F.from_json("b_", added)[alias].alias(alias))


def changelog(df: DataFrame, by: Sequence[str], ts: str, kind: str = "row_kind", mode: str = "retract",
              ttl: str | None = None) -> DataFrame:
    """Changelog in normal form: ``upsert`` (+I, +U, -D) or ``retract`` (also -U with the true old image).

    A row that did not change for ``ttl`` is forgotten; its next change is then an insert.
    """
    if mode not in ("upsert", "retract"):
        raise ValueError("streams normalize to upsert or retract; append is a filter")

    def step(now, rows):
        out = []
        for _, _, body in rows:
            what = json.loads(body).get(kind)
            if what == "-U":
                continue
            if what == "-D":
                if now is not None:
                    out.append((now, None, "-D"))
                now = None
            else:
                if now is None:
                    out.append((body, None, "+I"))
                else:
                    if mode == "retract":
                        out.append((now, None, "-U"))
                    out.append((body, None, "+U"))
                now = body
        return now, out

    out = in_order(_packed(df, by, ts, 0), step, ttl)
    return out.select(*_body("a_", df, [c for c in df.columns if c != kind]), F.col("tag_").alias(kind))


class _Released(StatefulProcessor):
    """First level of top N: rows wait for the watermark, then the best ``n`` of the group are kept and what enters them goes on."""

    def __init__(self, keys: Sequence[str], value: T.DataType, n: int, down: bool):
        self.keys, self.value, self.n, self.down = list(keys), value, n, down

    def init(self, handle) -> None:
        schema = pa.schema([("v_", to_arrow_type(self.value)), ("us_", pa.int64()), ("body_", pa.string())])
        self.waiting, self.timer = _Waiting(handle, schema), _Timer(handle)
        self.top = handle.getListState("top", f"v {self.value.simpleString()}, us BIGINT, body STRING")

    def handleInputRows(self, key, rows, timerValues):
        least = self.waiting.frames(rows)
        if least is not None:
            self.timer.wake(least)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.state.clear()
        new: list[tuple] = []
        for rows in self.waiting.passed(timerValues.getCurrentWatermarkInMs() * 1000):
            new += self._best_of(rows)
        if self.waiting.least is not None:
            self.timer.wake(self.waiting.least)
        _, entered = best([tuple(r) for r in self.top.get()], new, self.n, self.down, self.top)
        if not entered:
            return iter([])
        frame = pd.DataFrame(entered, columns=["v_", "us_", "body_"]).astype(object)
        for k, v in zip(self.keys, key):
            frame[k] = v
        return iter([frame[[*self.keys, "v_", "us_", "body_"]]])

    def _best_of(self, rows: pa.RecordBatch) -> list[tuple]:
        """The best rows of a batch in the order of their arrival, ties to the earlier row."""
        table = pa.table([rows.column("v_"), rows.column("us_"), pa.array(np.arange(rows.num_rows))], names=["v", "us", "at"])
        order = pa.compute.sort_indices(table, [("v", "descending" if self.down else "ascending"), ("us", "ascending"), ("at", "ascending")])
        kept = rows.take(pa.array(np.sort(order.to_numpy()[:self.n])))
        return list(zip(*(c.to_pylist() for c in kept.columns)))

    def close(self) -> None:
        pass


class _Best(StatefulProcessor):
    """Second level of top N: rows that entered a part come in, changes of the whole go out, one at most for each row and batch."""

    def __init__(self, keys: Sequence[str], kind: str, n: int, down: bool):
        self.keys, self.kind, self.n, self.down = list(keys), kind, n, down

    def init(self, handle) -> None:
        self.top = handle.getListState("top", f"v {self.kind}, us BIGINT, body STRING")

    def handleInputRows(self, key, rows, timerValues):
        new = [(v, int(us), body) for pdf in rows for v, us, body in zip(pdf["v_"], pdf["us_"], pdf["body_"])]
        gone, entered = best([tuple(r) for r in self.top.get()], new, self.n, self.down, self.top)
        if not gone and not entered:
            return iter([])
        frame = pd.DataFrame([*[(r[2], "-D") for r in gone], *[(r[2], "+I") for r in entered]], columns=["a_", "tag_"]).astype(object)
        for k, v in zip(self.keys, key):
            frame[k] = v
        return iter([frame[[*self.keys, "a_", "tag_"]]])

    def close(self) -> None:
        pass


def best(held: list[tuple], new: list[tuple], n: int, down: bool, state) -> tuple[list[tuple], list[tuple]]:
    """Keep the best ``n`` rows (value, time, body) in ``state``; rows that left and rows that entered. Ties go to the earlier row."""
    both = [(r, True) for r in held] + [(r, False) for r in new if r[0] is not None]
    both.sort(key=lambda x: (x[0][1], not x[1]))
    both.sort(key=lambda x: x[0][0], reverse=down)
    top, rest = both[:n], both[n:]
    entered = [r for r, old in top if not old]
    if entered:
        state.put([r for r, _ in top])
    return [r for r, old in rest if old], entered


def top_n(df: DataFrame, by: Sequence[str], ts: str, order: str, n: int, ttl: str | None = None, parts: int = 16) -> DataFrame:
    """Top n per key by ``order`` (``-value`` for descending) as a changelog: rows enter (+I) and leave (-D).

    Two stateful levels: each key is dealt over ``parts`` groups, which hold back rows until the watermark passes them and keep n rows each; what enters
    one of them goes to the key's own n rows. So the rows of a busy key are in ``parts`` tasks, and its one group gets no more than can change the result.
    With a time to live, by which a key's list is forgotten ``ttl`` after it last changed, there is one level.
    """
    down, column = order.startswith("-"), order.lstrip("-")
    if ttl is None:
        # times go as numbers, so that the order column is no second event time
        timed = isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        value = durations.since_epoch(column) if timed else F.col(column)
        value_type = T.LongType() if timed else df.schema[column].dataType
        kind = value_type.simpleString()
        body = F.to_json(F.struct(*df.columns), _JSON).alias("body_")
        dealt = F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int").alias("part_")
        rows = df.where(F.col(column).isNotNull()).select(*by, dealt, F.col(ts).alias("t_"), value.alias("v_"), durations.since_epoch(ts).alias("us_"), body)
        schema = T.StructType([*[df.schema[k] for k in by], T.StructField("part_", T.IntegerType()), T.StructField("v_", value_type),
                               T.StructField("us_", T.LongType()), T.StructField("body_", T.StringType())])
        entered = rows.groupBy(*by, "part_").transformWithStateInPandas(_Released([*by, "part_"], value_type, n, down), schema, "append", "EventTime")
        schema = T.StructType([*[df.schema[k] for k in by], T.StructField("a_", T.StringType()), T.StructField("tag_", T.StringType())])
        out = entered.groupBy(*by).transformWithStateInPandas(_Best(by, kind, n, down), schema, "append", "None")
        return out.select(*_body("a_", df, df.columns), F.col("tag_").alias("row_kind"))

    def step(top, rows):
        top, out = top or [], []
        for us, _, body in rows:
            v = json.loads(body).get(column)
            if v is None:
                continue
            rank = [-v if down else v, us, body]
            if len(top) == n and rank[:2] >= top[-1][:2]:
                continue
            top = sorted([*top, rank], key=lambda r: r[:2])
            if len(top) > n:
                out.append((top.pop()[2], None, "-D"))
            out.append((body, None, "+I"))
        return top, out

    out = in_order(_packed(df, by, ts, 0), step, ttl)
    return out.select(*_body("a_", df, df.columns), F.col("tag_").alias("row_kind"))


def match_pattern(df: DataFrame, by: Sequence[str], ts: str, pattern: str, define: dict[str, str], within: str,
                  skip: str = "past") -> DataFrame:
    """Row patterns on a stream: key, match_start, match_end, match_rows. A start is decided once no
    further row can lie within its bound. ``skip``: "past" or "next"."""
    from millrace.operators.patterns import Pattern
    p, limit = Pattern(pattern), durations.micros(within)
    bits = {v: 1 << i for i, v in enumerate(p.variables)}
    mask = F.lit(0)
    for v, bit in bits.items():
        mask = mask + F.when(F.expr(define[v]) if v in define else F.lit(True), F.lit(bit)).otherwise(F.lit(0))

    def step(held, rows):
        held = [*(held or []), *[[us, int(body)] for us, _, body in rows]]
        now, out, i = held[-1][0], [], 0
        while i < len(held) and held[i][0] + limit <= now:
            end = next((j for j in range(i, len(held)) if held[j][0] >= held[i][0] + limit), len(held))
            path = p.match(lambda v, r, _: bool(held[r][1] & bits[v]), i, end, True)
            if path:
                last = i + len(path) - 1
                out.append((str(held[i][0]), str(held[last][0]), str(len(path))))
            i += len(path) if path and skip == "past" else 1
        return held[i:], out

    out = in_order(_packed(df, by, ts, 0, mask.cast("string")), step)
    return out.select(*_body("key_", df.select(*by), by), F.timestamp_micros(F.col("a_").cast("long")).alias("match_start"),
                      F.timestamp_micros(F.col("b_").cast("long")).alias("match_end"),
                      F.col("tag_").cast("long").alias("match_rows"))
