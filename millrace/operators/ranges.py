"""Ranges of a key's rows along an order, with borders from a sample, so that a busy key is spread evenly over tasks.

``Window.partitionBy(key)`` sends all rows of a key to one task. Here a bounded sample of (key, order) gives borders of equal row counts.
A key with two borders or more holds about ``1 / parts`` of all rows at least: it is busy, and its rows are numbered by the
borders before them. Other keys stay whole and cost nothing: no count, no join, one scan and one shuffle. For busy keys a
scan of one summary for each range carries what a range needs from those before it (``slices.with_prefix``, ``slices.with_edge_rows``).
"""

from __future__ import annotations

import base64
import json
from collections import Counter
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace import durations, session
from millrace.operators.slices import HOT, SLICE, order_columns

#: Sampled rows for each range.
SAMPLED = 16
#: Tables that Catalyst estimates below this many bytes are not cut: one task holds them easily.
SMALL = 8 << 20

_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def plain(df: DataFrame, name: str) -> Column:
    """A column as a value that literals can hold exactly: times as microseconds, the others as they are."""
    kind = df.schema[name].dataType
    return durations.since_epoch(name).cast("bigint") if isinstance(kind, _TIME_TYPES) else F.col(name)


def before_or_at(border: Column, row: list[Column], descending: list[bool]) -> Column:
    """Whether a struct of values stands before a row or with it; NULLs first ascending, last descending."""
    test = F.lit(True)
    for k in reversed(range(len(row))):
        mark, here = border[f"c{k}"], row[k]
        if descending[k]:
            earlier = F.coalesce(mark > here, mark.isNotNull() & here.isNull())
        else:
            earlier = F.coalesce(mark < here, mark.isNull() & here.isNotNull())
        test = earlier | (mark.eqNullSafe(here) & test)
    return test


class Borders:
    """Borders of busy keys, ascending by key and order."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], parts: int):
        self.by, self.order = list(by), list(order)
        names = [*self.by, *[o.lstrip("-") for o in order]]
        self.row = [plain(df, n) for n in names]
        self.descending = [False] * len(self.by) + [o.startswith("-") for o in order]
        keys = df.select(*[c.alias(f"c{k}") for k, c in enumerate(self.row)])
        self.kinds = [f.dataType for f in keys.schema.fields]
        place = F.xxhash64(*keys.columns, F.monotonically_increasing_id())
        chosen = keys.withColumn("_h", place).orderBy("_h").limit(parts * SAMPLED)
        sorted_ = chosen.orderBy(*order_columns([("-" if d else "") + f"c{k}" for k, d in enumerate(self.descending)]))
        rows = [tuple(r)[:-1] for r in sorted_.collect()]
        step = max(1, len(rows) // parts)
        marks = list(dict.fromkeys(rows[step::step]))
        n = Counter(repr(m[:len(self.by)]) for m in marks)
        self.marks = [m for m in marks if n[repr(m[:len(self.by)])] > 1]

    def table(self) -> Column:
        """The borders as a constant; Catalyst folds it, so it is parsed once."""
        rows = [{f"c{k}": base64.b64encode(v).decode() if isinstance(v, (bytes, bytearray)) else str(v) if isinstance(v, Decimal) else v
                 for k, v in enumerate(m) if v is not None} for m in self.marks]
        fields = ", ".join(f"c{k}: {kind.simpleString()}" for k, kind in enumerate(self.kinds))
        return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")

    def cut(self, df: DataFrame) -> DataFrame:
        """Add ``_slice`` (the number of borders at or before the row, for busy keys) and ``_hot``.

        The place among the borders is found by halving steps, within one expression.
        """
        marks, n = self.table(), len(self.marks)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
        at = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & before_or_at(F.get(marks, at + step - 1), self.row, self.descending), at + step).otherwise(at))

        def own(place: Column) -> Column:
            test = F.lit(False)
            for mark in (F.get(marks, place - 1), F.get(marks, place)):
                same = mark.isNotNull()
                for k in range(len(self.by)):
                    same = same & mark[f"c{k}"].eqNullSafe(self.row[k])
                test = test | same
            return F.when(test, place)

        out = df.withColumn(SLICE, F.get(F.transform(F.array(at), own), 0).cast("long"))
        return out.withColumns({HOT: F.col(SLICE).isNotNull(), SLICE: F.coalesce(SLICE, F.lit(0))})


def cut(df: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame | None:
    """``df`` with ``_hot`` and ``_slice``, or None if no key is busy.

    ``parts`` is the number of ranges that the whole table would be cut into; by default two for each shuffle partition, and
    none for a small table.
    """
    if parts is None:
        if session.plan_bytes(df.select(*by, *[o.lstrip("-") for o in order])) < SMALL:
            return None
        parts = max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    borders = Borders(df, by, order, parts)
    return borders.cut(df) if borders.marks else None
