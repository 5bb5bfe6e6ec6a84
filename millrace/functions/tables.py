"""Table functions written in Python: rows of a key come in order, rows go out."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F


def register(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """Make a class with ``eval`` (and ``terminate``) a table function of SQL; ``returns`` is its table as DDL.

    The class's module travels with it, so executors need no copy of it. Rows go plain: by Arrow, Spark makes a table of what each single row gives.
    """
    if not callable(getattr(handler, "eval", None)):
        raise ValueError(f"{handler.__name__} has no method eval")
    cloudpickle.register_pickle_by_value(sys.modules[handler.__module__])
    spark.udtf.register(name, F.udtf(handler, returnType=returns, useArrow=False))


def apply(df: DataFrame, name: str, by: Sequence[str], order: Sequence[str], arguments: Sequence = ()) -> DataFrame:
    """Rows that the function makes of a table, key by key: ``TABLE(df) PARTITION BY by ORDER BY order``.

    ``order``: "-x" is descending. A key is handed over row by row, so the function holds what it keeps and no more.
    """
    keys = ", ".join(f"`{k}`" for k in by)
    sort = ", ".join(f"`{o[1:]}` DESC" if o.startswith("-") else f"`{o}`" for o in order)
    rest = "".join(f", {a!r}" for a in arguments)
    return df.sparkSession.sql(f"SELECT * FROM {name}(TABLE({{rows}}) PARTITION BY ({keys}) ORDER BY ({sort}){rest})", rows=df)


class Streaks:
    """Runs of rows of a key with one value: columns ``key``, ``value``, ``id`` in, one row for each run out."""

    def __init__(self):
        self.run = None

    def eval(self, row):
        if self.run and self.run[1] == row["value"]:
            self.run = (*self.run[:3], row["id"], self.run[4] + 1)
            return
        if self.run:
            yield self.run
        self.run = (row["key"], row["value"], row["id"], row["id"], 1)

    def terminate(self):
        if self.run:
            yield self.run


STREAKS = "key BIGINT, value STRING, first_id BIGINT, last_id BIGINT, n BIGINT"
