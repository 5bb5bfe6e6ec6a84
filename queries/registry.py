"""Registry of queries: a Spark callable and, where SQL can say it, the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of one scale as attributes, and ``sql`` over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in session.TABLES:
            raise AttributeError(name)
        return session.table(self.spark, self.sf_dir, name)

    def sql(self, text: str, *names: str) -> DataFrame:
        """SQL over the named tables, bound as DataFrames so that no view is left behind."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.pin_utc(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap
