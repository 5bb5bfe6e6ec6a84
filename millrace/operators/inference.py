"""Batch scoring of rows with a pluggable model.

Only the input columns travel to Python, in Arrow batches; all others stay in the JVM. The scoring
function is marked non-deterministic so that Spark neither repeats it nor moves filters below it: a
row is scored once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Scorer = Callable[[pd.DataFrame], pd.Series]


class ScoringFailed(Exception):
    """A batch failed on every attempt and no fallback value is set."""


def scorer_column(load: Callable[[], Scorer], inputs: Sequence[str], returns: str = "double", on_error: object = None,
                  fail: bool = False, retries: int = 0, timeout_s: float | None = None, in_flight: int = 1,
                  chunk_rows: int = 10_000, backoff_s: float = 0.1) -> Column:
    """Score column. ``load`` runs once per task and returns the scorer of a DataFrame of inputs.

    Chunks of ``chunk_rows`` rows are scored, ``in_flight`` at a time. A chunk that raises or exceeds
    ``timeout_s`` is tried ``retries`` more times; then its rows get ``on_error``, or the job fails.
    """
    names = list(inputs)

    def attempt(pool: ThreadPoolExecutor | None, scorer: Scorer, chunk: pd.DataFrame) -> pd.Series:
        error = None
        for n in range(retries + 1):
            try:
                if timeout_s is None:
                    out = scorer(chunk)
                else:
                    out = pool.submit(scorer, chunk).result(timeout_s)
                return pd.Series(out).reset_index(drop=True)
            except Exception as e:  # noqa: BLE001 - any model error is retried
                error = e
                if n < retries:
                    time.sleep(backoff_s * 2 ** n)
        if fail:
            raise ScoringFailed(f"{len(chunk)} rows failed after {retries + 1} attempts") from error
        return pd.Series([on_error] * len(chunk))

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        scorer = load()
        calls = ThreadPoolExecutor(max(in_flight, 1)) if timeout_s is not None else None
        with ThreadPoolExecutor(max(in_flight, 1)) as lanes:
            for columns in batches:
                frame = pd.concat(list(columns), axis=1, keys=names)
                chunks = [frame.iloc[i:i + chunk_rows] for i in range(0, len(frame), chunk_rows)]
                if in_flight > 1:
                    parts = list(lanes.map(lambda c: attempt(calls, scorer, c), chunks))
                else:
                    parts = [attempt(calls, scorer, c) for c in chunks]
                yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype="object")
        if calls:
            calls.shutdown(wait=False, cancel_futures=True)

    # the annotations tell Spark which kind of pandas function this is
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    if len(names) == 1:
        many = run

        def single(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from many((b,) for b in batches)
        single.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(single, returns).asNondeterministic()(*names)
    return F.pandas_udf(run, returns).asNondeterministic()(*names)


def score(df: DataFrame, load: Callable[[], Scorer], inputs: Sequence[str], alias: str = "score",
          passthrough: Sequence[str] | None = None, pre: dict[str, str] | None = None, post: str | None = None,
          where: str | None = None, returns: str = "double", **options) -> DataFrame:
    """Passthrough columns (default all) and a score.

    ``pre``: SQL expressions for inputs, added as ``<c>_processed`` and given to the model in place of
    ``c``; ``post``: SQL expression that replaces the score; ``where``: filter that may use it.
    """
    work = df
    feed = list(inputs)
    for c, e in (pre or {}).items():
        work = work.withColumn(f"{c}_processed", F.expr(e))
        feed = [f"{c}_processed" if f == c else f for f in feed]
    scored = work.withColumn(alias, scorer_column(load, feed, returns, **options))
    if post:
        scored = scored.withColumn(alias, F.expr(post))
    if where:
        scored = scored.where(where)
    keep = list(passthrough) if passthrough is not None else df.columns
    return scored.select(*keep, alias)


def predict_table(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], outputs: str) -> DataFrame:
    """Model as a table function: every column in, the model's columns appended (``outputs`` as DDL)."""
    from pyspark.sql import types as T
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(outputs).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield pd.concat([b, model(b).set_index(b.index)], axis=1)

    return df.mapInPandas(run, schema)


def score_array(df: DataFrame, load: Callable[[str, str], Callable[[pd.Series], pd.Series]], features: Sequence[str],
                model: str, version: str, alias: str = "score", returns: str = "double") -> DataFrame:
    """Registered-function form: one ARRAY of features plus the model's name and version."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load(model, version)
        for b in batches:
            yield scorer(b)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    array = F.array(*[F.col(f).cast("double") for f in features])
    return df.withColumn(alias, F.pandas_udf(run, returns).asNondeterministic()(array))
