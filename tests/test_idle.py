"""A silent source holds windows back until its timeout, and no longer."""

import time
from datetime import datetime, timedelta

import pytest

from millrace.streaming import idle, run

SCHEMA = "k BIGINT, at TIMESTAMP, v DOUBLE"
START = datetime(2024, 1, 1)


@pytest.fixture()
def sources(spark, tmp_path):
    """Source a sends an hour of minutes, source b falls silent after ten of them; a row without a time; a key that b never sends."""
    rows = {"a": [(1, START + timedelta(minutes=m), float(m)) for m in range(60)] + [(2, START + timedelta(minutes=m), 1.0) for m in range(0, 60, 7)] + [(1, None, 9.0)],
            "b": [(1, START + timedelta(minutes=m), 100.0) for m in range(10)]}
    for name, own in rows.items():
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
    return {n: run.file_stream(spark, str(tmp_path / n), "*.parquet", spark.createDataFrame([], SCHEMA).schema) for n in rows}


def results(spark, df, name, seconds, enough):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + seconds
        while time.time() < end:
            if q.exception():
                raise q.exception()
            found = [] if not q.lastProgress else [tuple(r) for r in spark.table(name).orderBy("k", "window_start").collect()]
            if len(found) >= enough:
                time.sleep(3)
                break
            time.sleep(0.5)
    finally:
        q.stop()
    return [tuple(r) for r in spark.table(name).orderBy("k", "window_start").collect()]


def windows(streams, timeout):
    return idle.tumble(streams, "at", "5 minutes", ["k"], {"n": ("count", None), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "m": ("avg", "v")}, timeout, "1 minute")


def expected(k, upto):
    out = []
    for w in range(0, upto, 5):
        values = [float(m) for m in range(w, w + 5)] + [100.0] * (5 if w < 10 else 0) if k == 1 else [1.0 for m in range(w, w + 5) if m % 7 == 0]
        if values:
            out.append((START + timedelta(minutes=w), START + timedelta(minutes=w + 5), k, len(values), sum(values), min(values), max(values), sum(values) / len(values)))
    return out


def test_windows_end_after_the_timeout(spark, sources):
    want = expected(1, 55) + expected(2, 55)
    assert results(spark, windows(sources, "6 seconds"), "idle_short", 120, len(want)) == want


def test_windows_wait_for_a_source_that_is_not_idle_yet(spark, sources):
    """Without a timeout in reach, b holds key 1 at its ninth minute and key 2, which it never sent, altogether."""
    assert results(spark, windows(sources, "1 day"), "idle_long", 30, 1) == expected(1, 5)


def test_errors(spark, sources):
    with pytest.raises(ValueError):
        idle.tumble(sources, "at", "5 minutes", ["k"], {"n": ("median", "v")}, "1 second")
    with pytest.raises(ValueError):
        idle.tumble(sources, "at", "5 minutes", [], {"n": ("count", None)}, "1 second")
