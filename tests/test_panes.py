"""Windows from panes against windows that copy rows, on tables and on streams."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import rows
from millrace.operators import panes, windows as W
from test_streams import folder, run, stream  # noqa: F401 - the folder is a fixture

KINDS = {"n": ("count", None), "m": ("count", "value"), "s": ("sum", "value"), "lo": ("min", "value"), "hi": ("max", "event_type"), "mean": ("avg", "value"),
         "vp": ("var_pop", "value"), "vs": ("var_samp", "value"), "sp": ("stddev_pop", "value"), "ss": ("stddev_samp", "value"), "h": ("approx_distinct", "user_id"),
         "d": ("distinct", "event_type")}


@pytest.fixture(scope="module")
def ev(events):
    """A null key, null values, rows without a time, and values far from zero with a small spread."""
    return events.select("event_id", F.when(F.col("event_id") % 50 != 7, F.col("ts")).alias("ts"), F.when(F.col("user_id") != 3, F.col("user_id")).alias("user_id"),
                         "event_type", F.when(F.col("event_id") % 9 != 1, F.col("value") + 1e6).alias("value"))


def plain():
    return {"n": F.count("*"), "m": F.count("value"), "s": F.sum("value"), "lo": F.min("value"), "hi": F.max("event_type"), "mean": F.avg("value"), "vp": F.var_pop("value"),
            "vs": F.var_samp("value"), "sp": F.stddev_pop("value"), "ss": F.stddev_samp("value"), "h": F.hll_sketch_estimate(F.hll_sketch_agg("user_id")),
            "d": F.count_distinct("event_type")}


def same(got, want, names=tuple(KINDS), keys=("window_start", "window_end", "user_id")):
    """Equal rows; doubles may differ in their last digits."""
    a, b = (sorted((tuple(r) for r in df.select(*keys, *names).collect()), key=lambda r: tuple(map(str, r[:len(keys)]))) for df in (got, want))
    near = lambda x, y: x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-4)
    return len(a) == len(b) and all(near(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("slide, size", [("2 hours", "8 hours"), ("3 hours", "8 hours"), ("1 day", "1 day"), ("1 hour", "60 hours"), ("2 days", "5 hours")])
def test_hop(ev, slide, size):
    want = W.hop(ev, "ts", slide, size, ["user_id"], plain()) if slide != "2 days" else None
    got = panes.hop(ev, "ts", slide, size, ["user_id"], KINDS)
    if want is None:  # windows with gaps between them, which Spark's own function refuses
        start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(172_800_000_000)) * 172_800_000_000
        begin = F.timestamp_micros(start).cast("timestamp_ntz")
        inside = ev.withColumn("window_start", begin).withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 5 HOURS")).where("ts < window_end")
        want = inside.groupBy("window_start", "window_end", "user_id").agg(*[a.alias(n) for n, a in plain().items()])
    assert same(got, want) and got.count() > 20


@pytest.mark.parametrize("step, size", [("6 hours", "1 day"), ("15 minutes", "1 day"), ("1 day", "1 day")])
def test_cumulate(ev, step, size):
    assert same(panes.cumulate(ev, "ts", step, size, ["user_id"], KINDS), W.cumulate(ev.where("ts IS NOT NULL"), "ts", step, size, ["user_id"], plain()))


def test_without_keys_and_rows(ev):
    got = panes.hop(ev, "ts", "1 day", "3 days", [], {"n": ("count", None), "u": ("distinct", "user_id")})
    want = W.hop(ev, "ts", "1 day", "3 days", [], {"n": F.count("*"), "u": F.count_distinct("user_id")})
    assert rows(got) == rows(want)
    assert panes.hop(ev.limit(0), "ts", "1 day", "3 days", ["user_id"], KINDS).collect() == []
    assert panes.cumulate(ev.limit(0), "ts", "1 day", "3 days", ["user_id"], KINDS).collect() == []
    with pytest.raises(ValueError):
        panes.hop(ev, "ts", "1 day", "3 days", [], {"n": ("median", "value")})


def test_rows_are_aggregated_before_anything_is_copied(ev):
    for out in (panes.hop(ev, "ts", "1 hour", "100 hours", ["user_id"], {"s": ("sum", "value")}), panes.cumulate(ev, "ts", "15 minutes", "1 day", ["user_id"], {"s": ("sum", "value")})):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Aggregate") and "Expand" not in plan and plan.count("Generate") == 1


def test_streams(spark, events, folder):  # noqa: F811
    kinds = {k: v for k, v in KINDS.items() if k != "d"}
    limit = events.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    for windows in (lambda df: panes.hop(df, "ts", "2 hours", "8 hours", ["event_type"], kinds),
                    lambda df: panes.cumulate(df, "ts", "6 hours", "1 day", ["event_type"], kinds)):
        got = run.drain(windows(stream(spark, events, folder)))
        want = windows(events).where(F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.lit(limit))
        plainly = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
        got = got.withColumns(plainly).where(F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.lit(limit))
        assert same(got, want, kinds, ("window_start", "window_end", "event_type")) and want.count() > 50
    with pytest.raises(ValueError):
        panes.hop(stream(spark, events, folder), "ts", "2 hours", "8 hours", [], {"d": ("distinct", "value")})
