"""Sliding and cumulating windows from panes."""

from pyspark.sql import functions as F

from millrace.operators import panes
from queries.registry import query
from queries.windows_time import EPOCH

MEASURES = {"n": ("count", None), "total": ("sum", "value"), "lo": ("min", "value"), "hi": ("max", "value"), "mean": ("avg", "value"),
            "sd": ("stddev_pop", "value"), "users": ("distinct", "user_id")}
MEASURES_SQL = """count(*) AS n, round(sum(value), 4) AS total, min(value) AS lo, max(value) AS hi, round(avg(value) * count(*), 4) / count(*) AS mean,
 round(stddev_pop(value), 6) AS sd, count(DISTINCT user_id) AS users"""


def rounded(windows):
    return windows.withColumns({"total": F.round("total", 4), "mean": F.round(F.col("mean") * F.col("n"), 4) / F.col("n"), "sd": F.round("sd", 6)})


@query("hop_panes", f"""
WITH x AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}) - INTERVAL 99 HOUR,
   time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}), INTERVAL 1 HOUR)) AS window_start FROM events)
SELECT window_start, window_start + INTERVAL 100 HOUR AS window_end, event_type, {MEASURES_SQL} FROM x GROUP BY window_start, event_type""")
def hop_panes(t):
    return rounded(panes.hop(t.events, "ts", "1 hour", "100 hours", ["event_type"], MEASURES))


@query("cumulate_panes", f"""
WITH x AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) AS window_start FROM events),
 y AS (SELECT *, unnest(generate_series(CAST(floor((epoch_us(ts) - epoch_us(window_start)) / 900000000) AS BIGINT) + 1, 96)) AS k FROM x)
SELECT window_start, window_start + k * INTERVAL 15 MINUTE AS window_end, event_type, {MEASURES_SQL} FROM y GROUP BY window_start, k, event_type""")
def cumulate_panes(t):
    return rounded(panes.cumulate(t.events, "ts", "15 minutes", "1 day", ["event_type"], MEASURES))
