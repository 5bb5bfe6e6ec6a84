"""Operators on streams: events arrive as a file stream, output is what the watermark has finalised.

Expected results come from the batch rules, restricted to event times at or before the final watermark.
"""

from pyspark.sql import functions as F, types as T

from millrace import session
from millrace.operators import joins as J, windows as W
from millrace.sources import sinks
from millrace.streaming import run, state
from millrace.streaming.watermark import assign
from queries.registry import query
from queries.windows_time import CUMULATE, EPOCH, session_sql

DELAY = "1 hour"
DONE = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def stream(t, condition=None):
    """Events as a stream with a watermark."""
    schema = t.events.schema
    df = run.file_stream(t.spark, t.sf_dir, "events.parquet", schema)
    df = df.where(condition) if condition else df
    return assign(df, "ts", DELAY)


def out(df, *names):
    """Finished rows with times as the batch tables have them."""
    done = run.drain(df)
    zoned = [f.name for f in done.schema.fields if isinstance(f.dataType, T.TimestampType)]
    done = done.withColumns({n: F.col(n).cast("timestamp_ntz") for n in zoned}) if zoned else done
    return done.select(*names) if names else done


def tumble_sql(size, keys, aggs):
    b = f"time_bucket(INTERVAL {size}, ts, {EPOCH})"
    return (f"SELECT * FROM (SELECT {b} AS window_start, {b} + INTERVAL {size} AS window_end, {keys}, {aggs} FROM events "
            f"GROUP BY 1, 2, 3) WHERE window_end <= {DONE}")


@query("stream_tumble", tumble_sql("1 HOUR", "event_type", "count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 8) AS mean"))
def stream_tumble(t):
    from queries.windows_time import hourly
    return out(hourly(stream(t)))


@query("stream_hop", f"""
WITH x AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts, {EPOCH}) - INTERVAL 45 MINUTE,
   time_bucket(INTERVAL 15 MINUTE, ts, {EPOCH}), INTERVAL 15 MINUTE)) AS window_start FROM events)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, max(value) AS hi
FROM x GROUP BY window_start, event_type HAVING window_start + INTERVAL 1 HOUR <= {DONE}""")
def stream_hop(t):
    return out(W.hop(stream(t), "ts", "15 minutes", "1 hour", ["event_type"], {"n": F.count("*"), "hi": F.max("value")}))


@query("stream_session", f"SELECT * FROM ({session_sql(12, 'user_id', 'count(*) AS n, round(sum(value), 4) AS total')}) WHERE window_end <= {DONE}")
def stream_session(t):
    return out(W.session(stream(t), "ts", "12 hours", ["user_id"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)}))


@query("stream_cumulate", f"SELECT * FROM ({CUMULATE}) WHERE window_start + INTERVAL 1 DAY <= {DONE}")
def stream_cumulate(t):
    return out(W.cumulate(stream(t), "ts", "6 hours", "1 day", ["event_type"],
                          {"n": F.count("*"), "total": F.round(F.sum("value"), 4)}))


@query("stream_distinct", tumble_sql("1 DAY", "event_type", "count(DISTINCT user_id) AS users"))
def stream_distinct(t):
    return out(W.tumble_distinct(stream(t), "ts", "1 day", ["event_type"], "user_id", "users"))


SIDES = """b AS (SELECT user_id, event_id AS buy_id, ts AS buy_ts, value AS spend FROM events WHERE event_type = 'purchase'),
 c AS (SELECT user_id, event_id AS click_id, ts AS click_ts FROM events WHERE event_type = 'click')"""


def sides(t):
    b = stream(t, "event_type = 'purchase'").selectExpr("user_id", "event_id AS buy_id", "ts AS buy_ts", "value AS spend")
    c = stream(t, "event_type = 'click'").selectExpr("user_id", "event_id AS click_id", "ts AS click_ts")
    return b, c


@query("stream_interval_join", f"""WITH {SIDES} SELECT user_id, buy_id, click_id FROM b JOIN c USING (user_id)
WHERE click_ts BETWEEN buy_ts - INTERVAL 12 HOUR AND buy_ts + INTERVAL 12 HOUR""")
def stream_interval_join(t):
    b, c = sides(t)
    return out(J.interval_join(b, c, ["user_id"], "buy_ts", "click_ts", "-12 hours", "12 hours"), "user_id", "buy_id", "click_id")


@query("stream_lookup", "SELECT event_id, user_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_lookup(t):
    dim = t.customer.withColumnRenamed("c_custkey", "user_id")
    return out(J.lookup_join(stream(t).select("event_id", "user_id"), dim, ["user_id"], ["c_name"]), "event_id", "user_id", "c_name")


@query("stream_asof", f"""WITH {SIDES}, lim AS (SELECT least((SELECT max(buy_ts) FROM b), (SELECT max(click_ts) FROM c)) - INTERVAL 1 HOUR AS w)
SELECT b.user_id, buy_id, click_id FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.buy_ts >= c.click_ts WHERE buy_ts <= (SELECT w FROM lim)""")
def stream_asof(t):
    b, c = sides(t)
    return out(state.asof_join(b, c, ["user_id"], "buy_ts", "click_ts", "left"), "user_id", "buy_id", "click_id")


@query("stream_dedup", f"""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events) WHERE rn = 1 AND ts <= {DONE}""")
def stream_dedup(t):
    return out(state.dedup(stream(t), ["user_id"], "ts"), "user_id", "event_id")


@query("stream_dedup_arrival", "SELECT DISTINCT event_id FROM events")
def stream_dedup_arrival(t):
    # the source repeated: of copies within the watermark delay only one passes
    twice = stream(t).select("event_id", "ts").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return out(twice.dropDuplicatesWithinWatermark(["event_id"]), "event_id")


@query("stream_lag", f"""SELECT event_id, p AS prev FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE ts <= {DONE}""")
def stream_lag(t):
    return out(state.lag(stream(t), ["user_id"], "ts", {"prev": ("value", 1)}), "event_id", "prev")


@query("stream_range_sum", f"""SELECT event_id, round(s, 4) AS spend FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts
 RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS s FROM events) WHERE ts <= {DONE}""")
def stream_range_sum(t):
    summed = state.range_sum(stream(t), ["user_id"], "ts", "value", "12 hours", "spend")
    return out(summed.select("event_id", F.round("spend", 4).alias("spend")))


@query("stream_changelog", f"""
WITH c AS (SELECT user_id, ts, event_id, event_type = 'error' AS gone, lag(event_id) OVER w AS pid,
  coalesce(lag(event_type) OVER w <> 'error', false) AS alive FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), d AS (SELECT * FROM c WHERE ts <= {DONE})
SELECT user_id, event_id, '+I' AS row_kind FROM d WHERE NOT gone AND NOT alive
UNION ALL SELECT user_id, pid, '-U' FROM d WHERE NOT gone AND alive UNION ALL SELECT user_id, event_id, '+U' FROM d WHERE NOT gone AND alive
UNION ALL SELECT user_id, pid, '-D' FROM d WHERE gone AND alive""")
def stream_changelog(t):
    kind = F.when(F.col("event_type") == "error", "-D").otherwise("+U")
    log = stream(t).select("user_id", "ts", "event_id", kind.alias("row_kind"))
    return out(state.changelog(log, ["user_id"], "ts"), "user_id", "event_id", "row_kind")


@query("stream_topn", f"""
SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts) AS rn FROM events WHERE ts <= {DONE}) WHERE rn <= 5""")
def stream_topn(t):
    changes = state.top_n(stream(t), ["event_type"], "ts", "-value", 5)
    # the changelog folded back: rows that entered and did not leave
    return (out(changes, "event_type", "event_id", "row_kind").groupBy("event_type", "event_id")
            .agg(F.sum(F.when(F.col("row_kind") == "+I", 1).otherwise(-1)).alias("n")).where("n > 0").drop("n"))


@query("stream_match", f"""
WITH RECURSIVE r AS (SELECT user_id AS k, ts, row_number() OVER w AS s, event_type AS y1, lead(event_type) OVER w AS y2, lead(ts) OVER w AS t2
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 m AS (SELECT *, s + 1 AS e FROM r WHERE y1 IN ('click', 'view') AND y2 = 'purchase' AND t2 < ts + INTERVAL 12 HOUR)
SELECT k AS user_id, ts AS match_start, t2 AS match_end, 2::BIGINT AS match_rows FROM m WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = k
 AND e.ts >= m.ts + INTERVAL 12 HOUR AND e.ts <= {DONE})""")
def stream_match(t):
    return out(state.match_pattern(stream(t), ["user_id"], "ts", "A B", {
        "A": "event_type IN ('click', 'view')", "B": "event_type = 'purchase'"}, "12 hours"))


@query("stream_branches", """
SELECT 'errors' AS branch, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'large', event_id FROM events WHERE value > 50""")
def stream_branches(t):
    path = session.work_dir(t.spark, "branches")
    q = sinks.stream_branches(stream(t), {"errors": lambda b: b.where("event_type = 'error'").select("event_id"),
                                          "large": lambda b: b.where("value > 50").select("event_id")},
                              sinks.files_by_batch(path), path + "-checkpoint", available_now=True)
    q.awaitTermination()
    errors, large = [t.spark.read.parquet(f"{path}/{b}").select(F.lit(b).alias("branch"), "event_id") for b in ("errors", "large")]
    return errors.unionByName(large)


@query("stream_spec", tumble_sql("1 HOUR", "event_type", "count(*) AS n, round(sum(value), 4) AS total").replace("FROM events", "FROM events WHERE value > 5", 1))
def stream_spec(t):
    """A pipeline spec on a stream: filter, window, file sink."""
    from millrace.plans.spec import Pipeline
    folder = session.work_dir(t.spark, "spec")
    nodes = [("in", "input", {"table": "events"}), ("keep", "filter", {"condition": "value > 5"}),
             ("hours", "tumble_window", {"time": "ts", "size": "1 hour", "by": ["event_type"], "aggs": {"n": "count(1)", "total": "round(sum(value), 4)"}}),
             ("files", "filesystem_sink", {"path": f"{folder}/rows"})]
    spec = Pipeline.from_dict({"name": "hours", "nodes": [{"id": i, "op": o, "params": p} for i, o, p in nodes],
                               "edges": [{"from": a[0], "to": b[0]} for a, b in zip(nodes, nodes[1:])],
                               "settings": {"mode": "streaming", "checkpoint": f"{folder}/checkpoint", "trigger": "available_now"}})
    spec.run(t.spark, {"events": stream(t)})["files"].awaitTermination()
    done = t.spark.read.parquet(f"{folder}/rows")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
