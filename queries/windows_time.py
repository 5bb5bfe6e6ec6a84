"""Event-time windows, changelogs and upserts on bounded tables."""

from pyspark.sql import functions as F

from millrace.operators import keyed, windows as W
from queries.registry import query

EPOCH = "TIMESTAMP '1970-01-01'"


@query("window_tumble", f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}) AS window_start,
 time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n,
 round(sum(value), 4) AS total, round(avg(value), 8) AS mean FROM events GROUP BY 1, 2, 3""")
def window_tumble(t):
    return hourly(t.events)


def hourly(events):
    """Hourly totals per event type; runs alike on a table and on a stream."""
    return W.tumble(events, "ts", "1 hour", ["event_type"], {
        "n": F.count("*"), "total": F.round(F.sum("value"), 4), "mean": F.round(F.avg("value"), 8)})


@query("window_hop", f"""
WITH x AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts, {EPOCH}) - INTERVAL 45 MINUTE,
   time_bucket(INTERVAL 15 MINUTE, ts, {EPOCH}), INTERVAL 15 MINUTE)) AS window_start FROM events)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, max(value) AS hi
FROM x GROUP BY window_start, event_type""")
def window_hop(t):
    return W.hop(t.events, "ts", "15 minutes", "1 hour", ["event_type"], {"n": F.count("*"), "hi": F.max("value")})


def session_sql(gap_hours: int, keys: str, aggs: str, source: str = "events", ts: str = "ts") -> str:
    """Sessions by gaps: a new one when the distance to the previous event exceeds the gap."""
    return f"""
WITH o AS (SELECT *, CASE WHEN lag({ts}) OVER (PARTITION BY {keys} ORDER BY {ts}) IS NULL
   OR {ts} > lag({ts}) OVER (PARTITION BY {keys} ORDER BY {ts}) + INTERVAL {gap_hours} HOUR THEN 1 ELSE 0 END AS opens
   FROM {source}),
 s AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY {ts}) AS sid FROM o)
SELECT min({ts}) AS window_start, max({ts}) + INTERVAL {gap_hours} HOUR AS window_end, {keys}, {aggs}
FROM s GROUP BY {keys}, sid"""


@query("window_session", session_sql(12, "user_id", "count(*) AS n, round(sum(value), 4) AS total"))
def window_session(t):
    return W.session(t.events, "ts", "12 hours", ["user_id"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})


CUMULATE = f"""
WITH x AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) AS window_start FROM events),
 y AS (SELECT *, unnest(generate_series(CAST(floor((epoch_us(ts) - epoch_us(window_start)) / 21600000000) AS BIGINT) + 1, 4)) AS k FROM x)
SELECT window_start, window_start + k * INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n,
 round(sum(value), 4) AS total FROM y GROUP BY window_start, k, event_type"""


@query("window_cumulate", CUMULATE)
def window_cumulate(t):
    return W.cumulate(t.events, "ts", "6 hours", "1 day", ["event_type"],
                      {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})


@query("window_multi", f"""
SELECT '1 hour' AS window_size, time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}) AS window_start,
 time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}) + INTERVAL 1 HOUR AS window_end, user_id, count(*) AS n FROM events GROUP BY 1, 2, 3, 4
UNION ALL SELECT '1 day', time_bucket(INTERVAL 1 DAY, ts, {EPOCH}),
 time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) + INTERVAL 1 DAY, user_id, count(*) FROM events GROUP BY 1, 2, 3, 4""")
def window_multi(t):
    return W.multi_tumble(t.events, "ts", ["1 hour", "1 day"], ["user_id"], {"n": F.count("*")})


@query("window_filter", f"""
SELECT time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) AS window_start, time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) + INTERVAL 1 DAY AS window_end,
 user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND sum(value) >= 100""")
def window_filter(t):
    return (W.tumble(t.events, "ts", "1 day", ["user_id"], {"n": F.count("*"), "total": F.sum("value")})
            .where("n >= 5 AND total >= 100").withColumn("total", F.round("total", 4)))


@query("window_prefilter", f"""
SELECT time_bucket(INTERVAL 6 HOUR, ts, {EPOCH}) AS window_start, time_bucket(INTERVAL 6 HOUR, ts, {EPOCH}) + INTERVAL 6 HOUR AS window_end,
 event_type, count(*) AS n FROM events WHERE value > 5 AND user_id IS NOT NULL GROUP BY 1, 2, 3""")
def window_prefilter(t):
    return W.tumble(t.events.where("value > 5 AND user_id IS NOT NULL"), "ts", "6 hours", ["event_type"], {"n": F.count("*")})


@query("window_max_string", f"""
SELECT time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) AS window_start, time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) + INTERVAL 1 DAY AS window_end,
 user_id, max(event_type) AS top_type FROM events GROUP BY 1, 2, 3""")
def window_max_string(t):
    return W.tumble(t.events, "ts", "1 day", ["user_id"], {"top_type": F.max("event_type")})


def changelog(events):
    """Events as a changelog per user: signup inserts, error deletes, everything else updates."""
    kind = F.when(F.col("event_type") == "signup", "+I").when(F.col("event_type") == "error", "-D").otherwise("+U")
    return events.select("user_id", "ts", "event_id", kind.alias("row_kind"), "value")


@query("changelog_upsert", """
SELECT user_id, ts, event_id, row_kind, value FROM (SELECT user_id, ts, event_id,
  CASE event_type WHEN 'signup' THEN '+I' WHEN 'error' THEN '-D' ELSE '+U' END AS row_kind, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1 AND row_kind <> '-D'""")
def changelog_upsert(t):
    return keyed.changelog_normalize(changelog(t.events), ["user_id"], ["ts"], "upsert")


@query("changelog_retract", """
WITH c AS (SELECT user_id, ts AS change_ts, event_id, value, event_type = 'error' AS gone,
  lag(event_id) OVER w AS pid, lag(value) OVER w AS pv, lag(ts) OVER w AS pts,
  coalesce(lag(event_type) OVER w <> 'error', false) AS alive FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, change_ts, '+I' AS row_kind, change_ts AS ts, event_id, value FROM c WHERE NOT gone AND NOT alive
UNION ALL SELECT user_id, change_ts, '-U', pts, pid, pv FROM c WHERE NOT gone AND alive
UNION ALL SELECT user_id, change_ts, '+U', change_ts, event_id, value FROM c WHERE NOT gone AND alive
UNION ALL SELECT user_id, change_ts, '-D', pts, pid, pv FROM c WHERE gone AND alive""")
def changelog_retract(t):
    return keyed.changelog_normalize(changelog(t.events), ["user_id"], ["ts"], "retract")


@query("changelog_append", """
SELECT user_id, ts, event_id, '+I' AS row_kind, value FROM events WHERE event_type = 'signup'""")
def changelog_append(t):
    return keyed.changelog_normalize(changelog(t.events), ["user_id"], ["ts"], "append")


@query("cdc_decode", """
SELECT event_id, ts, '+I' AS row_kind, user_id, value FROM events WHERE event_type IN ('signup', 'view')
UNION ALL SELECT event_id, ts, '-U', user_id, value - 1 FROM events WHERE event_type IN ('click', 'purchase')
UNION ALL SELECT event_id, ts, '+U', user_id, value FROM events WHERE event_type IN ('click', 'purchase')
UNION ALL SELECT event_id, ts, '-D', user_id, value - 1 FROM events WHERE event_type = 'error'""")
def cdc_decode(t):
    op = (F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "view", "r")
          .when(F.col("event_type") == "error", "d").otherwise("u"))
    raw = t.events.select("event_id", "ts", op.alias("op"),
                          F.struct("user_id", (F.col("value") - 1).alias("value")).alias("before"),
                          F.struct("user_id", "value").alias("after"))
    return keyed.decode_cdc(raw)


@query("upsert_latest", """
WITH l AS (SELECT user_id AS c_custkey, value AS c_acctbal FROM (SELECT user_id, value,
   row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1)
SELECT coalesce(l.c_custkey, c.c_custkey) AS c_custkey, coalesce(l.c_acctbal, c.c_acctbal) AS c_acctbal
FROM customer c FULL JOIN l ON c.c_custkey = l.c_custkey""")
def upsert_latest(t):
    changes = t.events.selectExpr("user_id AS c_custkey", "value AS c_acctbal", "ts")
    target = t.customer.selectExpr("c_custkey", "c_acctbal", "CAST(NULL AS TIMESTAMP_NTZ) AS ts")
    return keyed.upsert_latest(changes, target, ["c_custkey"], ["ts"]).drop("ts")


@query("dml_rewrite", """
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN 'DOUBLED' ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)""")
def dml_rewrite(t):
    gone = t.orders.where("o_totalprice > 480000").selectExpr("o_custkey AS c_custkey")
    kept = keyed.delete_keys(t.customer, gone, ["c_custkey"])
    return keyed.update_rows(kept, "c_mktsegment = 'MACHINERY'",
                             {"c_acctbal": "c_acctbal * 2", "c_mktsegment": "'DOUBLED'"})
