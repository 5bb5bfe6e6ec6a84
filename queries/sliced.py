"""The same queries with nearly every key treated as busy, so that the path for large keys is checked too.

OVER queries cut the table into ``PARTS`` ranges, the others treat keys above ``HOT`` rows as busy.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins as J, keyed, over, patterns as P, relational as rel, windows as W
from queries import aggregates, cep, joins_q, windows_time  # noqa: F401 - their SQL is used below
from queries.cep import EV
from queries.joins_q import _sides
from queries.registry import ORACLE, query

HOT, PARTS = 20, 1000


@query("win_rank_sliced", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn,
 rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr FROM events""")
def win_rank_sliced(t):
    rows = t.events.select("event_id", "user_id", "value", "event_type")
    ranked = over.rank_over(rows, ["user_id"], ["event_type"], {"rk": "rank", "dr": "dense_rank"}, PARTS)
    return (over.rank_over(ranked, ["user_id"], ["-value", "event_id"], {"rn": "row_number"}, PARTS)
            .select("event_id", "rn", "rk", "dr"))


@query("win_dist_sliced", ORACLE["win_dist"])
def win_dist_sliced(t):
    ranked = over.rank_over(t.events.select("event_id", "user_id", "value"), ["user_id"], ["value"],
                            {"pr": "percent_rank", "cd": "cume_dist"}, PARTS)
    return ranked.select("event_id", F.round("pr", 8).alias("pr"), F.round("cd", 8).alias("cd"))


@query("win_running_sliced", ORACLE["win_running"])
def win_running_sliced(t):
    out = over.running(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts"],
                       {"total": ("sum", "value"), "n": ("count", "event_id"), "hi": ("max", "value"), "mean": ("avg", "value")}, PARTS)
    return out.select("event_id", F.round("total", 4).alias("total"), "n", "hi", F.round("mean", 9).alias("mean"))


@query("win_lag_sliced", ORACLE["win_lag_lead"])
def win_lag_sliced(t):
    return over.shift(t.events.select("event_id", "user_id", "ts", "value", "event_type"), ["user_id"], ["ts"],
                      {"prev": ("lag", "value", 1), "prev2": ("lag", "event_type", 2, "none"), "next": ("lead", "value", 1, -1.0)},
                      PARTS).select("event_id", "prev", "prev2", "next")


@query("join_asof_sliced", ORACLE["join_asof"])
def join_asof_sliced(t):
    b, c = _sides(t)
    return J.asof_join(b, c.select("user_id", "click_id", "click_ts"), ["user_id"], "buy_ts", "click_ts", slice_width="1 day", hot_rows=HOT).select(
        "user_id", "buy_id", "click_id", "click_ts")


@query("session_sliced", ORACLE["window_session"])
def session_sliced(t):
    return W.session(t.events, "ts", "12 hours", ["user_id"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)}, "1 day", HOT)


@query("cep_sequence_sliced", ORACLE["cep_sequence"])
def cep_sequence_sliced(t):
    return cep.spikes(t.events, slice_width="1 day", hot_rows=HOT).select(
        "user_id", F.col("event_id").alias("id1"), F.col("m_B.event_id").alias("id2"), F.col("m_C.event_id").alias("id3"),
        F.col("ts").alias("match_start"), F.col("m_C.ts").alias("match_end"))


@query("cep_plus_sliced", ORACLE["cep_plus"])
def cep_plus_sliced(t):
    out = P.match_pattern(t.events.select(*EV), ["user_id"], "ts", "B+ C",
                          {"B": "event_type IN ('click', 'view')", "C": "event_type = 'purchase'"}, "60 days", hot_rows=HOT)
    return out.select("user_id", F.col("first_B.event_id").alias("first_id"), F.col("count_B").alias("n"), F.col("first_C.event_id").alias("end_id"))


@query("win_text_order", """
SELECT event_id, lag(event_id) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type, event_id)""")
def win_text_order(t):
    rows = over.shift(t.events.select("event_id", "user_id", "event_type"), ["user_id"], ["event_type", "event_id"], {"prev": ("lag", "event_id", 1)}, PARTS)
    return over.rank_over(rows, ["user_id"], ["event_type", "event_id"], {"rn": "row_number"}, PARTS).select("event_id", "prev", "rn")


@query("topn_large", """
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
 ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 1500""")
def topn_large(t):
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return keyed.top_n(rows, ["l_returnflag"], ["-l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], 1500).drop("l_returnflag")


@query("page_large", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 7000 OFFSET 1000")
def page_large(t):
    return rel.page(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"], 1001, 8000)


@query("win_last_value", """
SELECT event_id, max(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS last_id FROM events""")
def win_last_value(t):
    # the default frame ends with the peers of the day, of which the greatest id is the last
    rows = t.events.select("event_id", "user_id", F.to_date("ts").alias("day"))
    return over.last_values(rows, ["user_id"], ["day"], {"last_id": "event_id"}, tie=["event_id"]).select("event_id", "last_id")


@query("win_window_clause", """
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, count(*) OVER w AS n
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_window_clause(t):
    return t.sql("""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, count(*) OVER w AS n
                    FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""", "orders")


@query("fn_json_brackets", """
WITH d AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"a":"[x] hello"}' WHEN event_id % 3 = 1 THEN '{"a":{"b":1}}' ELSE '{"a":"{y"}' END AS doc FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[x] hello' WHEN event_id % 3 = 2 THEN '{y' END AS val,
 CASE WHEN event_id % 3 = 1 THEN '{"b":1}' END AS obj FROM d""")
def fn_json_brackets(t):
    from millrace.functions import scalar as S
    doc = (F.when(F.col("event_id") % 3 == 0, '{"a":"[x] hello"}').when(F.col("event_id") % 3 == 1, '{"a":{"b":1}}').otherwise('{"a":"{y"}'))
    return t.events.select("event_id", doc.alias("doc")).select("event_id", S.json_value("doc", "$.a").alias("val"), S.json_query("doc", "$.a").alias("obj"))
