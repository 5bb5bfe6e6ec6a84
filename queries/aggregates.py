"""Group aggregates and OVER windows."""

from pyspark.sql import functions as F

from millrace.operators import over
from queries.registry import query


@query("group_agg", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def group_agg(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"),
        F.round(F.expr("sum(l_extendedprice * (1 - l_discount))"), 2).alias("revenue"),
        F.count("*").alias("n"))


@query("having", """
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id
HAVING count(*) > 60 AND sum(value) > 1000""")
def having(t):
    return (t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
            .where("n > 60 AND total > 1000").withColumn("total", F.round("total", 4)))


@query("group_agg_global", """
SELECT count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events
HAVING count(*) > 0""")
def group_agg_global(t):
    return t.events.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"),
                        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where("n > 0")


@query("agg_basic", """
SELECT event_type, count(*) AS n, count(value) AS nv, round(sum(value), 4) AS s, round(avg(value), 8) AS a,
  min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type""")
def agg_basic(t):
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("value").alias("nv"), F.round(F.sum("value"), 4).alias("s"),
        F.round(F.avg("value"), 8).alias("a"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("agg_count_distinct", """
SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def agg_count_distinct(t):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("agg_conditional", """
SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
  count(CASE WHEN value > 50 THEN 1 END) AS large FROM events GROUP BY user_id""")
def agg_conditional(t):
    return t.events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.expr("sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)").alias("purchases"),
        F.count_if(F.col("value") > 50).alias("large"))


@query("agg_rate", """
SELECT user_id, round(count(CASE WHEN event_type = 'error' THEN 1 END) * 100.0::DOUBLE / count(*), 6) AS error_pct,
  round(avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS large_pct
FROM events GROUP BY user_id""")
def agg_rate(t):
    return t.events.groupBy("user_id").agg(
        F.round(F.count_if(F.col("event_type") == "error") * F.lit(100.0) / F.count("*"), 6).alias("error_pct"),
        F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)) * 100, 6).alias("large_pct"))


@query("agg_filter", """
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled,
  round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open_value
FROM orders GROUP BY o_orderpriority""")
def agg_filter(t):
    return t.sql("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled,
        round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open_value
        FROM {orders} GROUP BY o_orderpriority""", "orders")


@query("agg_stddev", """
SELECT event_type, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type""")
def agg_stddev(t):
    return t.events.groupBy("event_type").agg(F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("agg_p99_est", """
SELECT l_shipdate, CAST(floor(avg(l_extendedprice) + 2.3::DOUBLE * stddev_pop(l_extendedprice)) AS BIGINT) AS p99_est,
  count(*) AS n FROM lineitem GROUP BY l_shipdate""")
def agg_p99_est(t):
    return t.lineitem.groupBy("l_shipdate").agg(
        F.floor(F.avg("l_extendedprice") + F.lit(2.3) * F.stddev_pop("l_extendedprice")).alias("p99_est"),
        F.count("*").alias("n"))


@query("agg_variance", """
SELECT event_type, round(var_pop(value), 4) AS vp, round(var_samp(value), 4) AS vs,
 round(stddev_samp(value), 6) AS ss FROM events GROUP BY event_type""")
def agg_variance(t):
    return t.events.groupBy("event_type").agg(
        F.round(F.var_pop("value"), 4).alias("vp"), F.round(F.var_samp("value"), 4).alias("vs"),
        F.round(F.stddev_samp("value"), 6).alias("ss"))


@query("agg_first", """
SELECT user_id, arg_min(event_type, ts) AS first_type, arg_max(event_type, ts) AS last_type FROM events GROUP BY user_id""")
def agg_first(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_type", "ts").alias("first_type"),
                                           F.max_by("event_type", "ts").alias("last_type"))


# an order has a handful of lines, so the gathered lists stay small
@query("agg_collect", """
SELECT l_orderkey, array_to_string(list_sort(list(l_partkey)), '|') AS parts FROM lineitem GROUP BY l_orderkey""")
def agg_collect(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("l_partkey")).cast("array<string>"), "|").alias("parts"))


@query("agg_listagg", """
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts
FROM lineitem GROUP BY l_orderkey""")
def agg_listagg(t):
    # WITHIN GROUP takes one order expression next to DISTINCT-free input; a struct sorts by all three
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(rows["l_partkey"].cast("array<string>"), ",").alias("parts"))


@query("win_rank", """
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, row_number() OVER w AS rn,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS rk,
  dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS dr
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber)""")
def win_rank(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity")
    ranked = over.rank_over(rows, ["l_suppkey"], ["-l_quantity"], {"rk": "rank", "dr": "dense_rank"})
    numbered = over.rank_over(ranked, ["l_suppkey"], ["-l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber"],
                              {"rn": "row_number"})
    return numbered.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "rn", "rk", "dr")


@query("win_ntile", """
SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY ts) AS q FROM events""")
def win_ntile(t):
    return over.rank_over(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts"],
                          {"q": "ntile(4)"}).select("event_id", "q")


@query("win_dist", """
SELECT event_id, round(percent_rank() OVER (PARTITION BY user_id ORDER BY value), 8) AS pr,
 round(cume_dist() OVER (PARTITION BY user_id ORDER BY value), 8) AS cd FROM events""")
def win_dist(t):
    ranked = over.rank_over(t.events.select("event_id", "user_id", "value"), ["user_id"], ["value"],
                            {"pr": "percent_rank", "cd": "cume_dist"})
    return ranked.select("event_id", F.round("pr", 8).alias("pr"), F.round("cd", 8).alias("cd"))


@query("win_lag_lead", """
SELECT event_id, lag(value) OVER w AS prev, lag(event_type, 2, 'none') OVER w AS prev2, lead(value, 1, -1.0) OVER w AS next
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def win_lag_lead(t):
    return over.shift(t.events.select("event_id", "user_id", "ts", "value", "event_type"), ["user_id"], ["ts"],
                      {"prev": ("lag", "value", 1), "prev2": ("lag", "event_type", 2, "none"),
                       "next": ("lead", "value", 1, -1.0)}).select("event_id", "prev", "prev2", "next")


@query("win_first_last", """
SELECT event_id, first_value(value) OVER w AS first_v, last_value(value) OVER w AS last_v
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def win_first_last(t):
    rows = t.events.select("event_id", "user_id", "ts", "value")
    # with a unique order the default frame ends at the current row, so LAST_VALUE is the row's own value
    return (over.nth_values(rows, ["user_id"], ["ts"], {"first_v": ("value", 1)})
            .select("event_id", "first_v", F.col("value").alias("last_v")))


@query("win_nth", """
SELECT event_id, nth_value(value, 3) OVER (PARTITION BY user_id ORDER BY ts) AS third FROM events""")
def win_nth(t):
    return over.nth_values(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts"],
                           {"third": ("value", 3)}).select("event_id", "third")


@query("win_running", """
SELECT event_id, round(sum(value) OVER w, 4) AS total, count(*) OVER w AS n, max(value) OVER w AS hi,
  round(avg(value) OVER w, 9) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def win_running(t):
    out = over.running(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts"],
                       {"total": ("sum", "value"), "n": ("count", "event_id"), "hi": ("max", "value"),
                        "mean": ("avg", "value")})
    return out.select("event_id", F.round("total", 4).alias("total"), "n", "hi", F.round("mean", 9).alias("mean"))


@query("win_range_interval", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW), 4) AS spend FROM events""")
def win_range_interval(t):
    return over.time_range(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "12 hours",
                           {"spend": F.sum("value")}).select("event_id", F.round("spend", 4).alias("spend"))


@query("win_rows_frame", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s,
  count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM events""")
def win_rows_frame(t):
    return over.rows_frame(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts"], 2, 1,
                           {"s": F.sum("value"), "n": F.count(F.lit(1))}).select(
        "event_id", F.round("s", 4).alias("s"), "n")


@query("win_named", """
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, count(*) OVER w AS n
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_named(t):
    # one named window, two functions: both come from a single pass
    out = over.running(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"),
                       ["o_custkey"], ["o_orderdate", "o_orderkey"],
                       {"running": ("sum", "o_totalprice"), "n": ("count", "o_orderkey")})
    return out.select("o_orderkey", F.round("running", 2).alias("running"), "n")
