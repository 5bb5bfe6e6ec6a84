"""Joins: regular, theta, interval, as-of, lookup, lateral."""

from pyspark.sql import functions as F

from millrace.operators import joins as J, windows as W
from queries.registry import query

EPOCH = "TIMESTAMP '1970-01-01'"


@query("join_inner", """
SELECT o_orderkey, l_partkey, l_linenumber, o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'F'""")
def join_inner(t):
    o = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    l = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    return J.regular_join(o, l, o.o_orderkey == l.l_orderkey).select("o_orderkey", "l_partkey", "l_linenumber", "o_totalprice")


@query("join_left", """
SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000""")
def join_left(t):
    o = t.orders.where("o_totalprice > 300000").select("o_custkey", "o_orderkey")
    c = t.customer.select("c_custkey", "c_name")
    return J.regular_join(c, o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", "o_orderkey")


@query("join_right", """
SELECT l.doc_id AS labeled, d.doc_id, l.quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id""")
def join_right(t):
    l, d = t.labels.select(F.col("doc_id").alias("labeled"), "quality"), t.documents.select("doc_id")
    return J.regular_join(l, d, l.labeled == d.doc_id, "right").select("labeled", "doc_id", "quality")


@query("join_full", """
SELECT c_custkey, user_id, n FROM customer FULL OUTER JOIN
 (SELECT user_id + 75 AS user_id, count(*) AS n FROM events GROUP BY 1) e ON c_custkey = user_id""")
def join_full(t):
    e = t.events.groupBy((F.col("user_id") + 75).alias("user_id")).agg(F.count("*").alias("n"))
    c = t.customer.select("c_custkey")
    return J.regular_join(c, e, c.c_custkey == e.user_id, "full")


# both sides of the product are reports of a few rows
@query("join_cross", """
SELECT r_name, c_mktsegment, customers FROM region CROSS JOIN
 (SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment)""")
def join_cross(t):
    segments = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))
    return t.region.select("r_name").crossJoin(F.broadcast(segments))


@query("join_theta", """
SELECT c_custkey, s.c_mktsegment AS above FROM customer c
JOIN (SELECT c_mktsegment, avg(c_acctbal) AS mean FROM customer GROUP BY c_mktsegment) s ON c.c_acctbal > 1.5 * s.mean""")
def join_theta(t):
    # a range condition without an equality: one side is a row per market segment
    s = t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"))
    c = t.customer.select("c_custkey", "c_acctbal")
    s = J.broadcast_if_small(s.select(F.col("c_mktsegment").alias("above"), "mean"))
    return J.regular_join(c, s, c.c_acctbal > s.mean * 1.5).select("c_custkey", "above")


def _sides(t):
    e = t.events
    buys = e.where("event_type = 'purchase'").selectExpr("user_id", "event_id AS buy_id", "ts AS buy_ts", "value AS spend")
    clicks = e.where("event_type = 'click'").selectExpr("user_id", "event_id AS click_id", "ts AS click_ts", "value AS click_value")
    return buys, clicks


SIDES = """
WITH b AS (SELECT user_id, event_id AS buy_id, ts AS buy_ts, value AS spend FROM events WHERE event_type = 'purchase'),
 c AS (SELECT user_id, event_id AS click_id, ts AS click_ts, value AS click_value FROM events WHERE event_type = 'click')"""


@query("join_interval", SIDES + """
SELECT user_id, buy_id, click_id, spend FROM b JOIN c USING (user_id)
WHERE click_ts BETWEEN buy_ts - INTERVAL 12 HOUR AND buy_ts + INTERVAL 12 HOUR""")
def join_interval(t):
    b, c = _sides(t)
    return J.interval_join(b, c, ["user_id"], "buy_ts", "click_ts", "-12 hours", "12 hours").select(
        "user_id", "buy_id", "click_id", "spend")


@query("join_interval_left", SIDES + """
SELECT b.user_id, buy_id, click_id FROM b LEFT JOIN c ON b.user_id = c.user_id
 AND click_ts BETWEEN buy_ts - INTERVAL 6 HOUR AND buy_ts""")
def join_interval_left(t):
    b, c = _sides(t)
    return J.interval_join(b, c, ["user_id"], "buy_ts", "click_ts", "-6 hours", "0 seconds", "left").select(
        "user_id", "buy_id", "click_id")


@query("join_interval_right", SIDES + """
SELECT c.user_id, buy_id, click_id FROM b RIGHT JOIN c ON b.user_id = c.user_id
 AND click_ts BETWEEN buy_ts - INTERVAL 6 HOUR AND buy_ts""")
def join_interval_right(t):
    b, c = _sides(t)
    return J.interval_join(b, c, ["user_id"], "buy_ts", "click_ts", "-6 hours", "0 seconds", "right").select(
        "user_id", "buy_id", "click_id")


@query("interval_join_agg", SIDES + f"""
SELECT time_bucket(INTERVAL 1 DAY, buy_ts, {EPOCH}) AS window_start, time_bucket(INTERVAL 1 DAY, buy_ts, {EPOCH}) + INTERVAL 1 DAY AS window_end,
 user_id, count(DISTINCT click_id) AS clicks, count(DISTINCT buy_id) AS buys, round(sum(spend), 4) AS total
FROM b JOIN c USING (user_id) WHERE click_ts BETWEEN buy_ts - INTERVAL 12 HOUR AND buy_ts + INTERVAL 12 HOUR GROUP BY 1, 2, 3""")
def interval_join_agg(t):
    b, c = _sides(t)
    pairs = J.interval_join(b, c, ["user_id"], "buy_ts", "click_ts", "-12 hours", "12 hours")
    return W.tumble(pairs, "buy_ts", "1 day", ["user_id"], {
        "clicks": F.count_distinct("click_id"), "buys": F.count_distinct("buy_id"), "total": F.round(F.sum("spend"), 4)})


@query("join_asof", SIDES + """
SELECT b.user_id, buy_id, click_id, click_ts FROM b ASOF JOIN c ON b.user_id = c.user_id AND b.buy_ts >= c.click_ts""")
def join_asof(t):
    b, c = _sides(t)
    return J.asof_join(b, c.select("user_id", "click_id", "click_ts"), ["user_id"], "buy_ts", "click_ts").select(
        "user_id", "buy_id", "click_id", "click_ts")


@query("join_asof_left", SIDES + """
SELECT b.user_id, buy_id, click_id FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.buy_ts >= c.click_ts""")
def join_asof_left(t):
    b, c = _sides(t)
    return J.asof_join(b, c.select("user_id", "click_id", "click_ts"), ["user_id"], "buy_ts", "click_ts", "left").select(
        "user_id", "buy_id", "click_id")


@query("join_lookup", """
SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def join_lookup(t):
    dim = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    return J.lookup_join(t.orders.select("o_orderkey", "o_custkey"), dim, ["o_custkey"], ["c_name", "c_mktsegment"])


@query("enrich", """
SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_retailprice FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def enrich(t):
    dim = t.part.withColumnRenamed("p_partkey", "l_partkey")
    return J.lookup_join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), dim, ["l_partkey"],
                         ["p_brand", "p_retailprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_retailprice")


@query("join_broadcast", """
SELECT n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def join_broadcast(t):
    nation, region = J.broadcast_if_small(t.nation), J.broadcast_if_small(t.region)
    return (t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy("n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance")))


@query("join_using", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_using(t):
    return t.sql("SELECT doc_id, n_chars, quality, toxic FROM {documents} JOIN {labels} USING (doc_id)", "documents", "labels")


@query("join_natural", "SELECT doc_id, lang, toxic FROM documents NATURAL JOIN labels")
def join_natural(t):
    return t.sql("SELECT doc_id, lang, toxic FROM {documents} NATURAL JOIN {labels}", "documents", "labels")


@query("join_lateral", """
SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lang || ' ' || source, ' ')) AS w FROM documents) GROUP BY 1, 2""")
def join_lateral(t):
    return t.sql("""SELECT doc_id, w, count(*) AS n FROM {documents},
        LATERAL explode(split(lang || ' ' || source, ' ')) AS x(w) GROUP BY doc_id, w""", "documents")
