"""Sources, sinks, branches and pipeline specs."""

from pyspark.sql import functions as F

from millrace import session
from millrace.operators import relational as rel
from millrace.plans.spec import Pipeline
from millrace.sources import readers, sinks
from millrace.sources.feature_kv import FeatureStore
from queries.registry import query

def mixed_sql(column: str, seed: int) -> str:
    """The generator's numbers in SQL: the first 60 bits of an MD5."""
    return f"CAST('0x' || substr(md5(CAST({column} AS VARCHAR) || ':{seed}'), 1, 15) AS BIGINT)"


@query("src_datagen", f"""
SELECT event_id, event_id + 100 AS seq, 1 + {mixed_sql('event_id', 32)} % 50 AS user_no,
 round(5.0::DOUBLE + {mixed_sql('event_id', 63)} / 1152921504606846975.0::DOUBLE * 95.0::DOUBLE, 6) AS price,
 {mixed_sql('event_id', 94)} % 2 = 0 AS flag FROM events""")
def src_datagen(t):
    fields = {"seq": {"kind": "sequence", "start": 100}, "user_no": {"min": 1, "max": 50},
              "price": {"type": "DOUBLE", "min": 5, "max": 100}, "flag": {"type": "BOOLEAN"}}
    return (readers.with_generated(t.events.select("event_id"), "event_id", fields, seed=1)
            .withColumn("price", F.round("price", 6)))


@query("src_filesystem", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 30")
def src_filesystem(t):
    df = readers.filesystem(t.spark, f"{t.sf_dir}/lineitem.parquet")
    return df.where("l_quantity > 30").select("l_orderkey", "l_partkey", "l_quantity")


@query("src_table", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def src_table(t):
    session.register_views(t.spark, t.sf_dir, ("customer", "nation", "region"))
    c, n, r = (readers.catalog_table(t.spark, x) for x in ("customer", "nation", "region"))
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .groupBy("n_name", "r_name").agg(F.count("*").alias("customers")))


@query("src_values", """
SELECT label, count(*) AS n FROM events JOIN (VALUES ('click', 'light'), ('view', 'light'), ('purchase', 'money')) v(kind, label)
 ON event_type = kind GROUP BY label""")
def src_values(t):
    labels = readers.values(t.spark, [("click", "light"), ("view", "light"), ("purchase", "money")], "kind STRING, label STRING")
    return (t.events.join(F.broadcast(labels), F.col("event_type") == F.col("kind"))
            .groupBy("label").agg(F.count("*").alias("n")))


@query("src_kafka_decode", """
SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 10 <> 3""")
def src_kafka_decode(t):
    # messages as the broker would hold them; some are broken on purpose and must be left out
    good = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    raw = t.events.select(F.col("user_id").cast("string").cast("binary").alias("key"),
                          F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(good).cast("binary").alias("value"))
    return readers.decode_messages(raw, "event_id BIGINT\nuser_id BIGINT\nevent_type STRING\nvalue DOUBLE")


@query("sink_roundtrip", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders""")
def sink_roundtrip(t):
    path = session.work_dir(t.spark, "orders")
    sinks.write_files(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path,
                      partition_by=["o_orderstatus"])
    return readers.filesystem(t.spark, path)


@query("sink_kafka_encode", """
SELECT '{"user_id":' || user_id || '}' AS key,
 '{"user_id":' || user_id || ',"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def sink_kafka_encode(t):
    return sinks.encode_messages(t.events.select("user_id", "event_id", "event_type"), ["user_id"])


@query("sink_upsert_encode", """
SELECT '{"user_id":' || user_id || '}' AS key, CASE WHEN event_type <> 'error' THEN
 '{"user_id":' || user_id || ',"event_id":' || event_id || '}' END AS value FROM events WHERE event_type <> 'view'""")
def sink_upsert_encode(t):
    kind = F.when(F.col("event_type") == "error", "-D").when(F.col("event_type") == "view", "-U").otherwise("+U")
    return sinks.encode_upserts(t.events.select("user_id", "event_id", kind.alias("row_kind")), ["user_id"])


@query("sink_result_output", "SELECT event_id, ts, value FROM events ORDER BY ts LIMIT 50")
def sink_result_output(t):
    sinks.result_output(t.events.select("event_id", "ts", "value"), "latest_result", 50, [F.col("ts")])
    return t.spark.table("latest_result")


@query("multi_sink_branches", """
SELECT 'large' AS branch, user_id, count(*) AS n FROM events WHERE value > 50 GROUP BY user_id
UNION ALL SELECT 'errors', user_id, count(*) FROM events WHERE event_type = 'error' GROUP BY user_id
UNION ALL SELECT 'all', user_id, count(*) FROM events GROUP BY user_id""")
def multi_sink_branches(t):
    path = session.work_dir(t.spark, "branches")

    def per_user(df):
        return df.groupBy("user_id").agg(F.count("*").alias("n"))

    def to(name):
        return lambda df: sinks.write_files(df, f"{path}/branch={name}")

    sinks.write_branches(t.events.select("user_id", "value", "event_type"), {
        "large": (lambda df: per_user(df.where("value > 50")), to("large")),
        "errors": (lambda df: per_user(df.where("event_type = 'error'")), to("errors")),
        "all": (per_user, to("all"))})
    return readers.filesystem(t.spark, path)


@query("sink_csv_export", "SELECT p_partkey, p_name, p_brand FROM part")
def sink_csv_export(t):
    path = session.work_dir(t.spark, "export")
    sinks.export_csv(t.part.select("p_partkey", "p_name", "p_brand"), path)
    return readers.filesystem(t.spark, path, "csv", "p_partkey BIGINT\np_name STRING\np_brand STRING", header=True)


SPEC = {
    "name": "errors per user and day",
    "nodes": [
        {"id": "src", "op": "input", "params": {"table": "events"}},
        {"id": "dim", "op": "input", "params": {"table": "customer"}},
        {"id": "big", "op": "filter", "params": {"condition": "value > 5"}},
        {"id": "who", "op": "enrich", "params": {"keys": ["user_id"], "columns": ["c_mktsegment"]}},
        {"id": "split", "op": "split", "params": {"routes": {"bad": "event_type = 'error'", "good": "event_type <> 'error'"}}},
        {"id": "daily", "op": "tumble_window", "params": {"time": "ts", "size": "1 day", "by": ["c_mktsegment"],
                                                         "aggs": {"n": "count(*)", "total": "round(sum(value), 4)"}}},
        {"id": "out", "op": "result_output", "params": {"name": "daily_errors"}},
        {"id": "drop", "op": "blackhole_sink"},
    ],
    "edges": [
        {"from": "src", "to": "big"}, {"from": "big", "to": "who", "type": "forward"},
        {"from": "dim", "to": "who", "port": "dim", "type": "broadcast"}, {"from": "who", "to": "split"},
        {"from": "split", "to": "daily", "route": "bad", "type": "hash", "keys": ["c_mktsegment"]},
        {"from": "split", "to": "drop", "route": "good", "type": "rebalance"}, {"from": "daily", "to": "out"},
    ],
}


@query("spec_job", """
SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start,
 time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end, c_mktsegment, count(*) AS n,
 round(sum(value), 4) AS total FROM events LEFT JOIN customer ON user_id = c_custkey
WHERE value > 5 AND event_type = 'error' GROUP BY 1, 2, 3""")
def spec_job(t):
    dim = t.customer.withColumnRenamed("c_custkey", "user_id")
    return Pipeline.from_dict(SPEC).build(t.spark, {"events": t.events, "customer": dim})["daily"]


@query("edge_repartition", """
SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_suppkey""")
def edge_repartition(t):
    # the hash edge already places the keys, so the aggregate adds no exchange
    moved = rel.redistribute(t.lineitem.select("l_suppkey", "l_quantity"), "hash", ["l_suppkey"])
    return moved.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("sink_feature_kv", """
WITH d AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS known, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT user_id, max(known) AS known, arg_max(n, known) AS n, arg_max(total, known) AS total FROM d WHERE known <= TIMESTAMP '2024-01-25' GROUP BY user_id
HAVING max(known) >= TIMESTAMP '2024-01-25' - INTERVAL 36 HOUR""")
def sink_feature_kv(t):
    """Daily features of users, put in two batches, as they are known at a time, if they are not older than 36 hours then."""
    t.spark.dataSource.register(FeatureStore)
    daily = t.events.groupBy("user_id", (F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("known")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    options = {"path": session.work_dir(t.spark, "features"), "keys": "user_id", "ts": "known"}
    for part in ("known >= '2024-01-15'", "known < '2024-01-15'"):
        daily.where(part).write.format("feature_kv").options(**options).mode("append").save()
    return t.spark.read.format("feature_kv").schema(daily.schema).options(**options, asOf="2024-01-25", ttl="36 hours").load()
