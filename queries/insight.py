"""Result analytics, schema checks, stream health and lineage."""

from pyspark.sql import functions as F

from millrace.operators import analytics as A, health as H, lineage as LN, schema_ops as SO, windows as W
from queries.registry import query


@query("chart_agg", """
SELECT event_type, count(*) AS value_count, round(sum(value), 4) AS value_sum, round(avg(value), 8) AS value_avg,
 max(value) AS value_max, min(value) AS value_min, arg_max(value, event_id) AS value_last FROM events GROUP BY event_type""")
def chart_agg(t):
    out = A.chart_agg(t.events, "event_type", [("value", a) for a in A.AGGREGATES], order="event_id")
    return out.withColumns({"value_sum": F.round("value_sum", 4), "value_avg": F.round("value_avg", 8)})


@query("chart_dual", """
SELECT CAST(p_size AS VARCHAR) AS p_size, round(avg(p_retailprice), 8) AS p_retailprice_avg, count(*) AS p_partkey_count
FROM part GROUP BY p_size""")
def chart_dual(t):
    out = A.chart_agg(t.part, "p_size", [("p_retailprice", "avg"), ("p_partkey", "count")])
    return out.withColumn("p_retailprice_avg", F.round("p_retailprice_avg", 8))


@query("histogram", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1""")
def histogram(t):
    return A.histogram(t.lineitem, "l_extendedprice", 20).select("bin", "n")


@query("heatmap_norm", """
WITH b AS (SELECT greatest(max(value), 1) AS hi, least(min(value), 0) AS lo FROM events)
SELECT event_id, value, round((value - lo) / (hi - lo), 8) AS norm FROM events, b""")
def heatmap_norm(t):
    return A.heatmap_norm(t.events, "event_id", "value").withColumn("norm", F.round("norm", 8))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE" if a == b else f"round(coalesce(corr({a}, {b}), 0), 8)") + " AS r FROM lineitem"
    + " HAVING count(*) > 0" for a in CORR for b in CORR))
def corr_matrix(t):
    return A.corr_matrix(t.lineitem, CORR).withColumn("r", F.round("r", 8))


@query("corr_candidates", """
WITH e AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS VARCHAR) AS value, event_type,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(value AS VARCHAR) ELSE event_type END AS mixed,
  CASE WHEN event_type = 'click' THEN CAST(value AS VARCHAR) ELSE event_type END AS rarely FROM events),
 c AS (SELECT unnest(['event_id', 'user_id', 'value', 'event_type', 'mixed', 'rarely']) AS name, unnest([event_id, user_id, value, event_type, mixed, rarely]) AS x FROM e)
SELECT name AS "column", count(TRY_CAST(x AS DOUBLE)) / count(*) AS share FROM c GROUP BY name HAVING count(TRY_CAST(x AS DOUBLE)) / count(*) > 0.4""")
def corr_candidates(t):
    e = t.events.select("event_id", "user_id", "value", "event_type", "ts")
    text = F.col("value").cast("string")
    return A.mostly_numeric(e.withColumns({"mixed": F.when(F.col("event_type").isin("click", "view", "purchase"), text).otherwise(F.col("event_type")),
                                           "rarely": F.when(F.col("event_type") == "click", text).otherwise(F.col("event_type"))}))


RULES = [
    {"field": "value", "op": ">=", "value": "200", "label": "huge", "colour": "red"},
    {"field": "nowhere", "op": "==", "value": "1", "label": "never", "colour": "black"},
    {"field": "event_type", "op": "==", "value": "error", "label": "failed", "colour": "orange"},
    {"field": "event_type", "op": "regex", "value": "^PUR.*e$", "label": "bought", "colour": "green"},
    {"field": "props", "op": "contains", "value": "\"K\": 7", "label": "seven", "colour": "blue"},
    {"field": "event_type", "op": "regex", "value": "([", "label": "broken", "colour": "black"},
    {"field": "value", "op": "==", "value": "1.5", "label": "exact", "colour": "violet"},
    {"field": "event_type", "op": "starts", "value": "SIGN", "label": "new", "colour": "cyan"},
    {"field": "event_type", "op": ">", "value": "a", "label": "text", "colour": "black"},
    {"field": "event_type", "op": "ends", "value": "EW", "label": "seen", "colour": "grey"},
]
RULE_CASE = """CASE WHEN value >= 200 THEN 'huge:red' WHEN event_type = 'error' THEN 'failed:orange'
 WHEN event_type = 'purchase' THEN 'bought:green' WHEN contains(lower(props), '"k": 7') THEN 'seven:blue'
 WHEN value = 1.5 THEN 'exact:violet' WHEN event_type = 'signup' THEN 'new:cyan' WHEN event_type = 'view' THEN 'seen:grey' END"""


@query("row_rules", f"""
SELECT event_id, split_part({RULE_CASE}, ':', 1) AS rule, split_part({RULE_CASE}, ':', 2) AS colour FROM events""")
def row_rules(t):
    return A.row_rules(t.events, RULES).select("event_id", "rule", "colour")


@query("row_rules_summary", f"""
SELECT split_part({RULE_CASE}, ':', 1) AS rule, count(*) AS n FROM events GROUP BY 1""")
def row_rules_summary(t):
    return A.row_rules(t.events, RULES).groupBy("rule").agg(F.count("*").alias("n"))


@query("perf_delta", """
SELECT o_orderkey, o_custkey, round(o_orderkey / o_totalprice, 8) AS rows_per_s, round((o_totalprice - lag(o_totalprice) OVER w)
  / lag(o_totalprice) OVER w * 100, 6) AS delta_pct
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def perf_delta(t):
    # orders as runs: price is the duration, the key the row count
    runs = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return H.run_deltas(runs, ["o_custkey"], "o_orderkey", "o_totalprice", "o_orderkey").select(
        "o_orderkey", "o_custkey", F.round("rows_per_s", 8).alias("rows_per_s"), F.round("delta_pct", 6).alias("delta_pct"))


# A schema subject per document: two versions whose fields depend on the document.
def _avro(version):
    lang_type = "CASE WHEN doc_id % 3 = 0 THEN '\"int\"' WHEN doc_id % 3 = 1 THEN '\"float\"' ELSE '[\"null\",\"string\"]' END"
    if version == 2:
        lang_type = "CASE WHEN doc_id % 3 = 0 THEN '\"long\"' WHEN doc_id % 3 = 1 THEN '\"string\"' ELSE '\"string\"' END"
    second = "'{\"name\":\"size\",\"type\":\"long\"}'" if version == 1 else \
        "CASE WHEN lang = 'en' THEN '{\"name\":\"extra\",\"type\":\"int\",\"default\":null}' ELSE '{\"name\":\"extra\",\"type\":\"int\"}' END"
    return f"""concat('{{"type":"record","name":"d","fields":[{{"name":"lang","type":', {lang_type}, '}},', {second}, ']}}')"""


@query("schema_diff", """
SELECT doc_id, 'lang' AS name, 'changed' AS change, CASE doc_id % 3 WHEN 0 THEN 'int' ELSE 'float' END AS old_type,
 CASE doc_id % 3 WHEN 0 THEN 'long' ELSE 'string' END AS new_type, doc_id % 3 = 1 AS breaking FROM documents WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, 'size', 'removed', 'long', NULL, true FROM documents
UNION ALL SELECT doc_id, 'extra', 'added', NULL, 'int', lang <> 'en' FROM documents""")
def schema_diff(t):
    d = t.documents.select("doc_id", "lang")
    old, new = [SO.field_table(d.select("doc_id", F.expr(_avro(v)).alias("schema")), "doc_id", "schema") for v in (1, 2)]
    return SO.schema_diff(old, new, "doc_id")


@query("schema_validate", """
SELECT doc_id, 'lang' AS name, 'type mismatch' AS issue, 'err' AS level, 'STRING' AS declared,
 CASE doc_id % 3 WHEN 0 THEN 'int' ELSE 'float' END AS registered FROM documents WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, 'size', 'missing column', 'warn', NULL, 'long' FROM documents
UNION ALL SELECT doc_id, 'Other', 'unknown column', 'warn', 'INT', NULL FROM documents""")
def schema_validate(t):
    registry = SO.field_table(t.documents.select("doc_id", F.expr(_avro(1)).alias("schema")), "doc_id", "schema")
    declared = t.documents.select("doc_id", F.explode(F.array(
        F.struct(F.lit("LANG").alias("name"), F.lit("STRING").alias("type")),
        F.struct(F.lit("Other").alias("name"), F.lit("INT").alias("type")))).alias("c")).select("doc_id", "c.*")
    return SO.schema_validate(declared, registry, "doc_id").withColumn(
        "name", F.when(F.col("name") == "LANG", "lang").otherwise(F.col("name")))


# Metrics derived from events: a job per user, an operator per event type, a snapshot per day.
METRICS = """m AS (SELECT user_id AS query, event_type AS operator, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS ts,
  CASE event_type WHEN 'signup' THEN 'source' WHEN 'purchase' THEN 'sink' ELSE 'process' END AS kind,
  count(*) * 60.0::DOUBLE AS rows_in, count(CASE WHEN value > 60 THEN 1 END) * 60.0::DOUBLE AS rows_out, least(100.0::DOUBLE, max(value)) AS backpressure,
  greatest(0.0::DOUBLE, 100.0::DOUBLE - round(sum(value), 4)) AS idle, count(*) * 60 AS late, CAST(floor(round(sum(value), 4) * 300) AS BIGINT) AS checkpoint_ms
  FROM events GROUP BY 1, 2, 3, 4)"""


def metrics(t):
    kind = F.when(F.col("event_type") == "signup", "source").when(F.col("event_type") == "purchase", "sink").otherwise("process")
    e = t.events.select(F.col("user_id").alias("query"), F.col("event_type").alias("operator"), kind.alias("kind"), "value", "ts")
    total = F.round(F.sum("value"), 4)
    m = W.tumble(e, "ts", "1 day", ["query", "operator", "kind"], {
        "rows_in": F.count("*") * F.lit(60.0), "rows_out": F.count_if(F.col("value") > 60) * F.lit(60.0),
        "backpressure": F.least(F.lit(100.0), F.max("value")), "idle": F.greatest(F.lit(0.0), F.lit(100.0) - total),
        "late": F.count("*") * 60, "checkpoint_ms": F.floor(total * 300)})
    return m.withColumnRenamed("window_start", "ts").drop("window_end")


SEVERITY = "CASE WHEN {0} < 5 THEN 'none' WHEN {0} < 25 THEN 'low' WHEN {0} < 60 THEN 'medium' WHEN {0} < 85 THEN 'high' ELSE 'critical' END"
WORST = """w AS (SELECT query, ts, operator, kind, backpressure, row_number() OVER (PARTITION BY query, ts ORDER BY backpressure DESC, operator) AS rn
  FROM m WHERE kind <> 'source' AND backpressure > 0),
 s AS (SELECT k.query, k.ts, w.operator AS bottleneck, w.kind AS bottleneck_kind, coalesce(w.backpressure, 0) AS bp
  FROM (SELECT DISTINCT query, ts FROM m) k LEFT JOIN w ON k.query = w.query AND k.ts = w.ts AND rn = 1)"""


@query("health_bottleneck", f"""WITH {METRICS}, {WORST}
SELECT query, ts, bottleneck, bottleneck_kind, CAST(round(bp) AS INTEGER) AS severity_score, {SEVERITY.format('bp')} AS severity FROM s""")
def health_bottleneck(t):
    return H.bottlenecks(metrics(t)).drop("rows_in", "rows_out")


@query("health_findings", f"""WITH {METRICS}, {WORST}, f AS (SELECT m.*, bottleneck, bp >= 5 AS troubled, operator = bottleneck AND bp >= 5 AS here,
  rows_out / rows_in < 0.3 AND rows_in > 100 AS starved FROM m JOIN s USING (query, ts))
SELECT query, ts, operator, 'warn' AS level, 'slow checkpoints' AS title FROM f WHERE checkpoint_ms > 30000
UNION ALL SELECT query, ts, operator, 'high', 'sink bottleneck' FROM f WHERE here AND kind = 'sink'
UNION ALL SELECT query, ts, operator, 'high', 'processing bottleneck' FROM f WHERE here AND kind <> 'sink' AND starved
UNION ALL SELECT query, ts, operator, 'high', 'bottleneck' FROM f WHERE here AND kind <> 'sink' AND NOT starved
UNION ALL SELECT query, ts, operator, 'info', 'idle source' FROM f WHERE troubled AND kind = 'source' AND idle > 80
UNION ALL SELECT query, ts, operator, 'warn', 'late records' FROM f WHERE troubled AND late > 100""")
def health_findings(t):
    return H.findings(metrics(t))


@query("health_watermark", """
WITH x AS (SELECT user_id, ts, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS wm FROM events),
 y AS (SELECT *, min(wm) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS low FROM x),
 z AS (SELECT *, max(CASE WHEN low IS NULL OR low < wm THEN ts END) OVER (PARTITION BY user_id ORDER BY ts) AS adv FROM y)
SELECT user_id, ts, (epoch_us(ts) - epoch_us(wm)) / 1000000.0::DOUBLE AS lag_s, CASE WHEN epoch_us(ts) - epoch_us(wm) < 5000000 THEN 'green'
 WHEN epoch_us(ts) - epoch_us(wm) < 30000000 THEN 'yellow' ELSE 'red' END AS band, ts > adv + INTERVAL 6 HOUR AS stalled FROM z""")
def health_watermark(t):
    m = t.events.select("user_id", "ts", F.window("ts", "1 day")["start"].alias("watermark"))
    return H.watermark_health(m, ["user_id"], stall="6 hours")


@query("health_replay", f"""WITH {METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY query, operator ORDER BY ts DESC) AS rn FROM m
  WHERE ts <= TIMESTAMP '2024-01-15'), p AS (SELECT query, operator, max(backpressure) AS peak_backpressure FROM m GROUP BY 1, 2)
SELECT query, operator, ts, backpressure, peak_backpressure FROM r JOIN p USING (query, operator) WHERE rn = 1""")
def health_replay(t):
    m = metrics(t)
    now = H.snapshot_at(m, ["query", "operator"], "2024-01-15").select("query", "operator", "ts", "backpressure")
    return now.join(H.peaks(m, ["query", "operator"], ["backpressure"]), ["query", "operator"])


@query("health_compare", """
WITH b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket,
 round(avg(CASE WHEN event_type = 'click' THEN value END), 8) AS q_click, round(avg(CASE WHEN event_type = 'view' THEN value END), 8) AS q_view
 FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT * FROM b""")
def health_compare(t):
    out = H.compare_queries(t.events, "ts", "6 hours", "value", ["click", "view"], name="event_type")
    return out.select("bucket", F.round("q_click", 8).alias("q_click"), F.round("q_view", 8).alias("q_view"))


# jobs are orders, topics are customers: urgent orders read, the others write
def lineage_edges(t):
    return t.orders.select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("topic"),
                           F.when(F.col("o_orderpriority") == "1-URGENT", "read").otherwise("write").alias("direction"))


@query("lineage_dead_end", """
SELECT DISTINCT o_custkey AS topic FROM orders WHERE o_orderpriority <> '1-URGENT'
 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def lineage_dead_end(t):
    return LN.dead_ends(lineage_edges(t))


@query("lineage_shared", """
SELECT o_custkey AS topic, count(DISTINCT o_orderkey) AS readers FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1
HAVING count(DISTINCT o_orderkey) > 1""")
def lineage_shared(t):
    return LN.shared_sources(lineage_edges(t))


# documents form a tree towards document 0; toxic ones also point back from their parent
@query("lineage_cycle", """
WITH RECURSIVE e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0
   UNION SELECT doc_id // 2, doc_id FROM labels WHERE toxic = 1 AND doc_id > 0),
 c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src),
 k AS (SELECT a AS n FROM c WHERE a = b),
 core AS (SELECT n FROM k UNION (SELECT c1.b FROM c c1 JOIN k ON c1.a = k.n INTERSECT SELECT c2.a FROM c c2 JOIN k ON c2.b = k.n))
SELECT src, dst FROM e WHERE src IN (SELECT n FROM core) AND dst IN (SELECT n FROM core)""")
def lineage_cycle(t):
    tree = t.documents.where("doc_id > 0").selectExpr("doc_id AS src", "doc_id div 2 AS dst")
    back = t.labels.where("toxic = 1 AND doc_id > 0").selectExpr("doc_id div 2 AS src", "doc_id AS dst")
    return LN.cyclic_core(tree.union(back))
