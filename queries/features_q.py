"""Features, scoring and user-defined functions."""

import pandas as pd
from pyspark.sql import functions as F, types as T

from millrace.functions import library as L, scalar as S
from millrace.operators import features as FE, inference as I, windows as W
from queries.registry import query


def feats(df, *specs, time_column="ts"):
    return FE.add_features(df, [{"col": c, "kind": k, "param": p, "alias": a} for c, k, p, a in specs], time_column)


@query("feat_passthrough", "SELECT event_id, event_type AS kind FROM events")
def feat_passthrough(t):
    return feats(t.events, ("event_id", "passthrough", "", None), ("event_type", "passthrough", "", "kind"))


@query("feat_basic", """
SELECT event_id, CAST(user_id AS DOUBLE) AS uid, value * 2 + 1 AS m, coalesce(nullif(value, 1), 0.0) AS c1,
 coalesce(nullif(value, 2), -1.0) AS c2 FROM events""")
def feat_basic(t):
    e = t.events.selectExpr("*", "nullif(value, 1) AS v1", "nullif(value, 2) AS v2")
    return feats(e, ("event_id", "passthrough", "", None), ("user_id", "cast", "DOUBLE", "uid"),
                 ("value", "math", "value * 2 + 1", "m"), ("v1", "coalesce", "0D", "c1"), ("v2", "ifnull", "-1D", "c2"))


@query("feat_string", """
SELECT doc_id, upper(lang) AS u, lower(source) AS l, trim(' ' || lang || ' ') AS t, substr(source, 2, 4) AS s,
 substr(lang, 1, 3) AS d FROM documents""")
def feat_string(t):
    d = t.documents.selectExpr("doc_id", "lang", "source", "' ' || lang || ' ' AS padded")
    return feats(d, ("doc_id", "passthrough", "", None), ("lang", "upper", "", "u"), ("source", "lower", "", "l"),
                 ("padded", "trim", "", "t"), ("source", "substring", "2 FOR 4", "s"), ("lang", "substring", "", "d"))


@query("feat_math", """
SELECT event_id, round(value, 1) AS r, abs(value - 100) AS a, round(ln(value), 8) AS l FROM events""")
def feat_math(t):
    e = t.events.withColumn("off", F.col("value") - 100)
    return feats(e, ("event_id", "passthrough", "", None), ("value", "round", "1", "r"), ("off", "abs", "", "a"),
                 ("value", "log", "", "l")).withColumn("l", S.rounded("l", 8))


@query("feat_hash", "SELECT event_id, md5(CAST(user_id AS VARCHAR)) AS h FROM events")
def feat_hash(t):
    return feats(t.events, ("event_id", "passthrough", "", None), ("user_id", "hash_encode", "", "h"))


@query("feat_time", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, CAST(floor(epoch(ts)) AS BIGINT) AS e,
 strftime(make_timestamp(CAST(event_id * 3600000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS back FROM events""")
def feat_time(t):
    e = t.events.withColumn("secs", F.col("event_id") * 3600)
    return feats(e, ("event_id", "passthrough", "", None), ("ts", "date_format", "yyyy-MM-dd", "d"),
                 ("ts", "ts_to_epoch", "", "e"), ("secs", "epoch_to_ts", "", "back"))


@query("feat_lag", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS v_lag FROM events")
def feat_lag(t):
    return feats(t.events, ("event_id", "passthrough", "", None), ("value", "lag", "user_id", "v"))


@query("feat_norm", """
SELECT event_id, (value - 1.0::DOUBLE) / (500.0::DOUBLE - 1.0::DOUBLE) AS v_norm,
 round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)), 8) AS value_norm
FROM events""")
def feat_norm(t):
    fitted = FE.normalise_fitted(t.events, ["value"])
    return feats(fitted, ("event_id", "passthrough", "", None), ("value", "normalise", "1,500", "v"),
                 ("value_norm", "round", "8", None))


@query("feat_bucket", """
SELECT event_id, CASE WHEN value < 5 THEN 'bucket_0' WHEN value < 20 THEN 'bucket_1' WHEN value < 80 THEN 'bucket_2'
 ELSE 'bucket_3' END AS b FROM events""")
def feat_bucket(t):
    return feats(t.events, ("event_id", "passthrough", "", None), ("value", "bucket", "5, 20, 80", "b"))


@query("feat_custom", "SELECT event_id, CASE WHEN event_type = 'error' THEN -value ELSE value END AS signed FROM events")
def feat_custom(t):
    return feats(t.events, ("event_id", "passthrough", "", None),
                 ("", "custom", "if(event_type = 'error', -value, value)", "signed"))


@query("feat_select_numeric", "SELECT event_id, user_id, value FROM events")
def feat_select_numeric(t):
    return t.events.select(*FE.numeric_columns(t.events))


@query("feat_job", """
WITH f AS (SELECT *, coalesce(value, 0.0) AS v, CASE WHEN value < 10 THEN 'bucket_0' ELSE 'bucket_1' END AS size FROM events WHERE event_type <> 'view')
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
 time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end, size, count(*) AS n, round(sum(v), 4) AS total
FROM f GROUP BY 1, 2, 3 HAVING count(*) > 5""")
def feat_job(t):
    job = FE.FeatureJob(
        features=[{"col": "value", "kind": "coalesce", "param": "0D", "alias": "v"},
                  {"col": "value", "kind": "bucket", "param": "10", "alias": "size"}],
        windows=[{"type": "tumble", "size": "6 hours", "by": ["size"], "having": "n > 5",
                  "aggs": {"n": "count(*)", "total": "round(sum(v), 4)"}}],
        where="event_type <> 'view'", time_column="ts")
    return job.build(t.events)[0]


@query("feature_lookup", """
WITH b AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
 f AS (SELECT user_id, ts AS fts, value AS score FROM events WHERE event_type = 'view'),
 j AS (SELECT b.user_id, b.event_id, b.ts, f.fts, f.score FROM b ASOF LEFT JOIN f ON b.user_id = f.user_id AND b.ts >= f.fts)
SELECT user_id, event_id, CASE WHEN fts >= ts - INTERVAL 12 HOUR THEN score END AS score FROM j""")
def feature_lookup(t):
    buys = t.events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    versions = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("fts"), F.col("value").alias("score"))
    return FE.feature_lookup(buys, versions, ["user_id"], "ts", "fts", "12 hours").select("user_id", "event_id", "score")


@query("feat_rolling", """
WITH x AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 18 HOUR,
   time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), INTERVAL 6 HOUR)) AS w FROM events)
SELECT user_id, w + INTERVAL 24 HOUR AS feature_time, count(*) AS n, round(sum(value), 4) AS total, max(value) AS hi,
 round(avg(value), 8) AS mean, count(DISTINCT event_type) AS kinds FROM x GROUP BY user_id, w""")
def feat_rolling(t):
    return FE.rolling_features(t.events, "ts", ["user_id"], "6 hours", "24 hours", {
        "n": F.count("*"), "total": F.round(F.sum("value"), 4), "hi": F.max("value"), "mean": F.round(F.avg("value"), 8),
        "kinds": F.count_distinct("event_type")})


def linear_model(weights, bias):
    """Loader of a linear model over the input columns in order."""
    def load():
        def predict(frame: pd.DataFrame) -> pd.Series:
            return sum(frame[c].astype("float64") * w for c, w in zip(frame.columns, weights)) + bias
        return predict
    return load


@query("infer_linear", "SELECT event_id, user_id, round(value * 0.5 + user_id * 0.25 + 1.0, 6) AS score FROM events")
def infer_linear(t):
    return I.score(t.events, linear_model([0.5, 0.25], 1.0), ["value", "user_id"], passthrough=["event_id", "user_id"],
                   post="round(score, 6)", retries=1, on_error=-1.0)


@query("infer_filter", "SELECT event_id, round(value * 0.5 + 1.0, 6) AS score FROM events WHERE value * 0.5 + 1.0 > 20")
def infer_filter(t):
    return I.score(t.events, linear_model([0.5], 1.0), ["value"], passthrough=["event_id"], where="score > 20").withColumn(
        "score", F.round("score", 6))


@query("infer_model_table", "SELECT event_id, value, user_id, round(value * 0.5 + user_id * 0.25, 6) AS prediction, value > 50 AS outlier FROM events")
def infer_model_table(t):
    def load():
        def predict(frame):
            return pd.DataFrame({"prediction": (frame["value"] * 0.5 + frame["user_id"] * 0.25).round(6),
                                 "outlier": frame["value"] > 50})
        return predict
    return I.predict_table(t.events.select("event_id", "value", "user_id"), load, "prediction DOUBLE, outlier BOOLEAN")


@query("infer_array", "SELECT event_id, round((value + user_id) / 2.0::DOUBLE, 6) AS score FROM events")
def infer_array(t):
    def load(model, version):
        def predict(rows):
            return rows.map(lambda r: sum(r) / len(r) if model == "mean" and version == "1" else 0.0)
        return predict
    return I.score_array(t.events, load, ["value", "user_id"], "mean", "1").select("event_id", F.round("score", 6).alias("score"))


@query("infer_view", """
SELECT event_type, count(*) AS n, round(sum(value * 2.0), 4) AS total FROM events GROUP BY event_type""")
def infer_view(t):
    I.score(t.events, linear_model([2.0], 0.0), ["value"], passthrough=["event_id", "event_type"]).createOrReplaceTempView("scored_events")
    return (t.spark.table("scored_events").groupBy("event_type")
            .agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total")))


@query("infer_custom", "SELECT event_id, CASE WHEN value >= 100 THEN value / 10 ELSE value END AS score FROM events")
def infer_custom(t):
    L.create_sql_function(t.spark, "damp", "x DOUBLE", "DOUBLE", "if(x >= 100, x / 10, x)")
    return t.events.selectExpr("event_id", "damp(value) AS score")


@query("infer_prepost", """
SELECT event_id, CASE WHEN least(value, 100) * 0.1 > 5 THEN 'high' ELSE 'low' END AS score FROM events""")
def infer_prepost(t):
    return I.score(t.events, linear_model([0.1], 0.0), ["value"], passthrough=["event_id"],
                   pre={"value": "least(value, 100D)"}, post="if(score > 5, 'high', 'low')")


@query("infer_text", """
SELECT doc_id, lang, len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' '), ' ')) > 120 AS is_long FROM documents""")
def infer_text(t):
    def load():
        def label(frame):
            return frame["text"].map(lambda s: len([w for w in __import__("re").split(r"[ \t\n\r]+", s.strip(" \t\n\r"))]) > 120)
        return label
    return I.score(t.documents, load, ["text"], "is_long", ["doc_id", "lang"], returns="boolean")


@query("udf_scalar", "SELECT event_id, value * value + 1 AS y FROM events")
def udf_scalar(t):
    @F.pandas_udf(T.DoubleType())
    def square_plus_one(v: pd.Series) -> pd.Series:
        return v * v + 1
    t.spark.udf.register("square_plus_one", square_plus_one)
    return t.events.selectExpr("event_id", "square_plus_one(value) AS y")


BANDS = """
SELECT event_id, CASE WHEN value / 300 >= 0.8 THEN 'CRITICAL' WHEN value / 300 >= 0.55 THEN 'HIGH' WHEN value / 300 >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
 CASE WHEN value * 50 >= 10000 THEN 'WHALE' WHEN value * 50 >= 2500 THEN 'LARGE' WHEN value * 50 >= 500 THEN 'MEDIUM' WHEN value * 50 >= 50 THEN 'SMALL' ELSE 'MICRO' END AS band,
 CASE WHEN user_id * 4 < 50 THEN 'INSTANT' WHEN user_id * 4 < 150 THEN 'FAST' WHEN user_id * 4 < 400 THEN 'NORMAL' ELSE 'SLOW' END AS speed,
 CASE WHEN user_id * 4 < 100 AND value / 300 < 0.3 THEN 'PLATINUM' WHEN user_id * 4 < 200 AND value / 300 < 0.55 THEN 'GOLD'
  WHEN user_id * 4 < 400 AND value / 300 < 0.8 THEN 'SILVER' ELSE 'BREACHED' END AS tier FROM events"""


@query("udf_sql", BANDS)
def udf_sql(t):
    L.register_band_functions(t.spark)
    return t.events.selectExpr("event_id", "classify_risk(value / 300) AS risk", "amount_band(value * 50) AS band",
                               "velocity_flag(CAST(user_id * 4 AS INT)) AS speed",
                               "sla_tier(CAST(user_id * 4 AS INT), value / 300) AS tier")


@query("udf_bands", BANDS)
def udf_bands(t):
    risk, ms = F.col("value") / 300, F.col("user_id") * 4
    return t.events.select("event_id", L.classify_risk(risk).alias("risk"), L.amount_band(F.col("value") * 50).alias("band"),
                           L.velocity_flag(ms).alias("speed"), L.sla_tier(ms, risk).alias("tier"))


@query("udf_fmt", """
SELECT event_id, (event_id // 3600) || 'h ' || (event_id % 3600 // 60) || 'm' AS d FROM events""")
def udf_fmt(t):
    return t.events.select("event_id", S.fmt_duration("event_id").alias("d"))


@query("udf_severity", """
WITH l AS (SELECT event_id, CASE WHEN value >= 240 THEN 4 WHEN value >= 165 THEN 3 WHEN value >= 90 THEN 2 ELSE 1 END AS p,
  value * 1000 AS asset, user_id % 30 AS tx, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS sanctioned FROM events)
SELECT event_id, CASE WHEN sanctioned = 1 THEN 'CRITICAL' ELSE ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(1, least(4,
  p + (asset >= 50000)::INT + (tx >= 20)::INT - (asset < 100 AND tx < 3)::INT))] END AS severity FROM l""")
def udf_severity(t):
    level = L.classify_risk(F.col("value") / 300)
    return t.events.select("event_id", L.enrich_severity(
        level, F.col("value") * 1000, F.col("user_id") % 30, F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("severity"))


@query("udaf_weighted_avg", """
SELECT l_suppkey, round(sum(l_discount * l_extendedprice) / nullif(sum(l_extendedprice), 0), 8) AS w,
 CASE WHEN sum(l_discount * l_extendedprice) / sum(l_extendedprice) >= 0.05 THEN 'above' ELSE 'below' END AS side FROM lineitem GROUP BY l_suppkey""")
def udaf_weighted_avg(t):
    w = L.weighted_avg(F.col("l_discount"), F.col("l_extendedprice"))
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(w, 8).alias("w"), F.when(w >= 0.05, "above").otherwise("below").alias("side"))


@query("udtf_explode", """
SELECT doc_id, word, length(word) AS n FROM (SELECT doc_id, unnest(string_split(lang || ' ' || source, ' ')) AS word FROM documents)""")
def udtf_explode(t):
    t.spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION words_of(s STRING) RETURNS TABLE (word STRING, n BIGINT)
        RETURN SELECT col, CAST(length(col) AS BIGINT) FROM explode(split(s, ' '))""")
    return t.sql("SELECT doc_id, word, n FROM {documents}, LATERAL words_of(lang || ' ' || source)", "documents")


@query("udf_map", "SELECT event_id, event_type, event_type || '#' || user_id AS tag FROM events")
def udf_map(t):
    L.create_sql_function(t.spark, "tag_of", "a STRING, b BIGINT", "STRING", "concat(a, '#', b)")
    return t.events.select("event_id", "event_type", F.expr("tag_of(event_type, user_id)").alias("tag"))
