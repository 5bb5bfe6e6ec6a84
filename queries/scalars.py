"""Scalar functions: string, regex, hash, math, time, JSON and collections."""

from pyspark.sql import functions as F

from millrace.functions import scalar as S
from queries.registry import query


@query("fn_string", """
SELECT p_partkey, concat(p_name, '-', p_brand) AS c1, p_brand || '/' || p_type AS c2, substring(p_name, 2, 3) AS s1,
 substring(p_type FROM 2 FOR 4) AS s2, trim('  ' || p_name || ' ') AS t1, trim(BOTH 's' FROM p_name) AS t2,
 ltrim(p_name, 'sr') AS t3, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n,
 replace(p_brand, '#', '-') AS r, strpos(p_name, 'e') AS p FROM part""")
def fn_string(t):
    return t.sql("""SELECT p_partkey, concat(p_name, '-', p_brand) AS c1, p_brand || '/' || p_type AS c2,
        substring(p_name, 2, 3) AS s1, substring(p_type FROM 2 FOR 4) AS s2, trim('  ' || p_name || ' ') AS t1,
        trim(BOTH 's' FROM p_name) AS t2, trim(LEADING 'sr' FROM p_name) AS t3, upper(p_name) AS u,
        lower(p_brand) AS l, CAST(char_length(p_name) AS BIGINT) AS n, replace(p_brand, '#', '-') AS r,
        CAST(position('e' IN p_name) AS BIGINT) AS p FROM {part}""", "part")


@query("fn_string2", r"""
SELECT p_partkey, rtrim(p_name, 't') AS a, lpad(p_brand, 10, '*') AS b, rpad(p_brand, 10, '.') AS c,
 concat(substr(p_name, 1, 1), 'XX', substr(p_name, 4)) AS d,
 upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS e, concat_ws('|', p_name, p_brand) AS f,
 split_part(p_name, ' ', 1) AS g, CASE WHEN p_name LIKE '% %' THEN split_part(p_name, ' ', 2) END AS h,
 repeat(p_type, 2) AS i, reverse(p_name) AS j, strpos(p_name, 'r') AS k, CAST(strlen(p_name) AS BIGINT) AS l,
 printf('%s:%d', p_brand, p_size) AS m, len(string_split(p_name, ' ')) AS n FROM part""")
def fn_string2(t):
    return t.part.selectExpr(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size").select(
        "p_partkey", F.expr("trim(TRAILING 't' FROM p_name)").alias("a"), F.lpad("p_brand", 10, "*").alias("b"),
        F.rpad("p_brand", 10, ".").alias("c"), F.expr("overlay(p_name PLACING 'XX' FROM 2 FOR 2)").alias("d"),
        F.initcap("p_type").alias("e"), F.concat_ws("|", "p_name", "p_brand").alias("f"),
        S.split_index("p_name", " ", 0).alias("g"), S.split_index("p_name", " ", 1).alias("h"),
        F.repeat("p_type", 2).alias("i"), F.reverse("p_name").alias("j"),
        F.locate("r", "p_name").cast("long").alias("k"), F.octet_length("p_name").cast("long").alias("l"),
        F.format_string("%s:%d", "p_brand", "p_size").alias("m"),
        F.size(F.split("p_name", " ")).cast("long").alias("n"))


@query("fn_regex", r"""
SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 0) AS whole,
 regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) AS num,
 regexp_replace(c_name, '([A-Za-z]+)#(0*)', '\1:', 'g') AS swapped, len(regexp_split_to_array(c_name, '[#0]+')) AS pieces FROM customer""")
def fn_regex(t):
    p = r"([A-Za-z]+)#0*([0-9]+)"
    return t.customer.select(
        "c_custkey", F.regexp_extract("c_name", p, 0).alias("whole"), F.regexp_extract("c_name", p, 2).alias("num"),
        F.regexp_replace("c_name", r"([A-Za-z]+)#(0*)", "$1:").alias("swapped"),
        F.size(F.split("c_name", "[#0]+")).cast("long").alias("pieces"))


@query("fn_md5", "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS id_hash, md5(text) AS text_hash FROM documents")
def fn_md5(t):
    return t.documents.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("id_hash"),
                              F.md5("text").alias("text_hash"))


@query("fn_hash2", """
SELECT doc_id, sha1(text) AS s1, sha256(text) AS s2, to_base64(encode(lang)) AS b,
 decode(from_base64(to_base64(encode(source)))) AS back FROM documents""")
def fn_hash2(t):
    return t.documents.select("doc_id", F.sha1("text").alias("s1"), F.sha2("text", 256).alias("s2"),
                              F.base64(F.col("lang").cast("binary")).alias("b"),
                              F.unbase64(F.base64(F.col("source").cast("binary"))).cast("string").alias("back"))


@query("fn_math", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 1) AS r, floor(l_extendedprice)::BIGINT AS f,
 ceil(l_extendedprice)::BIGINT AS c, abs(l_discount - 0.05::DOUBLE) AS a, power(l_quantity, 2) AS p, l_orderkey % 7 AS m,
 round(sqrt(l_extendedprice), 8) AS q, round(ln(l_extendedprice), 8) AS ln, least(l_quantity, 20.0::DOUBLE) AS lo,
 greatest(l_quantity, 20.0::DOUBLE) AS hi FROM lineitem""")
def fn_math(t):
    return t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "round(l_extendedprice, 1) AS r", "floor(l_extendedprice) AS f",
        "ceil(l_extendedprice) AS c", "abs(l_discount - 0.05D) AS a", "power(l_quantity, 2) AS p",
        "mod(l_orderkey, 7) AS m", "round(sqrt(l_extendedprice), 8) AS q", "round(ln(l_extendedprice), 8) AS ln",
        "least(l_quantity, 20.0D) AS lo", "greatest(l_quantity, 20.0D) AS hi")


@query("fn_math2", """
SELECT event_id, CAST(sign(value - 20.0) AS DOUBLE) AS s, round(exp(least(value, 10.0::DOUBLE)), 4) AS e,
 round(ln(value) / ln(3.0), 8) AS l3, round(log2(value), 8) AS l2, round(log10(value), 8) AS l10,
 round(pi() * value, 6) AS p, CAST(trunc(CAST(value AS DECIMAL(28, 10)) * 10) / 10 AS DOUBLE) AS t1,
 round_even(CAST(value AS DECIMAL(18, 2)), 1)::DOUBLE AS even FROM events""")
def fn_math2(t):
    v = F.col("value")
    return t.events.select(
        "event_id", F.sign(v - 20.0).alias("s"), S.rounded(F.exp(F.least(v, F.lit(10.0))), 4).alias("e"),
        S.rounded(S.logarithm(v, 3), 8).alias("l3"), S.rounded(S.logarithm(v, 2), 8).alias("l2"), S.rounded(S.logarithm(v, 10), 8).alias("l10"),
        S.rounded(F.pi() * v, 6).alias("p"), S.truncate("value", 1).alias("t1"),
        F.bround(v.cast("decimal(18,2)"), 1).cast("double").alias("even"))


@query("fn_time", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f, CAST(floor(epoch(ts)) AS BIGINT) AS u,
 strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS back,
 CAST(strptime(strftime(ts, '%d/%m/%Y'), '%d/%m/%Y') AS TIMESTAMP) AS parsed,
 CAST(ts AS DATE) AS d, ts + INTERVAL 90 MINUTE AS later, CAST(ts AS DATE) - INTERVAL 1 MONTH AS earlier,
 date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days,
 CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000) AS BIGINT) AS hours,
 make_timestamp(epoch_us(ts) // 1000 * 1000) AS ms_ts FROM events""")
def fn_time(t):
    return t.events.selectExpr(
        "event_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS f", "unix_timestamp(ts) AS u",
        "from_unixtime(unix_timestamp(ts)) AS back",
        "to_timestamp_ntz(date_format(ts, 'dd/MM/yyyy'), 'dd/MM/yyyy') AS parsed", "to_date(ts) AS d",
        "ts + INTERVAL '90' MINUTE AS later", "CAST(to_date(ts) - INTERVAL '1' MONTH AS TIMESTAMP_NTZ) AS earlier",
        "CAST(datediff(to_date(ts), DATE '2024-01-01') AS BIGINT) AS days",
        "timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01', ts) AS hours",
        "CAST(timestamp_millis(unix_millis(CAST(ts AS TIMESTAMP))) AS TIMESTAMP_NTZ) AS ms_ts")


@query("fn_time2", """
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q,
 week(o_orderdate) AS w, hour(o_orderdate) AS h, EXTRACT(doy FROM o_orderdate) AS doy,
 CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS plus10, CAST(CAST(o_orderdate AS DATE) - 3 AS DATE) AS minus3,
 o_orderdate + INTERVAL 2 HOUR AS t2, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS since,
 CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS TIMESTAMP) AS parsed FROM orders""")
def fn_time2(t):
    return t.orders.selectExpr(
        "o_orderkey", "CAST(year(o_orderdate) AS BIGINT) AS y", "CAST(month(o_orderdate) AS BIGINT) AS m",
        "CAST(day(o_orderdate) AS BIGINT) AS d", "CAST(quarter(o_orderdate) AS BIGINT) AS q",
        "CAST(weekofyear(o_orderdate) AS BIGINT) AS w", "CAST(hour(o_orderdate) AS BIGINT) AS h",
        "CAST(extract(DOY FROM o_orderdate) AS BIGINT) AS doy", "date_add(o_orderdate, 10) AS plus10",
        "date_sub(o_orderdate, 3) AS minus3", "timestampadd(HOUR, 2, o_orderdate) AS t2",
        "CAST(datediff(o_orderdate, DATE '1995-01-01') AS BIGINT) AS since",
        "to_timestamp_ntz(date_format(o_orderdate, 'yyyyMMdd'), 'yyyyMMdd') AS parsed")


@query("fn_json_value", """
SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, coalesce(try_cast(props ->> '$.missing' AS BIGINT), -1) AS missing,
 props ->> '$.k' AS txt FROM events""")
def fn_json_value(t):
    return t.events.select("event_id", S.json_value("props", "$.k", "bigint").alias("k"),
                           S.json_value("props", "$.missing", "bigint", -1).alias("missing"),
                           S.json_value("props", "$.k").alias("txt"))


@query("fn_json_query", """
SELECT event_id, replace(CAST(json_object('k', CAST(props ->> '$.k' AS BIGINT)) AS VARCHAR), ' ', '') AS obj,
 CAST(NULL AS VARCHAR) AS scalar, '[' || event_id || ',' || user_id || ']' AS arr FROM events""")
def fn_json_query(t):
    nested = F.concat(F.lit('{"o":'), F.col("props"), F.lit(',"a":['), F.col("event_id"), F.lit(","),
                      F.col("user_id"), F.lit("]}"))
    e = t.events.withColumn("doc", nested)
    return e.select("event_id", S.json_query("doc", "$.o").alias("obj"), S.json_query("doc", "$.o.k").alias("scalar"),
                    S.json_query("doc", "$.a").alias("arr"))


@query("fn_json2", """
SELECT event_id, (props ->> '$.k') IS NOT NULL AS has_k, (props ->> '$.z') IS NOT NULL AS has_z,
 '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS obj, '["' || event_type || '","' || user_id || '"]' AS arr,
 true AS ok, false AS bad FROM events""")
def fn_json2(t):
    return t.events.select(
        "event_id", S.json_exists("props", "$.k").alias("has_k"), S.json_exists("props", "$.z").alias("has_z"),
        S.json_object(id=F.col("event_id"), kind=F.col("event_type")).alias("obj"),
        S.json_array(F.col("event_type"), F.col("user_id").cast("string")).alias("arr"),
        S.is_json("props").alias("ok"), S.is_json(F.concat(F.col("event_type"), F.lit("{"))).alias("bad"))


@query("fn_collections", """
SELECT event_id, user_id + event_id AS a_sum, 2::BIGINT AS a_size, CAST(NULL AS BIGINT) AS null_size, event_type AS m_get,
 1::BIGINT AS m_size, value AS r_field FROM events""")
def fn_collections(t):
    e = t.events.selectExpr("event_id", "array(user_id, event_id) AS a", "map(user_id, event_type) AS m", "user_id",
                            "named_struct('v', value) AS r")
    return e.selectExpr("event_id", "aggregate(a, 0L, (s, x) -> s + x) AS a_sum", "CAST(cardinality(a) AS BIGINT) AS a_size",
                        "CAST(cardinality(CAST(NULL AS ARRAY<INT>)) AS BIGINT) AS null_size", "m[user_id] AS m_get",
                        "CAST(cardinality(m) AS BIGINT) AS m_size", "r.v AS r_field")


@query("fn_array2", """
WITH a AS (SELECT o_orderkey, [o_custkey % 3, o_custkey % 5, o_custkey % 3] AS x, [o_custkey % 5, 9] AS y FROM orders)
SELECT o_orderkey, x[1] AS first, list_contains(x, 1) AS has1, array_to_string(list_filter(x, lambda e: e <> 1), ',') AS removed,
 array_to_string(list_reverse(x), ',') AS rev, len(list_distinct(x)) AS nd,
 array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS uni, array_to_string(flatten([x, y]), ',') AS flat,
 array_to_string([x[1] + y[1], x[2] + y[2]], ',') AS zipped FROM a""")
def fn_array2(t):
    a = t.orders.selectExpr("o_orderkey", "array(o_custkey % 3, o_custkey % 5, o_custkey % 3) AS x",
                            "array(o_custkey % 5, 9) AS y")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return a.select(
        "o_orderkey", F.element_at("x", 1).alias("first"), F.array_contains("x", 1).alias("has1"),
        text(F.array_remove("x", 1)).alias("removed"), text(F.reverse("x")).alias("rev"),
        F.size(F.array_distinct("x")).cast("long").alias("nd"),
        text(F.sort_array(F.array_union("x", "y"))).alias("uni"), text(F.flatten(F.array("x", "y"))).alias("flat"),
        text(F.zip_with(F.slice("x", 1, 2), "y", lambda p, q: p + q)).alias("zipped"))


@query("fn_map2", """
SELECT o_orderkey, 'cust,prio,status' AS ks, CAST(o_custkey AS VARCHAR) || ',' || o_orderpriority || ',' || o_orderstatus AS vs,
 3::BIGINT AS n, 'cust' AS k1, o_orderstatus AS got FROM orders""")
def fn_map2(t):
    m = t.orders.select("o_orderkey", F.map_concat(
        F.map_from_arrays(F.array(F.lit("cust"), F.lit("prio")), F.array(F.col("o_custkey").cast("string"), "o_orderpriority")),
        F.create_map(F.lit("status"), "o_orderstatus")).alias("m"))
    return m.select("o_orderkey", F.array_join(F.map_keys("m"), ",").alias("ks"), F.array_join(F.map_values("m"), ",").alias("vs"),
                    F.cardinality("m").cast("long").alias("n"), F.map_entries("m")[0]["key"].alias("k1"),
                    F.element_at("m", "status").alias("got"))
