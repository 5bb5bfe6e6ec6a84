"""Projections, predicates, conditionals, sorting, dedup, top-N and set operations."""

from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.operators import keyed, relational as rel
from queries.registry import query


@query("filter", """
SELECT event_id, user_id, value FROM events WHERE (value > 10) AND (event_type = 'purchase')""")
def filter_rows(t):
    return rel.where_all(t.events, ["value > 10", "event_type = 'purchase'"]).select("event_id", "user_id", "value")


@query("project", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
       upper(l_returnflag) AS flag FROM lineitem""")
def project(t):
    return rel.project(t.lineitem, ["l_orderkey", "l_linenumber",
                                    "round(l_extendedprice * (1 - l_discount), 4) AS net",
                                    "upper(l_returnflag) AS flag"])


@query("view_computed", """
SELECT *, round(value * 1.1, 4) AS gross, value > 50 AS large FROM events WHERE event_type <> 'error'""")
def view_computed(t):
    return rel.computed_view(t.events, {"gross": "round(value * 1.1D, 4)", "large": "value > 50"},
                             "event_type <> 'error'", view="computed_events")


@query("case_expr", """
SELECT event_id, CASE WHEN value >= 100 THEN 'HIGH' WHEN value >= 20 THEN 'MEDIUM'
  WHEN value BETWEEN 5 AND 20 THEN 'LOW' ELSE 'TINY' END AS band FROM events""")
def case_expr(t):
    return t.events.select("event_id", rel.case_of_column(
        "value", [(">= 100", "HIGH"), (">= 20", "MEDIUM"), ("BETWEEN 5 AND 20", "LOW")], "TINY").alias("band"))


@query("case_cond", """
SELECT event_id, CASE WHEN event_type = 'error' AND value > 10 THEN 'ALERT'
  WHEN event_type = 'error' THEN 'WARN' WHEN user_id % 2 = 0 THEN 'EVEN' ELSE NULL END AS tag FROM events""")
def case_cond(t):
    return t.events.select("event_id", rel.case_of(
        [("event_type = 'error' AND value > 10", "ALERT"), ("event_type = 'error'", "WARN"),
         ("user_id % 2 = 0", "EVEN")]).alias("tag"))


@query("case_simple", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'partial' END AS status,
 CASE WHEN o_totalprice > 400000 THEN 2 WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS tier FROM orders""")
def case_simple(t):
    return t.sql("""SELECT o_orderkey,
        CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'partial' END AS status,
        CASE WHEN o_totalprice > 400000 THEN 2 WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS tier
        FROM {orders}""", "orders")


@query("split_route", """
SELECT 'a' AS route, event_id FROM events WHERE value > 50
UNION ALL SELECT 'b', event_id FROM events WHERE event_type = 'error'
UNION ALL SELECT 'rest', event_id FROM events
 WHERE NOT coalesce(value > 50, false) AND NOT coalesce(event_type = 'error', false)""")
def split_route(t):
    parts = rel.split_route(t.events, {"a": "value > 50", "b": "event_type = 'error'"}, rest="rest")
    a, b, rest = [d.select(F.lit(n).alias("route"), "event_id") for n, d in parts.items()]
    return a.unionByName(b).unionByName(rest)


@query("predicates", """
SELECT o_orderkey FROM orders WHERE (o_totalprice >= 100000 OR o_orderpriority = '1-URGENT')
  AND NOT (o_orderstatus = 'P') AND o_custkey <> 7 AND o_totalprice < 300000""")
def predicates(t):
    c = F.col
    return t.orders.where(((c("o_totalprice") >= 100000) | (c("o_orderpriority") == "1-URGENT"))
                          & ~(c("o_orderstatus") == "P") & (c("o_custkey") != 7)
                          & (c("o_totalprice") < 300000)).select("o_orderkey")


@query("pred_in", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def pred_in(t):
    return t.events.where(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query("semi_in", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def semi_in(t):
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("semi_exists", """
SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)""")
def semi_exists(t):
    big = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("anti_exists", """
SELECT c_custkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)""")
def anti_exists(t):
    big = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_anti").select("c_custkey")


@query("anti_not_in", """
SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def anti_not_in(t):
    # NOT IN on a nullable column: a NULL in the list empties the result, hence the guard
    listed = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    nulls = listed.where("p_partkey IS NULL").limit(1).agg(F.count(F.lit(1)).alias("n"))
    return (t.part.where("p_partkey IS NOT NULL").join(listed, "p_partkey", "left_anti")
            .where(nulls.scalar() == 0).select("p_partkey"))


@query("pred_between", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""")
def pred_between(t):
    return t.sql("""SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate
        BETWEEN TIMESTAMP_NTZ '1996-01-01' AND TIMESTAMP_NTZ '1996-12-31'""", "orders")


@query("pred_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%r_n%' OR p_type LIKE 'S%'")
def pred_like(t):
    return t.part.where(F.col("p_name").like("%r_n%") | F.col("p_type").like("S%")).select("p_partkey", "p_name")


@query("pred_ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE 'eco%'")
def pred_ilike(t):
    return t.part.where(F.col("p_type").ilike("eco%")).select("p_partkey")


@query("pred_null", """
SELECT d.doc_id, l.quality IS NULL AS unlabeled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.toxic IS NULL OR l.quality IS NOT NULL""")
def pred_null(t):
    return (t.documents.select("doc_id").join(t.labels, "doc_id", "left")
            .where(F.col("toxic").isNull() | F.col("quality").isNotNull())
            .select("doc_id", F.col("quality").isNull().alias("unlabeled")))


@query("cond_fns", """
SELECT event_id, CASE WHEN value > 20 THEN 'y' ELSE 'n' END AS flag, coalesce(nullif(event_type, 'error'), 'bad') AS kind,
  nullif(user_id, 3) AS uid, coalesce(CAST(NULL AS DOUBLE), value) AS v FROM events""")
def cond_fns(t):
    return t.events.selectExpr("event_id", "if(value > 20, 'y', 'n') AS flag",
                               "coalesce(nullif(event_type, 'error'), 'bad') AS kind",
                               "nullif(user_id, 3) AS uid", "ifnull(CAST(NULL AS DOUBLE), value) AS v")


@query("cond_fns2", """
SELECT event_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS a, coalesce(nullif(event_type, 'view'), 'seen') AS b,
  CASE WHEN nullif(event_type, 'click') IS NOT NULL THEN 'other' ELSE 'click' END AS c,
  nullif(user_id, 1) IS NULL AS d, nullif(user_id, 2) IS NOT NULL AS e,
  CASE event_type WHEN 'signup' THEN 'S' WHEN 'purchase' THEN 'P' ELSE '-' END AS f, 'double' AS g FROM events""")
def cond_fns2(t):
    return t.events.selectExpr(
        "event_id", "if(value > 20, 1, 0) AS a", "nvl(nullif(event_type, 'view'), 'seen') AS b",
        "nvl2(nullif(event_type, 'click'), 'other', 'click') AS c", "isnull(nullif(user_id, 1)) AS d",
        "isnotnull(nullif(user_id, 2)) AS e", "decode(event_type, 'signup', 'S', 'purchase', 'P', '-') AS f",
        "typeof(value) AS g")


@query("casts", """
SELECT event_id, CAST(value AS DECIMAL(10, 2)) AS dec, CAST(user_id AS VARCHAR) AS txt,
  try_cast(event_type AS INTEGER) AS bad, try_cast(CAST(user_id AS VARCHAR) AS INTEGER) AS good,
  CAST(ts AS DATE) AS day FROM events""")
def casts(t):
    return t.events.selectExpr("event_id", "CAST(value AS DECIMAL(10, 2)) AS dec", "CAST(user_id AS STRING) AS txt",
                               "try_cast(event_type AS INT) AS bad",
                               "try_cast(CAST(user_id AS STRING) AS INT) AS good", "CAST(ts AS DATE) AS day")


@query("cte", """
WITH spend AS (SELECT user_id, sum(value) AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id),
 top AS (SELECT * FROM spend WHERE total > 300)
SELECT user_id, round(total, 4) AS total FROM top AS x WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def cte(t):
    return t.sql("""WITH spend AS (SELECT user_id, sum(value) AS total FROM {events}
          WHERE event_type = 'purchase' GROUP BY user_id),
        top AS (SELECT * FROM spend WHERE total > 300)
        SELECT user_id, round(total, 4) AS total FROM top AS x
        WHERE user_id IN (SELECT user_id FROM {events} WHERE event_type = 'error')""", "events")


@query("distinct", "SELECT DISTINCT user_id, event_type FROM events")
def distinct(t):
    return t.events.select("user_id", "event_type").distinct()


@query("order_by", "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id")
def order_by(t):
    return t.events.select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id")


@query("limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def limit(t):
    return t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(50)


@query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 30")
def limit_offset(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(30).limit(20)


@query("order_nulls", """
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
ORDER BY l.quality ASC NULLS LAST, d.doc_id DESC""")
def order_nulls(t):
    return (t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
            .orderBy(F.asc_nulls_last("quality"), F.desc("doc_id")))


@query("topn", """
SELECT user_id, event_id, value, rn FROM (SELECT user_id, event_id, value,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3""")
def topn(t):
    return (keyed.top_n(t.events.select("user_id", "event_id", "value"), ["user_id"], ["-value", "event_id"], 3,
                        rank_column="rn").withColumn("rn", F.col("rn").cast("long")))


@query("dedup_first", """
SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id, event_type ORDER BY ts) AS rn FROM events) WHERE rn = 1""")
def dedup_first(t):
    return keyed.dedup(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts"])


@query("dedup_last", """
SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""")
def dedup_last(t):
    return keyed.dedup(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts"], keep="last")


@query("result_page", """
SELECT event_id, ts, user_id, value FROM events ORDER BY ts DESC LIMIT 100 OFFSET 100""")
def result_page(t):
    return rel.page(t.events.select("event_id", "ts", "user_id", "value"), ["-ts"], 101, 200)


@query("union_all", """
SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT c_custkey FROM customer""")
def union_all(t):
    return rel.union(t.events.where("event_type = 'click'").select("user_id"), t.customer.select("c_custkey"))


@query("union_distinct", """
SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT c_custkey FROM customer""")
def union_distinct(t):
    return rel.union(t.events.where("event_type = 'click'").select("user_id"), t.customer.select("c_custkey"), True)


@query("intersect", """
SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'""")
def intersect(t):
    e = t.events
    return e.where("event_type = 'purchase'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query("except", """
SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000""")
def except_(t):
    return t.customer.select("c_custkey").subtract(t.orders.where("o_totalprice > 250000").select("o_custkey"))


@query("search_any", """
SELECT event_id, user_id, event_type, value FROM events WHERE contains(lower(CAST(event_id AS VARCHAR)), '77')
 OR contains(lower(CAST(user_id AS VARCHAR)), '77') OR contains(lower(event_type), '77')
 OR contains(lower(CAST(value AS VARCHAR)), '77')""")
def search_any(t):
    return rel.search_any(t.events.select("event_id", "user_id", "event_type", "value"), "77")


@query("mask_pii", """
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '1234' ELSE c_name END AS card,
   CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 'a@x.org'
        ELSE lower(c_mktsegment) || c_custkey || '@mail.example' END AS mail,
   CASE c_nationkey % 4 WHEN 0 THEN ' usd ' WHEN 1 THEN 'Eur' WHEN 2 THEN 'xyz' ELSE 'JPY' END AS ccy FROM customer)
SELECT c_custkey,
 CASE WHEN card IS NULL OR length(card) < 8 THEN '****-****-****-****'
   ELSE substr(card, 1, 4) || '-****-****-' || substr(card, length(card) - 3, 4) END AS card,
 CASE WHEN mail IS NULL OR strpos(mail, '@') <= 2 THEN '**@***.***'
   ELSE substr(mail, 1, 2) || '***' || substr(mail, strpos(mail, '@')) END AS mail,
 CASE WHEN upper(trim(ccy)) IN ('USD','EUR','GBP','JPY','CHF','AUD','CAD','SGD') THEN upper(trim(ccy))
   ELSE 'UNKNOWN' END AS ccy FROM p""")
def mask_pii(t):
    p = t.customer.selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '1234' ELSE c_name END AS card",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 'a@x.org'"
        " ELSE lower(c_mktsegment) || c_custkey || '@mail.example' END AS mail",
        "CASE c_nationkey % 4 WHEN 0 THEN ' usd ' WHEN 1 THEN 'Eur' WHEN 2 THEN 'xyz' ELSE 'JPY' END AS ccy")
    return p.select("c_custkey", S.mask_card("card").alias("card"), S.mask_email("mail").alias("mail"),
                    S.normalize_currency("ccy").alias("ccy"))
