"""Row patterns and alerts."""

from pyspark.sql import functions as F

from millrace.operators import over, patterns as P
from queries.registry import query

EV = ["user_id", "event_id", "ts", "value", "event_type"]


def greedy_sql(candidates: str, keep: str) -> str:
    """Non-overlapping choice in row order: ``candidates`` gives k, s (start row), e (end row) and more."""
    return f"""WITH RECURSIVE {candidates},
 g AS (SELECT k, min(s) AS s FROM m GROUP BY k
   UNION ALL
   SELECT g.k, (SELECT min(n.s) FROM m n WHERE n.k = g.k AND n.s > c.e) FROM g JOIN m c ON c.k = g.k AND c.s = g.s
   WHERE (SELECT min(n.s) FROM m n WHERE n.k = g.k AND n.s > c.e) IS NOT NULL)
SELECT {keep} FROM m JOIN g ON m.k = g.k AND m.s = g.s"""


SPIKE = """r AS (SELECT user_id AS k, event_id, ts, value, row_number() OVER w AS s, lead(event_id, 1) OVER w AS id2,
   lead(value, 1) OVER w AS v2, lead(event_id, 2) OVER w AS id3, lead(value, 2) OVER w AS v3, lead(ts, 2) OVER w AS t3
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 m AS (SELECT *, s + 2 AS e FROM r WHERE value > 10 AND v2 > value * 1.5 AND v3 > v2 * 1.5 AND t3 < ts + INTERVAL 24 HOUR)"""


def spikes(events, skip="past", **kw):
    """Three contiguous events of a user, each half as large again as the one before, within a day."""
    return P.match_sequence(events.select(*EV), ["user_id"], "ts", ["A", "B", "C"], {
        "A": lambda s: s["A"]("value") > 10,
        "B": lambda s: s["B"]("value") > s["A"]("value") * 1.5,
        "C": lambda s: s["C"]("value") > s["B"]("value") * 1.5}, "24 hours", skip=skip, **kw)


@query("cep_sequence", greedy_sql(SPIKE, "m.k AS user_id, event_id AS id1, id2, id3, ts AS match_start, t3 AS match_end"))
def cep_sequence(t):
    return spikes(t.events).select("user_id", F.col("event_id").alias("id1"), F.col("m_B.event_id").alias("id2"),
                                   F.col("m_C.event_id").alias("id3"), F.col("ts").alias("match_start"),
                                   F.col("m_C.ts").alias("match_end"))


@query("cep_skip_next", f"WITH {SPIKE} SELECT k AS user_id, event_id AS id1, id3 FROM m")
def cep_skip_next(t):
    return spikes(t.events, "next").select("user_id", F.col("event_id").alias("id1"), F.col("m_C.event_id").alias("id3"))


WASH = """r AS (SELECT user_id AS k, event_id, ts, value, event_type, row_number() OVER w AS s, lead(event_id, 1) OVER w AS id2,
   lead(value, 1) OVER w AS v2, lead(event_type, 1) OVER w AS y2, lead(event_id, 2) OVER w AS id3,
   lead(value, 2) OVER w AS v3, lead(event_type, 2) OVER w AS y3, lead(ts, 2) OVER w AS t3
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 m AS (SELECT *, s + 2 AS e FROM r WHERE event_type = 'purchase' AND y2 <> 'purchase' AND abs(value - v2) / value < 0.5
   AND y3 = 'purchase' AND abs(v2 - v3) / v2 < 0.5 AND t3 < ts + INTERVAL 48 HOUR)"""


def wash_trades(events, **kw):
    """Buy, something else, buy again, of similar size, within two days."""
    return P.match_sequence(events.select(*EV), ["user_id"], "ts", ["A", "B", "C"], {
        "A": lambda s: s["A"]("event_type") == "purchase",
        "B": lambda s: (s["B"]("event_type") != "purchase")
        & (F.try_divide(F.abs(s["A"]("value") - s["B"]("value")), s["A"]("value")) < 0.5),
        "C": lambda s: (s["C"]("event_type") == "purchase")
        & (F.try_divide(F.abs(s["B"]("value") - s["C"]("value")), s["B"]("value")) < 0.5)}, "48 hours", **kw)


@query("cep_wash", greedy_sql(WASH, "m.k AS user_id, event_id AS buy1, id2 AS other, id3 AS buy2, value AS v1, v3"))
def cep_wash(t):
    return wash_trades(t.events).select(
        "user_id", F.col("event_id").alias("buy1"), F.col("m_B.event_id").alias("other"),
        F.col("m_C.event_id").alias("buy2"), F.col("value").alias("v1"), F.col("m_C.value").alias("v3"))


@query("cep_navigation", """
WITH r AS (SELECT user_id, event_id, value, ts, lag(value) OVER w AS pv, lead(event_id) OVER w AS id2, lead(value) OVER w AS v2,
  lead(ts) OVER w AS t2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, event_id AS id1, id2 FROM r WHERE value > pv AND v2 > value + pv AND t2 < ts + INTERVAL 12 HOUR""")
def cep_navigation(t):
    rows = over.shift(t.events.select(*EV), ["user_id"], ["ts"], {"pv": ("lag", "value", 1)})
    return P.match_sequence(rows, ["user_id"], "ts", ["A", "B"], {
        "A": lambda s: s["A"]("value") > s["A"]("pv"),
        "B": lambda s: s["B"]("value") > s["A"]("value") + s["A"]("pv")}, "12 hours", skip="next").select(
        "user_id", F.col("event_id").alias("id1"), F.col("m_B.event_id").alias("id2"))


# runs of a low value; a trailing reluctant quantifier closes each match at its third row
RUN = """r AS (SELECT user_id AS k, event_id, ts, row_number() OVER w AS s, value < 20 AS hit, lead(value < 20, 1) OVER w AS h2,
   lead(value < 20, 2) OVER w AS h3, lead(event_id, 2) OVER w AS id3, lead(ts, 2) OVER w AS t3
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 m AS (SELECT *, s + 2 AS e FROM r WHERE hit AND h2 AND h3 AND t3 < ts + INTERVAL 5 DAY)"""


@query("cep_run", greedy_sql(RUN, "m.k AS user_id, event_id AS first_id, id3 AS last_id, 3::BIGINT AS n"))
def cep_run(t):
    out = P.match_pattern(t.events.select(*EV), ["user_id"], "ts", "S{3,}?", {"S": "value < 20"}, "5 days")
    return out.select("user_id", F.col("first_S.event_id").alias("first_id"), F.col("last_S.event_id").alias("last_id"),
                      F.col("count_S").alias("n"))


# greedy runs longer than any within bound: the rows of every maximal run of at least two
PLUS = """
WITH r AS (SELECT user_id, event_id, ts, event_type, row_number() OVER w AS s,
   row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type IN ('click', 'view') ORDER BY ts) AS g
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 runs AS (SELECT user_id, g, min(s) AS lo, max(s) AS hi, count(*) AS n, arg_min(event_id, s) AS first_id FROM r
   WHERE event_type IN ('click', 'view') GROUP BY user_id, g)
SELECT runs.user_id, first_id, n, r.event_id AS end_id FROM runs JOIN r ON r.user_id = runs.user_id AND r.s = hi + 1
WHERE r.event_type = 'purchase'"""


@query("cep_plus", PLUS)
def cep_plus(t):
    out = P.match_pattern(t.events.select(*EV), ["user_id"], "ts", "B+ C",
                          {"B": "event_type IN ('click', 'view')", "C": "event_type = 'purchase'"}, "60 days")
    return out.select("user_id", F.col("first_B.event_id").alias("first_id"), F.col("count_B").alias("n"),
                      F.col("first_C.event_id").alias("end_id"))


@query("cep_quantifiers", """
WITH r AS (SELECT user_id AS k, event_id, row_number() OVER w AS s, ts, string_agg(CASE event_type WHEN 'signup' THEN 's'
   WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' WHEN 'purchase' THEN 'p' ELSE 'e' END, '')
   OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 x AS (SELECT *, regexp_extract(tail, '^s+?c*v?p{1,2}') AS hit FROM r)
SELECT k AS user_id, event_id AS first_id, CAST(length(hit) AS BIGINT) AS n FROM x WHERE hit <> ''""")
def cep_quantifiers(t):
    out = P.match_pattern(t.events.select(*EV), ["user_id"], "ts", "A+? B* C? D{1,2}",
                          {"A": "event_type = 'signup'", "B": "event_type = 'click'", "C": "event_type = 'view'",
                           "D": "event_type = 'purchase'"}, "60 days", skip="next")
    return out.select("user_id", F.col("first_A.event_id").alias("first_id"), F.col("match_rows").alias("n"))


ALTERNATION = """r AS (SELECT user_id AS k, event_id, ts, event_type AS y1, row_number() OVER w AS s, lead(event_type, 1) OVER w AS y2,
   lead(event_type, 2) OVER w AS y3, lead(ts, 2) OVER w AS t3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 m AS (SELECT *, s + 2 AS e FROM r WHERE y1 = 'signup' AND y2 IN ('click', 'view') AND y3 = 'purchase' AND t3 < ts + INTERVAL 2 DAY)"""


@query("cep_alternation", greedy_sql(ALTERNATION, """m.k AS user_id, event_id AS first_id,
  CASE WHEN y2 = 'click' THEN 1 ELSE 0 END::BIGINT AS clicks, CASE WHEN y2 = 'view' THEN 1 ELSE 0 END::BIGINT AS views"""))
def cep_alternation(t):
    out = P.match_pattern(t.events.select(*EV), ["user_id"], "ts", "A (B | C) D",
                          {"A": "event_type = 'signup'", "B": "event_type = 'click'", "C": "event_type = 'view'",
                           "D": "event_type = 'purchase'"}, "2 days")
    return out.select("user_id", F.col("first_A.event_id").alias("first_id"), F.col("count_B").alias("clicks"),
                      F.col("count_C").alias("views"))


OVERLAP = """r AS (SELECT user_id AS k, event_id, ts, value AS v1, row_number() OVER w AS s, lead(value, 1) OVER w AS v2,
   lead(value, 2) OVER w AS v3, lead(ts, 2) OVER w AS t3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 m AS (SELECT *, s + {step} AS e FROM r WHERE v1 > 5 AND v2 > 5 AND v3 > 20 AND t3 < ts + INTERVAL 1 DAY)"""


@query("cep_skip_past", greedy_sql(OVERLAP.format(step=2), "m.k AS user_id, event_id AS first_id"))
def cep_skip_past(t):
    out = P.match_pattern(t.events.select(*EV), ["user_id"], "ts", "A B C",
                          {"A": "value > 5", "B": "value > 5", "C": "value > 20"}, "1 day", skip="past")
    return out.select("user_id", F.col("first_A.event_id").alias("first_id"))


@query("cep_skip_last", greedy_sql(OVERLAP.format(step=1), "m.k AS user_id, event_id AS first_id"))
def cep_skip_last(t):
    out = P.match_pattern(t.events.select(*EV), ["user_id"], "ts", "A B C",
                          {"A": "value > 5", "B": "value > 5", "C": "value > 20"}, "1 day", skip="last", skip_to="C")
    return out.select("user_id", F.col("first_A.event_id").alias("first_id"))


@query("cep_all_rows", greedy_sql(ALTERNATION, "m.k AS user_id, event_id AS first_id, unnest(['A', y2, 'D']) AS variable")
       .replace("['A', y2, 'D']", "['A', CASE y2 WHEN 'click' THEN 'B' ELSE 'C' END, 'D']"))
def cep_all_rows(t):
    out = P.match_pattern(t.events.select(*EV), ["user_id"], "ts", "A (B | C) D",
                          {"A": "event_type = 'signup'", "B": "event_type = 'click'", "C": "event_type = 'view'",
                           "D": "event_type = 'purchase'"}, "2 days", rows="all")
    firsts = out.where("variable = 'A'").select("user_id", "match_id", F.col("event_id").alias("first_id"))
    return out.join(firsts, ["user_id", "match_id"]).select("user_id", "first_id", "variable")


FOLLOW = """WITH a AS (SELECT * FROM events WHERE event_type = 'signup'), b AS (SELECT * FROM events WHERE event_type = 'purchase')"""


@query("cep_followed_by", FOLLOW + """
SELECT a.user_id, a.event_id, arg_min(b.event_id, b.ts) AS next_event_id FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts
 AND b.ts <= a.ts + INTERVAL 12 HOUR GROUP BY 1, 2""")
def cep_followed_by(t):
    return P.followed_by(t.events.select(*EV), ["user_id"], "ts", "event_type = 'signup'", "event_type = 'purchase'",
                         "12 hours").select("user_id", "event_id", "next_event_id")


@query("cep_followed_by_any", FOLLOW + """
SELECT a.user_id, a.event_id, b.event_id AS next_event_id FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts
 AND b.ts <= a.ts + INTERVAL 12 HOUR""")
def cep_followed_by_any(t):
    return P.followed_by(t.events.select(*EV), ["user_id"], "ts", "event_type = 'signup'", "event_type = 'purchase'",
                         "12 hours", any_later=True).select("user_id", "event_id", "next_event_id")


@query("cep_not_followed_by", FOLLOW + """
SELECT a.user_id, a.event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND b.ts > a.ts
 AND b.ts <= a.ts + INTERVAL 12 HOUR)""")
def cep_not_followed_by(t):
    return P.followed_by(t.events.select(*EV), ["user_id"], "ts", "event_type = 'signup'", "event_type = 'purchase'",
                         "12 hours", negated=True).select("user_id", "event_id")


@query("alert_threshold", """
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE l_returnflag WHEN 'A' THEN 80000.0::DOUBLE WHEN 'N' THEN 90000.0::DOUBLE
 ELSE 70000.0::DOUBLE END AS threshold FROM lineitem
WHERE l_extendedprice >= CASE l_returnflag WHEN 'A' THEN 80000 WHEN 'N' THEN 90000 ELSE 70000 END""")
def alert_threshold(t):
    limit = F.when(F.col("l_returnflag") == "A", 80000.0).when(F.col("l_returnflag") == "N", 90000.0).otherwise(70000.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", limit.alias("threshold")).where(
        "l_extendedprice >= threshold")


@query("alert_keyed", """
SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start,
 time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end, user_id,
 count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n, 'HIGH' AS severity FROM events GROUP BY 1, 2, 3
HAVING count(*) FILTER (WHERE event_type = 'error') >= 2""")
def alert_keyed(t):
    return P.keyed_alert(t.events, "ts", "1 day", ["user_id"], {
        "errors": F.count_if(F.col("event_type") == "error"), "n": F.count("*")}, "errors >= 2", "HIGH")


@query("alert_spend_velocity", """
SELECT 'HIGH_VELOCITY' AS alert_type, user_id, event_id, round(value, 2) AS total, ts FROM (SELECT *, sum(value)
 OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS spend FROM events)
WHERE spend > 150.005""")
def alert_spend_velocity(t):
    spent = over.time_range(t.events.select(*EV), ["user_id"], "ts", "12 hours", {"spend": F.sum("value")})
    return spent.where("spend > 150.005").select(F.lit("HIGH_VELOCITY").alias("alert_type"), "user_id", "event_id",
                                                 F.round("value", 2).alias("total"), "ts")


@query("alert_wash_window", """
WITH w AS (SELECT time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, user_id,
  count(CASE WHEN event_type = 'purchase' THEN 1 END) AS buys, count(CASE WHEN event_type = 'click' THEN 1 END) AS sells,
  avg(CASE WHEN event_type = 'purchase' THEN value END) AS avg_buy, avg(CASE WHEN event_type = 'click' THEN value END) AS avg_sell,
  sum(value) AS total FROM events GROUP BY 1, 2)
SELECT window_start, user_id, buys, sells, round(total, 4) AS total FROM w
WHERE buys >= 2 AND sells >= 2 AND abs(avg_buy - avg_sell) / nullif(avg_buy, 0) <= 0.5""")
def alert_wash_window(t):
    from millrace.operators import windows as W
    buy, sell = F.col("event_type") == "purchase", F.col("event_type") == "click"
    w = W.tumble(t.events, "ts", "2 days", ["user_id"], {
        "buys": F.count_if(buy), "sells": F.count_if(sell), "avg_buy": F.avg(F.when(buy, F.col("value"))),
        "avg_sell": F.avg(F.when(sell, F.col("value"))), "total": F.sum("value")})
    return w.where("buys >= 2 AND sells >= 2 AND abs(avg_buy - avg_sell) / nullif(avg_buy, 0D) <= 0.5D").select(
        "window_start", "user_id", "buys", "sells", F.round("total", 4).alias("total"))


ALERT_SQL = "WITH RECURSIVE " + SPIKE.replace("r AS", "r1 AS").replace("m AS", "m1 AS").replace("FROM r ", "FROM r1 ") + ", " + \
    WASH.replace("r AS", "r2 AS").replace("m AS", "m2 AS").replace("FROM r ", "FROM r2 ") + """,
 g1 AS (SELECT k, min(s) AS s FROM m1 GROUP BY k UNION ALL
  SELECT g1.k, (SELECT min(n.s) FROM m1 n WHERE n.k = g1.k AND n.s > c.e) FROM g1 JOIN m1 c ON c.k = g1.k AND c.s = g1.s
  WHERE (SELECT min(n.s) FROM m1 n WHERE n.k = g1.k AND n.s > c.e) IS NOT NULL),
 g2 AS (SELECT k, min(s) AS s FROM m2 GROUP BY k UNION ALL
  SELECT g2.k, (SELECT min(n.s) FROM m2 n WHERE n.k = g2.k AND n.s > c.e) FROM g2 JOIN m2 c ON c.k = g2.k AND c.s = g2.s
  WHERE (SELECT min(n.s) FROM m2 n WHERE n.k = g2.k AND n.s > c.e) IS NOT NULL),
 d AS (SELECT 'VS-' || event_id AS alert_id, 'HIGH' AS severity, 'VOLUME_SPIKE' AS pattern, m1.k AS user_id,
   '{"first":' || event_id || ',"second":' || id2 || ',"third":' || id3 || '}' AS triggers FROM m1 JOIN g1 ON m1.k = g1.k AND m1.s = g1.s
  UNION ALL SELECT 'WT-' || event_id, 'HIGH', 'WASH_TRADE', m2.k,
   '{"first":' || event_id || ',"second":' || id2 || ',"third":' || id3 || '}' FROM m2 JOIN g2 ON m2.k = g2.k AND m2.s = g2.s
  UNION ALL SELECT 'LO-' || event_id, 'HIGH', 'LARGE_ORDER', user_id, '{"first":' || event_id || '}' FROM events WHERE value >= 200)
SELECT alert_id, severity, pattern, user_id, coalesce(c_name, 'CUST_' || user_id) AS customer, triggers
FROM d LEFT JOIN customer ON user_id = c_custkey"""


@query("alert_union", ALERT_SQL)
def alert_union(t):
    e = t.events

    def shaped(matches, prefix, pattern, *ids):
        names = ("first", "second", "third")
        return matches.select(
            F.concat(F.lit(prefix + "-"), F.col("event_id")).alias("alert_id"), F.lit("HIGH").alias("severity"),
            F.lit(pattern).alias("pattern"), "user_id",
            F.to_json(F.struct(*[F.col(i).alias(n) for n, i in zip(names, ids)])).alias("triggers"))

    three = ("event_id", "m_B.event_id", "m_C.event_id")
    alerts = (shaped(spikes(e), "VS", "VOLUME_SPIKE", *three)
              .unionByName(shaped(wash_trades(e), "WT", "WASH_TRADE", *three))
              .unionByName(shaped(e.where("value >= 200"), "LO", "LARGE_ORDER", "event_id")))
    who = t.customer.selectExpr("c_custkey AS user_id", "c_name")
    return alerts.join(who, "user_id", "left").select(
        "alert_id", "severity", "pattern", "user_id",
        F.coalesce("c_name", F.concat(F.lit("CUST_"), F.col("user_id"))).alias("customer"), "triggers")
