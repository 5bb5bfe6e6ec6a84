"""Row patterns with measures, without a time limit, and with stop conditions."""

from millrace.operators import patterns as P, rowmatch as R
from queries.cep import EV, FOLLOW, PLUS
from queries.registry import query


@query("cep_measures", """
WITH r AS (SELECT user_id, event_id, ts, value, event_type, row_number() OVER w AS s, lag(value) OVER w AS pv,
   row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type IN ('click', 'view') ORDER BY ts) AS g
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 runs AS (SELECT user_id, min(s) AS lo, max(s) AS hi, count(*) AS n, sum(value) AS total, max(value) AS top, arg_min(event_id, s) AS first_id,
   arg_max(value, s) AS last_value, list(event_id ORDER BY s)[2] AS second_id FROM r WHERE event_type IN ('click', 'view') GROUP BY user_id, g),
 m AS (SELECT runs.*, r.event_id AS end_id, r.value AS end_value, r.pv AS before_end, r.ts AS end_ts FROM runs JOIN r ON r.user_id = runs.user_id AND r.s = hi + 1
   WHERE r.event_type = 'purchase')
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY lo) AS BIGINT) AS match_no, first_id, second_id, n, round(total, 4) AS total, top, end_id,
 round(end_value - last_value, 4) AS gain, before_end, end_ts, 'C' AS last_variable, n + 1 AS n_rows FROM m""")
def cep_measures(t):
    return R.match_rows(t.events.select(*EV), ["user_id"], "ts", "B+ C", {"B": "B.event_type IN ('click', 'view')", "C": "C.event_type = 'purchase'"}, {
        "match_no": "MATCH_NUMBER()", "first_id": "FIRST(B.event_id)", "second_id": "FIRST(B.event_id, 1)", "n": "COUNT(B.*)", "total": "round(SUM(B.value), 4)",
        "top": "MAX(B.value)", "end_id": "C.event_id", "gain": "round(C.value - LAST(B.value), 4)", "before_end": "PREV(C.value)", "end_ts": "LAST(ts)",
        "last_variable": "CLASSIFIER()", "n_rows": "COUNT(*)"})


@query("cep_no_within", PLUS)
def cep_no_within(t):
    return R.match_rows(t.events.select(*EV), ["user_id"], "ts", "B+ C", {"B": "event_type IN ('click', 'view')", "C": "event_type = 'purchase'"},
                        {"first_id": "FIRST(B.event_id)", "n": "COUNT(B.*)", "end_id": "C.event_id"})


@query("cep_measures_all_rows", """
WITH r AS (SELECT user_id, event_id, ts, value, row_number() OVER w AS s, coalesce(value > lag(value) OVER w, FALSE) AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 x AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s) AS g FROM r),
 b AS (SELECT user_id, g, min(s) AS lo, count(*) AS n FROM x GROUP BY user_id, g HAVING count(*) >= 4)
SELECT x.user_id, event_id, CASE WHEN s = lo THEN 'A' ELSE 'U' END AS variable, CAST(s - lo AS BIGINT) AS ups, round(sum(value) OVER (PARTITION BY x.user_id, x.g ORDER BY s), 4) AS upto,
 b.n AS whole FROM x JOIN b USING (user_id, g)""")
def cep_measures_all_rows(t):
    out = R.match_rows(t.events.select(*EV), ["user_id"], "ts", "A U{3,}", {"U": "value > PREV(value)"},
                       {"ups": "COUNT(U.*)", "upto": "round(SUM(value), 4)", "whole": "FINAL COUNT(*)"}, rows="all")
    return out.select("user_id", "event_id", "variable", "ups", "upto", "whole")


@query("cep_until", FOLLOW + """
SELECT a.user_id, a.event_id, arg_min(b.event_id, b.ts) AS next_event_id FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 3 DAY
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND e.event_type = 'error' AND e.ts > a.ts AND e.ts < b.ts) GROUP BY 1, 2""")
def cep_until(t):
    return P.followed_by(t.events.select(*EV), ["user_id"], "ts", "event_type = 'signup'", "event_type = 'purchase'", "3 days",
                         until="event_type = 'error'").select("user_id", "event_id", "next_event_id")


@query("cep_times", FOLLOW + """
SELECT user_id, event_id, third AS next_event_id FROM (SELECT a.user_id, a.event_id, list(b.event_id ORDER BY b.ts)[3] AS third
 FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 5 DAY GROUP BY 1, 2) WHERE third IS NOT NULL""")
def cep_times(t):
    return P.followed_by(t.events.select(*EV), ["user_id"], "ts", "event_type = 'signup'", "event_type = 'purchase'", "5 days",
                         times=3).select("user_id", "event_id", "next_event_id")
