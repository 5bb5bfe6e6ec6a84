"""Busy keys cut into slices give what one window over the whole key gives."""

import pytest
from pyspark.sql import Window, functions as F

from helpers import rows
from millrace.operators import joins, keyed, over, patterns, ranges, windows

# 15 users of about 67 events each: about half of them are busy here
HOT = 66
#: Ranges of the whole table: about seven for each user
PARTS = 100


@pytest.fixture(scope="module")
def ev(events):
    # a key of NULL and values with ties
    return events.select("event_id", "ts", "value", "event_type", F.floor("value").alias("whole"),
                         F.when(F.col("user_id") != 3, F.col("user_id")).alias("user_id"))


def test_some_keys_are_busy(ev):
    n = ev.groupBy("user_id").count().where(F.col("count") > HOT).count()
    assert 0 < n < 15


@pytest.mark.parametrize("parts", [60, 1000])
@pytest.mark.parametrize("order", [["ts"], ["-ts"], ["whole", "event_id"], ["-whole", "ts"], ["whole"], ["-event_type", "-whole", "ts"]])
def test_ranks(ev, order, parts):
    from millrace.operators.slices import order_columns
    w = Window.partitionBy("user_id").orderBy(*order_columns(order))
    names = {"rk": "rank", "dr": "dense_rank", "pr": "percent_rank", "cd": "cume_dist"}
    if order != ["whole"]:
        names |= {"rn": "row_number", "q": "ntile(7)"}
    got = over.rank_over(ev, ["user_id"], order, names, parts)
    plain = {n: (F.ntile(7) if f.startswith("ntile") else getattr(F, f)()).over(w) for n, f in names.items()}
    plain = {n: c.cast("double") for n, c in plain.items()}
    want = ev.withColumns(plain)
    cols = ["event_id", *[F.col(n).cast("double").alias(n) for n in names]]
    assert rows(got, *cols) == rows(want, *cols)


def test_ntile_with_fewer_rows_than_buckets(ev):
    some = ev.where("event_id < 40")
    w = Window.partitionBy("user_id").orderBy("ts")
    got = over.rank_over(some, ["user_id"], ["ts"], {"q": "ntile(9)"}, 20)
    assert rows(got, "event_id", "q") == rows(some.withColumn("q", F.ntile(9).over(w)), "event_id", "q")


def test_shift_and_rows_frame(ev):
    w = Window.partitionBy("user_id").orderBy("ts")
    got = over.shift(ev, ["user_id"], ["ts"], {"a": ("lag", "value", 3), "b": ("lead", "event_type", 2, "-"),
                                               "c": ("lag", "value", 1, 0.0)}, PARTS)
    want = ev.select("event_id", F.lag("value", 3).over(w).alias("a"), F.lead("event_type", 2, "-").over(w).alias("b"),
                     F.lag("value", 1, 0.0).over(w).alias("c"))
    assert rows(got, "event_id", "a", "b", "c") == rows(want)
    frame = w.rowsBetween(-4, 2)
    got = over.rows_frame(ev, ["user_id"], ["ts"], 4, 2, {"s": F.sum("value"), "n": F.count("*")}, PARTS)
    want = ev.select("event_id", F.sum("value").over(frame).alias("s"), F.count("*").over(frame).alias("n"))
    assert rows(got, "event_id", "s", "n") == rows(want)


def test_running_and_range(ev):
    w = Window.partitionBy("user_id").orderBy("whole")
    got = over.running(ev, ["user_id"], ["whole"], {"s": ("sum", "value"), "n": ("count", "value"), "lo": ("min", "value"),
                                                    "hi": ("max", "value"), "m": ("avg", "value")}, PARTS)
    want = ev.select("event_id", *[getattr(F, f)("value").over(w).alias(n) for n, f in
                                   (("s", "sum"), ("n", "count"), ("lo", "min"), ("hi", "max"), ("m", "avg"))])
    near = F.round(F.col("m") * F.col("n"), 2).alias("m")  # means of two-digit values lie on borders of rounding
    assert rows(got, "event_id", "s", "n", "lo", "hi", near) == rows(want, "event_id", "s", "n", "lo", "hi", near)
    got = over.time_range(ev, ["user_id"], "ts", "30 hours", {"s": F.sum("value")}, "1 hour", HOT)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(us).rangeBetween(-30 * 3600 * 10**6, 0)
    assert rows(got, "event_id", "s") == rows(ev.select("event_id", F.sum("value").over(w).alias("s")))


def test_first_and_nth(ev):
    w = Window.partitionBy("user_id").orderBy("ts")
    got = over.nth_values(ev, ["user_id"], ["ts"], {"f": ("value", 1), "t": ("event_type", 5)})
    want = ev.select("event_id", F.first("value").over(w).alias("f"), F.nth_value("event_type", 5).over(w).alias("t"))
    assert rows(got, "event_id", "f", "t") == rows(want)


@pytest.mark.parametrize("gap", ["2 hours", "12 hours", "3 days"])
def test_sessions(ev, gap):
    aggs = {"n": F.count("*"), "u": F.count_distinct("event_type"), "s": F.sum("value")}
    got = windows.session(ev, "ts", gap, ["user_id"], aggs, "5 hours", HOT)
    want = ev.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(*[a.alias(n) for n, a in aggs.items()])
    want = want.select("w.start", "w.end", "user_id", *aggs)
    assert rows(got, "window_start", "window_end", "user_id", *aggs) == rows(want)
    assert got.count() > 15


@pytest.mark.parametrize("how,ttl", [("inner", None), ("left", None), ("left", "5 hours")])
def test_asof_against_brute_force(ev, how, ttl):
    buys = ev.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    clicks = ev.where("event_type = 'click'").select(
        "user_id", F.col("ts").alias("cts"), F.when(F.col("value") > 5, F.col("value")).alias("cv"))
    got = joins.asof_join(buys, clicks, ["user_id"], "ts", "cts", how, ttl, "4 hours", 20)
    c = clicks.collect()
    want = []
    for b in buys.collect():
        near = [x for x in c if b.user_id is not None and x.user_id == b.user_id and x.cts <= b.ts]
        best = max(near, key=lambda x: x.cts, default=None)
        if best and ttl and (b.ts - best.cts).total_seconds() > 5 * 3600:
            best = None
        if best or how == "left":
            want.append((b.event_id, best and best.cts, best and best.cv))
    assert rows(got, "event_id", "cts", "cv") == sorted(want, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right"])
def test_interval_join_against_brute_force(ev, how):
    a = ev.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("at"))
    b = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("bt"))
    got = joins.interval_join(a, b, ["user_id"], "at", "bt", "-7 hours", "2 hours", how)
    cond = (a.user_id == b.user_id) & (b.bt >= a.at - F.expr("INTERVAL 7 HOURS")) & (b.bt <= a.at + F.expr("INTERVAL 2 HOURS"))
    assert rows(got, "a", "b") == rows(a.join(b, cond, how).select("a", "b"))


def test_changelog_retract(ev):
    log = ev.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "-D").otherwise("+U").alias("row_kind"))
    cold = keyed.changelog_normalize(log, ["user_id"], ["ts"], "retract")
    hot = keyed.changelog_normalize(log, ["user_id"], ["ts"], "retract", "row_kind", PARTS)
    assert rows(hot) == rows(cold)


STEPS = {"A": lambda s: s["A"]("value") > 5, "B": lambda s: s["B"]("value") > s["A"]("value"),
         "C": lambda s: s["C"]("value") > 10}


@pytest.mark.parametrize("skip", ["next", "past"])
def test_sequences(ev, skip):
    def run(hot):
        return patterns.match_sequence(ev, ["user_id"], "ts", ["A", "B", "C"], STEPS, "2 days", skip,
                                       slice_width="9 hours", hot_rows=hot)
    got = rows(run(HOT), "event_id", "m_B.event_id", "m_C.event_id")
    assert got == rows(run(10**6), "event_id", "m_B.event_id", "m_C.event_id") == rows(run(10**6 + 1), "event_id", "m_B.event_id", "m_C.event_id")
    assert "Pandas" not in run(10**6)._jdf.queryExecution().executedPlan().toString()
    users = {}
    for r in ev.orderBy("ts").collect():
        users.setdefault(r.user_id, []).append(r)
    want = []
    for seq in users.values():
        i = 0
        while i + 2 < len(seq):
            a, b, c = seq[i:i + 3]
            if a.value > 5 and b.value > a.value and c.value > 10 and (c.ts - a.ts).total_seconds() < 2 * 86400:
                want.append((a.event_id, b.event_id, c.event_id))
                i += 3 if skip == "past" else 1
            else:
                i += 1
    assert got == sorted(want, key=repr) and len(got) > 20


@pytest.mark.parametrize("pattern,skip,to", [("A+ B", "past", None), ("A B*? C", "past", None), ("A{2,3} (B | C)", "last", "A"),
                                             ("(A | B)+ C", "next", None), ("A B? C", "first", "C")])
def test_patterns_busy_and_not(ev, pattern, skip, to):
    import re
    define = {"A": "value > 4", "B": "value > 9", "C": "event_type IN ('purchase', 'error')"}
    define = {v: d for v, d in define.items() if v in pattern}

    def run(hot):
        out = patterns.match_pattern(ev, ["user_id"], "ts", pattern, define, "2 days", skip, skip_to=to,
                                     slice_width="9 hours", hot_rows=hot)
        return rows(out, "user_id", "match_id", "match_rows", *[f"count_{v}" for v in define])
    got = run(HOT)
    assert got == run(10**6) and len(got) > 20
    # brute force: a row as the set of its labels, the pattern as a regular expression over sets
    labels = {"A": lambda r: r.value > 4, "B": lambda r: r.value > 9, "C": lambda r: r.event_type in ("purchase", "error")}
    users = {}
    for r in ev.orderBy("ts").collect():
        users.setdefault(r.user_id, []).append(r)
    regex = re.sub(r"[ABC]", lambda m: "[" + "".join(chr(97 + k) for k in range(8) if k >> "ABC".index(m.group()) & 1) + "]",
                   pattern.replace(" ", ""))
    want = []
    for u, seq in users.items():
        text = "".join(chr(97 + sum((1 << "ABC".index(v)) for v, f in labels.items() if f(r))) for r in seq)
        i = 0
        while i < len(seq):
            end = next((j for j in range(i, len(seq)) if (seq[j].ts - seq[i].ts).total_seconds() >= 2 * 86400), len(seq))
            m = re.compile(regex).match(text, i, end)
            if not m:
                i += 1
                continue
            want.append((u, i + 1, m.end() - i))
            i += (m.end() - i) if skip == "past" else 1 if skip in ("next",) else 0
            if skip in ("first", "last"):
                i = None
                break
        if i is None:
            want = None
            break
    if want is not None:
        assert [g[:3] for g in got] == sorted(want, key=repr)


def test_navigation_between_matched_rows(ev):
    out = patterns.match_pattern(ev, ["user_id"], "ts", "A B+ C", {"B": "value > 3"}, "3 days", "next",
                                 navigate={"C": lambda row, first, last: row("event_type") == first("A", "event_type")
                                           and row("value") > last("B", "value")},
                                 carry=["event_type", "value"], slice_width="9 hours", hot_rows=HOT)
    got = out.collect()
    assert len(got) > 10
    for r in got:
        assert r.first_A.event_type == r.last_C.event_type and r.last_C.value > r.last_B.value
        assert r.count_B == r.match_rows - 2 and r.match_end - r.match_start < __import__("datetime").timedelta(days=3)


@pytest.mark.parametrize("bad", ["", "A (B", "A )", "*A", "(A*)*", "A $"])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        patterns.Pattern(bad)


def test_top_n_beyond_the_group_limit(ev):
    got = keyed.top_n(ev, ["event_type"], ["ts"], 1500)
    assert got.count() == ev.count()


@pytest.mark.parametrize("order", ["v", "-v", "text", "-text", "flag"])
def test_ranks_of_special_values(spark, order):
    """NULL, NaN, infinities, huge numbers and texts rank alike whether or not the key is busy."""
    nan, inf = float("nan"), float("inf")
    values = [(None, None, None), (-3.0, "b", True), (1.0, "a", False), (5.0, "", True), (nan, "é", False), (inf, "aa", True), (-inf, "ab", None),
              (1e300, "z" * 9, True), (-1e300, "zzzzzzzzy", False), (5.0, "b", True)]
    df = spark.createDataFrame([(1, *v) for v in values], "k int, v double, text string, flag boolean")
    plain = over.rank_over(df, ["k"], [order], {"r": "rank", "d": "dense_rank"})
    sliced = over.rank_over(df, ["k"], [order], {"r": "rank", "d": "dense_rank"}, 5)
    assert ranges.cut(df, ["k"], [order], 5) is not None or order == "flag"
    key = order.lstrip("-")
    shown = lambda out: sorted((str(r[key]), r["r"], r["d"]) for r in out.collect())
    assert shown(plain) == shown(sliced)


def test_long_runs_take_linear_time():
    """A+ B over a long run of A without a B, and with one at the end."""
    import time
    n = 100_000
    for last in ("A", "B"):
        kinds = ["A"] * (n - 1) + [last]
        p, memory, began = patterns.Pattern("A+ B"), patterns.Memory(), time.time()
        found = [p.match(lambda v, r, _: kinds[r] == v, i, n, True, memory) for i in range(0, n, 1 if last == "A" else n)]
        assert (found[0] is None) == (last == "A") and time.time() - began < 20
        if last == "B":
            assert len(found[0]) == n


@pytest.mark.parametrize("negated", [False, True])
def test_followed_by_busy_and_not(ev, negated):
    ask = lambda hot: rows(patterns.followed_by(ev.select("event_id", "user_id", "ts", "event_type"), ["user_id"], "ts", "event_type = 'view'",
                                                "event_type = 'purchase'", "20 hours", negated=negated, hot_rows=hot))
    plain = ask(10 ** 6)
    assert plain == ask(HOT) and plain


def test_one_hour_of_one_key_is_spread(spark):
    """All rows of one key in one hour: ranges of like size, each in a task of its own; other keys are not cut."""
    busy = spark.range(20_000).select(F.lit(1).alias("k"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 150_000).alias("ts"), F.col("id").cast("double").alias("v"))
    df = busy.unionByName(spark.range(5_000).select((F.col("id") % 500 + 2).cast("int").alias("k"), F.timestamp_micros(F.col("id")).alias("ts"), F.lit(1.0).alias("v"))).repartition(7)
    sizes = [r["count"] for r in ranges.cut(df, ["k"], ["ts"], 50).where("k = 1").groupBy("_slice").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 20_000 / 15
    assert ranges.cut(df, ["k"], ["ts"], 50).where("k > 1 AND (_hot OR _slice <> 0)").isEmpty()
    got = over.running(df, ["k"], ["ts"], {"s": ("sum", "v"), "n": ("count", "v")}, 50).where("k = 1")
    assert got.where("n <> v + 1 OR s <> v * (v + 1) / 2").isEmpty() and got.count() == 20_000
    ranked = over.rank_over(df, ["k"], ["ts"], {"rn": "row_number"}, 50).where("k = 1")
    assert ranked.where("rn <> v + 1").isEmpty()


def test_peers_of_a_busy_key_are_spread_where_their_order_is_free(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.lit(0).alias("o"), "id")
    got = over.rank_over(df, ["k"], ["o"], {"rn": "row_number"}, 20)
    assert sorted(r.rn for r in got.collect()) == list(range(1, 5001))
    assert over.cut_rows(df, ["k"], ["o"], 20)[0].select("_slice").distinct().count() > 10


def test_plans_without_busy_keys_have_one_scan(spark, sf):
    from millrace import session
    rows = session.table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey")
    for out in (over.rank_over(rows, ["l_orderkey"], ["l_quantity"], {"r": "rank"}, 100), over.running(rows, ["l_orderkey"], ["l_quantity"], {"s": ("sum", "l_quantity")}, 100),
                over.shift(rows, ["l_orderkey"], ["l_quantity"], {"p": ("lag", "l_quantity", 1)}, 100)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_first_and_nth_with_peers(ev):
    w = Window.partitionBy("user_id").orderBy("event_type", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = over.nth_values(ev, ["user_id"], ["event_type"], {"f": ("value", 1), "t": ("event_id", 5)}, tie=["event_id"])
    reach = ev.withColumn("n", F.count("*").over(Window.partitionBy("user_id").orderBy("event_type")))
    want = reach.select("event_id", F.first("value").over(w).alias("f"), F.when(F.col("n") >= 5, F.nth_value("event_id", 5).over(w)).alias("t"))
    assert rows(got, "event_id", "f", "t") == rows(want)


def test_choice_of_matches_walks_over_sorted_rows(spark):
    """Many short slices, keys with nulls, batches that part them; no call of Python for each slice or key."""
    import random

    from millrace.operators import patterns as P
    rng, rows, want = random.Random(11), [], set()
    for key in (None, "a", "b", "c"):
        allowed, at = 0, 0
        for _ in range(60):
            at += rng.randint(1, 3)
            go = at + rng.randint(1, 9)
            rows.append((key, at, go, at // 7, key != "c"))
            if at >= allowed:
                want.add((key, at))
                allowed = go
    rng.shuffle(rows)
    spans = spark.createDataFrame([(k, a, g, s if h else 0, h) for k, a, g, s, h in rows], "k string, _at long, _resume long, _slice long, _hot boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        picked = P.choose_matches(spans, spans.where("_hot"), ["k"])
        assert sorted(map(tuple, picked.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroupsInPandas" not in picked._jdf.queryExecution().executedPlan().toString()
