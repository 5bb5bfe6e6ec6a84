"""Row patterns by Spark's regular expressions against a plain matcher, measures, stop conditions, odd tables."""

import re

import pytest
from pyspark.sql import functions as F

from helpers import rows
from millrace.operators import patterns, rowmatch as R


@pytest.fixture(scope="module")
def ev(events):
    return events.select("event_id", F.when(F.col("event_id") % 90 != 5, F.col("ts")).alias("ts"), "value", "event_type",
                         F.when(F.col("user_id") != 3, F.col("user_id")).alias("user_id"))


DEFINE = {"A": "value > 4", "B": "value > 9", "C": "event_type IN ('purchase', 'error')"}
TESTS = {"A": lambda r: r.value > 4, "B": lambda r: r.value > 9, "C": lambda r: r.event_type in ("purchase", "error")}


def by_users(ev):
    users = {}
    for r in ev.where("ts IS NOT NULL").orderBy("ts").collect():
        users.setdefault(r.user_id, []).append(r)
    return users


def plain(ev, pattern, days, skip):
    """Matches by Python's regular expressions over sets of labels, one start after the other."""
    names = [v for v in "ABCD" if v in pattern]
    regex = re.sub(r"[ABCD]", lambda m: "[" + "".join(chr(97 + k) for k in range(1 << len(names)) if k >> names.index(m.group()) & 1) + "]", pattern.replace(" ", ""))
    groups = re.compile(regex)
    out = []
    for u, seq in by_users(ev).items():
        text = "".join(chr(97 + sum(1 << k for k, v in enumerate(names) if v not in TESTS or TESTS[v](r))) for r in seq)
        i = 0
        while i < len(seq):
            end = next((j for j in range(i, len(seq)) if days and (seq[j].ts - seq[i].ts).total_seconds() >= days * 86400), len(seq))
            m = groups.match(text, i, end)
            if not m or m.end() == i:
                i += 1
                continue
            out.append((u, seq[i].event_id, seq[m.end() - 1].event_id, m.end() - i))
            i += m.end() - i if skip == "past" else 1
    return out


@pytest.mark.parametrize("days", [None, 1, 4, 400])
@pytest.mark.parametrize("pattern", ["A+ B", "A B*? C", "A{2,3} (B | C)", "(A | B)+ C", "D A? B{2}", "C* A+?", "A{,2} B"])
@pytest.mark.parametrize("skip", ["past", "next"])
def test_matches(ev, pattern, days, skip):
    define = {v: d for v, d in DEFINE.items() if v in pattern}
    got = R.match_rows(ev, ["user_id"], "ts", pattern, define, {"first": "FIRST(event_id)", "last": "LAST(event_id)", "n": "COUNT(*)"}, f"{days} days" if days else None, skip)
    want = plain(ev, pattern, days, skip)
    assert rows(got) == sorted(want, key=repr) and len(want) > 20


@pytest.mark.parametrize("pattern, skip, to", [("A{2,3} (B | C)", "last", "A"), ("A B? C", "first", "C"), ("A+ B", "past", None), ("(A | B)+ C", "next", None)])
def test_same_as_the_walking_matcher(ev, pattern, skip, to):
    """``match_pattern`` on keys that are not busy is native; cut into slices it walks the rows."""
    define = {v: d for v, d in DEFINE.items() if v in pattern}
    run = lambda **kw: patterns.match_pattern(ev, ["user_id"], "ts", pattern, define, "2 days", skip, skip_to=to, **kw)
    columns = ["user_id", "match_id", "match_rows", "match_start", "match_end", *[f"count_{v}" for v in define], *[f"first_{v}.event_id" for v in define]]
    assert rows(run(), *columns) == rows(run(hot_rows=66), *columns)
    plan = run()._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and re.search("Pandas", run(hot_rows=66)._jdf.queryExecution().executedPlan().toString())


def test_variables_and_measures(ev):
    out = R.match_rows(ev, ["user_id"], "ts", "A (B | C){2} D", {"A": "value > PREV(A.value) AND value < NEXT(value)", "B": "B.value > 9", "C": "value > PREV(value, 2)"},
                       {"no": "MATCH_NUMBER()", "ids": "concat_ws('-', FIRST(event_id), FIRST(event_id, 1), LAST(event_id, 1), D.event_id)", "b": "COUNT(B.*)", "c": "COUNT(C.value)",
                        "lo": "MIN(C.value)", "s": "round(SUM(B.value) + coalesce(SUM(C.value), 0), 3)", "m": "round(AVG(value), 3)", "kind": "CLASSIFIER()", "p": "PREV(A.value)", "q": "NEXT(D.value, 2)"})
    want = []
    for u, seq in by_users(ev).items():
        i, no = 0, 0
        while i + 3 < len(seq):
            v = lambda k: seq[k].value if 0 <= k < len(seq) else None
            kind = ["B" if v(k) > 9 else "C" if k >= 2 and v(k) > v(k - 2) else None for k in (i + 1, i + 2)]
            if i and v(i) > v(i - 1) and v(i) < v(i + 1) and all(kind):
                no += 1
                of = {x: [v(i + 1 + k) for k in (0, 1) if kind[k] == x] for x in "BC"}
                want.append((u, no, "-".join(str(seq[k].event_id) for k in range(i, i + 4)), len(of["B"]), len(of["C"]), min(of["C"], default=None),
                             round(sum(of["B"]) + sum(of["C"]), 3) if of["B"] else None, sum(v(k) for k in range(i, i + 4)) / 4, "D", v(i - 1), v(i + 5)))
                i += 4
            else:
                i += 1
    got = rows(out)
    assert len(got) == len(want) > 20
    for a, b in zip(got, sorted(want, key=repr)):
        assert a[:7] == b[:7] and abs(a[7] - b[7]) < 2e-3 and a[8:] == b[8:]


def test_all_rows_running_and_final(ev):
    out = R.match_rows(ev, ["user_id"], "ts", "B+ C", {"B": "event_type IN ('click', 'view')", "C": "event_type = 'purchase'"},
                       {"n": "COUNT(B.*)", "all_n": "FINAL COUNT(B.*)", "kind": "CLASSIFIER()", "first": "FIRST(B.event_id)", "end": "FINAL LAST(C.event_id)", "open": "LAST(C.event_id)"}, rows="all")
    for r in out.collect():
        assert r.kind == r.variable and r.n <= r.all_n and (r.open is None) == (r.variable == "B") and (r.variable == "B" or r.end == r.event_id == r.open and r.n == r.all_n)
    assert out.columns == [*ev.columns, "match_number", "variable", "n", "all_n", "kind", "first", "end", "open"] and out.count() > 100


@pytest.mark.parametrize("bad", ["", "A (B", "A )", "*A", "(A B)+", "((A))", "A{}"])
def test_patterns_that_are_not_sequences(ev, bad):
    with pytest.raises(ValueError):
        R.match_rows(ev, ["user_id"], "ts", bad, {}, {"n": "COUNT(*)"})


def test_errors_and_empty_tables(ev):
    with pytest.raises(ValueError, match="not in the pattern"):
        R.match_rows(ev, ["user_id"], "ts", "A B", {"C": "true"}, {"n": "COUNT(*)"})
    with pytest.raises(ValueError, match="not in the pattern"):
        R.match_rows(ev, ["user_id"], "ts", "A B", {}, {"n": "LAST(X.value)"})
    with pytest.raises(ValueError, match="condition of B"):
        R.match_rows(ev, ["user_id"], "ts", "A B", {"B": "value > PREV(A.value)"}, {"n": "COUNT(*)"})
    assert R.match_rows(ev.limit(0), ["user_id"], "ts", "A B", {}, {"n": "COUNT(*)"}, "1 day").collect() == []
    with pytest.raises(ValueError, match="within"):
        patterns.match_pattern(ev, ["user_id"], "ts", "(A B)+", {}, None)


@pytest.mark.parametrize("hot", [10 ** 6, 40])
@pytest.mark.parametrize("times, until, negated", [(1, None, False), (3, None, False), (2, "event_type = 'error'", False), (1, "value > 40", False), (1, "event_type = 'error'", True)])
def test_followed_by_times_and_until_with_equal_times(ev, hot, times, until, negated):
    """Times cut to six hours, so that many rows of a key share one; the id orders them."""
    coarse = ev.where("ts IS NOT NULL").select("event_id", "user_id", "event_type", "value", F.window("ts", "6 hours")["start"].alias("ts"))
    got = patterns.followed_by(coarse, ["user_id"], "ts", "event_type = 'view'", "event_type = 'purchase'", "36 hours", negated=negated, hot_rows=hot, times=times, until=until, tie=["event_id"])
    stop = {None: lambda r: False, "event_type = 'error'": lambda r: r.event_type == "error", "value > 40": lambda r: r.value > 40}[until]
    users = {}
    for r in coarse.orderBy("ts", "event_id").collect():
        users.setdefault(r.user_id, []).append(r)
    want, missed = [], []
    for seq in users.values():
        for i, r in enumerate(seq):
            if r.event_type != "view":
                continue
            hits = []
            for x in seq[i + 1:]:
                if stop(x):
                    break
                hits += [x] if x.event_type == "purchase" else []
            ok = len(hits) >= times and (hits[times - 1].ts - r.ts).total_seconds() <= 36 * 3600
            (want if ok else missed).append((r.event_id, hits[times - 1].event_id) if ok else (r.event_id,))
    if negated:
        assert rows(got, "event_id") == sorted(missed, key=repr)
    else:
        assert rows(got, "event_id", "next_event_id") == sorted(want, key=repr) and len(want) > 4


def test_rows_of_a_key_do_not_stand_beside_each_match(spark, events):
    """Pieces of a key's text are sorted without the key's rows, which would take memory with the square of its length."""
    from millrace.operators import rowmatch
    labels = rowmatch.Labels(rowmatch.factors("A B C"))
    base = rowmatch.numbered(events, ["user_id"], "ts", (), labels, {"A": "value > 5", "C": "value > 20"}, "1 day")
    found = rowmatch.extents(base, ["user_id"], labels, "1 day", "past", None)

    def below(node):
        children = node.children()
        return [node, *(x for k in range(children.size()) for x in below(children.apply(k)))]

    windows = [n for n in below(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert windows and all("_rows" not in n.output().mkString(",") for n in windows)
