"""Row patterns per key: sequences, quantifiers, alternation, skip strategies, relaxed contiguity.

A pattern always carries ``within``. A match that starts in a time slice then ends less than ``within``
later, so slices of a busy key only need a short halo, and the work of one key spreads over slices.
The choice between overlapping matches is sequential by nature; it is made from a few numbers per
slice (see ``choose_matches``), never by gathering a key's rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace import durations
from millrace.operators import ranges, rowmatch, slices as sl
from millrace.operators.over import rank_over, shift

SKIPS = ("next", "past", "first", "last")


def sequence_starts(df: DataFrame, by: Sequence[str], ts: str, steps: Sequence[str],
                    define: dict[str, Callable[[dict], Column]], within: str, tie: Sequence[str] = (),
                    slice_width: str = "1 hour", hot_rows: int = sl.HOT_ROWS) -> DataFrame:
    """Every start of a fixed sequence of contiguous rows.

    ``define[step]`` gets a dict from step name to a function of a column name, and returns the
    condition: ``{"B": lambda s: s["B"]("v") > s["A"]("v") * 1.5}``. The last row is less than ``within``
    after the first. Output: the first row's columns, one struct per step named ``m_<step>``, and the
    slice columns.
    """
    whole = sl.with_time_halo(df.where(F.col(ts).isNotNull()), by, ts, slice_width, within,
                              backward=False, hot_rows=hot_rows)
    w = Window.partitionBy(*by, sl.SLICE, sl.HOT).orderBy(ts, *tie)
    row = F.struct(*[F.col(c).alias(c) for c in df.columns])
    rows = whole.withColumns({f"m_{s}": F.lead(row, i).over(w) if i else row for i, s in enumerate(steps)})

    def reader(step: str):
        return lambda column: F.col(f"m_{step}.{column}")

    scope = {s: reader(s) for s in steps}
    test = F.col("_own") & F.col(f"m_{steps[-1]}").isNotNull() & \
        (F.col(f"m_{steps[-1]}.{ts}") < F.col(ts) + durations.interval(within))
    for s in steps:
        if s in define:
            test = test & define[s](scope)
    return rows.where(test).drop("_own")


def match_sequence(df: DataFrame, by: Sequence[str], ts: str, steps: Sequence[str],
                   define: dict[str, Callable[[dict], Column]], within: str, skip: str = "past",
                   tie: Sequence[str] = (), slice_width: str = "1 hour",
                   hot_rows: int = sl.HOT_ROWS) -> DataFrame:
    """One row per match of a fixed sequence; ``skip``: "past" the last row or to the "next" row.

    Output: the first row's columns and one struct per step, ``m_<step>``.
    """
    wanted = [*df.columns, *[f"m_{s}" for s in steps]]
    if skip in ("next", "past") and hot_rows == sl.HOT_ROWS and ranges.cut(df, by, [ts]) is None:
        return _whole_sequences(df, by, ts, steps, define, within, skip, tie).select(*wanted)
    if skip == "next":
        return sequence_starts(df, by, ts, steps, define, within, tie, slice_width, hot_rows).select(*wanted)
    if skip != "past":
        raise ValueError("fixed sequences skip past the last row or to the next row")
    marked = sl.mark_busy(df.where(F.col(ts).isNotNull()), by, hot_rows)
    placed = rank_over(marked, by, [ts, *tie], {"_at": "row_number"})
    starts = sequence_starts(placed, by, ts, steps, define, within, ["_at"], slice_width, hot_rows)
    spans = starts.withColumn("_resume", F.col("_at") + len(steps))
    picked = choose_matches(spans, spans.where(sl.HOT), by)
    picked = picked.select(*[F.col(c).alias("_c_" + c) for c in picked.columns])
    chosen = spans.join(picked, sl.same_keys(spans, picked, (*by, "_at"), "_c_"), "left_semi")
    data = [F.struct(*[F.col(f"m_{s}.{c}").alias(c) for c in df.columns]).alias(f"m_{s}") for s in steps]
    return chosen.select(*df.columns, *data)


def _whole_sequences(df: DataFrame, by: Sequence[str], ts: str, steps: Sequence[str], define: dict[str, Callable[[dict], Column]], within: str, skip: str,
                     tie: Sequence[str]) -> DataFrame:
    """Sequences where no key holds a large share of the rows: one window over the key, and a fold over the starts of a key for the greedy choice."""
    w = Window.partitionBy(*by).orderBy(ts, *tie)
    row = F.struct(*[F.col(c).alias(c) for c in df.columns])
    rows = df.where(F.col(ts).isNotNull()).withColumns({"_at": F.row_number().over(w), **{f"m_{s}": F.lead(row, i).over(w) if i else row for i, s in enumerate(steps)}})
    scope = {s: (lambda column, s=s: F.col(f"m_{s}.{column}")) for s in steps}
    test = F.col(f"m_{steps[-1]}").isNotNull() & (F.col(f"m_{steps[-1]}.{ts}") < F.col(ts) + durations.interval(within))
    for s in steps:
        test = test & define[s](scope) if s in define else test
    starts = rows.where(test)
    if skip == "next":
        return starts
    matches = starts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_at", *[F.col(f"m_{s}") for s in steps]))).alias("_all"))
    kind = matches.schema["_all"].dataType
    chosen = F.aggregate("_all", F.struct(F.lit(0).alias("go"), F.array().cast(kind).alias("kept")),
                         lambda acc, m: F.when(m["_at"] >= acc["go"], F.struct((m["_at"] + len(steps)).alias("go"), F.concat(acc["kept"], F.array(m)).alias("kept"))).otherwise(acc))
    found = matches.select(F.explode(chosen["kept"]).alias("_m"))
    return found.select(*[F.col(f"_m.m_{steps[0]}.{c}").alias(c) for c in df.columns], *[F.col(f"_m.m_{s}").alias(f"m_{s}") for s in steps])


def choose_matches(spans: DataFrame, busy: DataFrame, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep matches greedily in row order: after each one, the next start at or past ``_resume``.

    Returns the keys, ``_at`` and the columns ``keep`` of the chosen rows.

    ``spans`` has ``_at``, ``_resume`` (row numbers per key) and ``_slice``; ``busy`` is its part for busy keys.
    There, the first row allowed after a slice is a step function of the first row allowed in it. These
    functions are short, because most entries lead to the same exit; they are composed along each busy
    key (one row per slice), and then every slice chooses on its own.
    """
    keys = T.StructType([spans.schema[k] for k in by])
    step_function = T.StructType(keys.fields + [
        T.StructField(sl.SLICE, T.LongType()), T.StructField("_upto", T.ArrayType(T.LongType())),
        T.StructField("_exit", T.ArrayType(T.LongType()))])
    entry_type = T.StructType([T.StructField("_e_" + f.name, f.dataType) for f in keys.fields] + [
        T.StructField("_e_" + sl.SLICE, T.LongType()), T.StructField("_entry", T.LongType())])
    by = list(by)

    # tasks get values, not modules
    group_columns, step_names, entry_names = [*by, sl.SLICE], step_function.names, entry_type.names

    def step_of(at: list[int], go: list[int]) -> tuple[list[int], list[int]]:
        n, out = len(at), [0] * len(at)
        for i in range(n - 1, -1, -1):
            after = bisect_left(at, go[i])
            out[i] = go[i] if after >= n else out[after]
        upto, leave = [], []
        for a, o in zip(at, out):
            if leave and leave[-1] == o:
                upto[-1] = a
            else:
                upto.append(a)
                leave.append(o)
        return upto, leave

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, at, go = None, [], []
        for pdf in batches:
            found, keys = [], [pdf[c].to_list() for c in group_columns]
            rows, leads = pdf["_at"].to_list(), pdf["_resume"].to_list()
            cuts = [*_starts(pdf, group_columns), len(pdf)]
            for start, end in zip(cuts, cuts[1:]):
                here = tuple(k[start] for k in keys)
                if not _same(here, group):
                    if at:
                        found.append((*group, *step_of(at, go)))
                    group, at, go = here, [], []
                at += rows[start:end]
                go += leads[start:end]
            yield pd.DataFrame(found, columns=step_names).astype(object)
        if at:
            yield pd.DataFrame([(*group, *step_of(at, go))], columns=step_names).astype(object)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, 0
        for pdf in batches:
            entries, keys, new = [], [pdf[c].to_list() for c in by], set(_starts(pdf, by))
            for i, (upto, leave) in enumerate(zip(pdf["_upto"], pdf["_exit"])):
                if i in new:
                    here = tuple(k[i] for k in keys)
                    if not _same(here, group):
                        group, state = here, 0
                entries.append(state)
                place = bisect_left(upto, state)
                if place < len(upto):
                    state = int(leave[place])
            out = pdf[group_columns].set_axis(entry_names[:-1], axis=1)
            yield out.assign(_entry=entries)

    # Slices are short and many, so tasks walk over sorted rows; a call for each slice or key would cost more than its rows.
    narrow = spans.select(*by, sl.SLICE, "_at", "_resume", *keep)
    functions = (busy.select(*by, sl.SLICE, "_at", "_resume").repartition(*by, sl.SLICE)
                 .sortWithinPartitions(*by, sl.SLICE, "_at").mapInPandas(exits, step_function))
    entries = functions.repartition(*by).sortWithinPartitions(*by, sl.SLICE).mapInPandas(compose, entry_type)
    entered = narrow.join(entries, sl.same_keys(narrow, entries, (*by, sl.SLICE), "_e_"), "left").select(
        *[narrow[c] for c in narrow.columns], F.coalesce("_entry", F.lit(0).cast("long")).alias("_entry"))

    out = [*by, "_at", *keep]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, allowed = None, 0
        for pdf in batches:
            chosen, keys, new = [], [pdf[c].to_list() for c in group_columns], set(_starts(pdf, group_columns))
            for i, (at, go, entry) in enumerate(zip(pdf["_at"].to_list(), pdf["_resume"].to_list(), pdf["_entry"].to_list())):
                if i in new:
                    here = tuple(k[i] for k in keys)
                    if not _same(here, group):
                        group, allowed = here, entry
                chosen.append(at >= allowed)
                if at >= allowed:
                    allowed = go
            yield pdf[chosen][out]

    # sorted rows stream through the task, so a slice is never held in memory
    return (entered.repartition(*by, sl.SLICE).sortWithinPartitions(*by, sl.SLICE, "_at")
            .mapInPandas(choose, T.StructType([spans.schema[c] for c in out])))


def _starts(pdf: pd.DataFrame, columns: Sequence[str]) -> list[int]:
    """Rows whose values in ``columns`` are not those of the row before; the first row is one."""
    same = np.ones(max(len(pdf) - 1, 0), bool)
    for c in columns:
        values = pdf[c].to_numpy()
        none = pd.isna(values)
        same &= (values[1:] == values[:-1]).astype(bool) | (none[1:] & none[:-1])
    return [0, *(np.flatnonzero(~same) + 1).tolist()] if len(pdf) else []


def _same(a, b) -> bool:
    return b is not None and all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


# --- patterns with quantifiers and alternation -------------------------------------------------

_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|([()|])|([*+?]|\{(\d*)(,?)(\d*)\})(\??))")


class Pattern:
    """Steps of a row pattern: take a row as a variable, or try one of two ways in order of preference."""

    def __init__(self, text: str):
        self.steps: list[tuple] = []
        self.variables: list[str] = []
        self._tokens = []
        at, text = 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read pattern at {text[at:]!r}")
            self._tokens.append(m)
            at = m.end()
        tree = self._choice()
        if self._tokens or not self.variables:
            raise ValueError(f"bad pattern {text!r}")
        self._emit(tree)
        self.steps.append(("done",))

    def _choice(self):
        ways, items = [], []
        while self._tokens and self._tokens[0].group(2) != ")":
            m = self._tokens.pop(0)
            if m.group(2) == "|":
                ways.append(("all", items))
                items = []
            elif m.group(2) == "(":
                items.append(self._choice())
                if not self._tokens or self._tokens.pop(0).group(2) != ")":
                    raise ValueError("unbalanced parentheses in pattern")
            elif m.group(1):
                if m.group(1) not in self.variables:
                    self.variables.append(m.group(1))
                items.append(("row", m.group(1)))
            else:
                if not items:
                    raise ValueError("quantifier without a variable")
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(m.group(3), (None, None))
                if low is None:
                    low = int(m.group(4) or 0)
                    high = (int(m.group(6)) if m.group(6) else None) if m.group(5) else low
                items.append(("times", items.pop(), low, high, not m.group(7)))
        ways.append(("all", items))
        return ways[0] if len(ways) == 1 else ("any", ways)

    @staticmethod
    def _may_be_empty(node) -> bool:
        kind = node[0]
        if kind == "row":
            return False
        if kind == "times":
            return node[2] == 0 or Pattern._may_be_empty(node[1])
        return (all if kind == "all" else any)(Pattern._may_be_empty(n) for n in node[1])

    def _emit(self, node) -> None:
        kind = node[0]
        if kind == "row":
            self.steps.append(node)
        elif kind == "all":
            for n in node[1]:
                self._emit(n)
        elif kind == "any":
            exits = []
            for n in node[1][:-1]:
                fork = self._hole()
                self._emit(n)
                exits.append(self._hole())
                self.steps[fork] = ("either", fork + 1, len(self.steps))
            self._emit(node[1][-1])
            for e in exits:
                self.steps[e] = ("either", len(self.steps), None)
        else:
            _, body, low, high, greedy = node
            if high is None and self._may_be_empty(body):
                raise ValueError("an unbounded quantifier needs a body of at least one row")
            for _ in range(low):
                self._emit(body)
            forks = []
            for _ in range(1 if high is None else high - low):
                forks.append(self._hole())
                self._emit(body)
            if high is None:
                self.steps.append(("either", forks[0], None))
            for f in forks:
                ways = (f + 1, len(self.steps))
                self.steps[f] = ("either", *(ways if greedy else ways[::-1]))

    def _hole(self) -> int:
        self.steps.append(())
        return len(self.steps) - 1

    def match(self, fits: Callable[[str, int, tuple], bool], start: int, end: int, pure: bool,
              memory: Memory | None = None) -> list[str] | None:
        """Variables of the preferred match of rows ``start..end-1``, one per row.

        ``pure``: whether ``fits`` ignores the rows taken so far; then no state is tried twice, and ``memory`` carries what is known
        of states from one start to the next.
        """
        if pure:
            return self._remembered(fits, start, end, memory or Memory())
        todo: list[tuple] = [(0, start, None)]
        while todo:
            step, row, taken = todo.pop()
            while True:
                s = self.steps[step]
                if s[0] == "done":
                    path = []
                    while taken:
                        path.append(taken[0])
                        taken = taken[2]
                    return path[::-1]
                if s[0] == "row":
                    if row >= end or not fits(s[1], row, taken):
                        break
                    step, row, taken = step + 1, row + 1, (s[1], row, taken)
                else:
                    if s[2] is not None:
                        todo.append((s[2], row, taken))
                    step = s[1]
        return None

    def _remembered(self, fits, start: int, end: int, memory: Memory) -> list[str] | None:
        """Whether a state (step, row) leads to a match does not depend on the start, and only on ``end`` where it was met."""
        memory.reach(end)
        firm, loose, steps = memory.firm, memory.loose, self.steps

        def known(state):
            return (firm[state], False) if state in firm else (loose[state], True) if state in loose else None

        def settle(state, found, open_):
            (loose if open_ else firm)[state] = found

        stack = [(0, start)]
        while stack:
            state = stack[-1]
            if known(state) is not None:
                stack.pop()
                continue
            step, row = state
            s = steps[step]
            if s[0] == "done":
                settle(state, True, False)
            elif s[0] == "row":
                if row >= end:
                    settle(state, False, True)
                elif not fits(s[1], row, None):
                    settle(state, False, False)
                else:
                    after = known((step + 1, row + 1))
                    if after is None:
                        stack.append((step + 1, row + 1))
                    else:
                        settle(state, *after)
            else:
                first = known((s[1], row))
                if first is None:
                    stack.append((s[1], row))
                elif first[0] or s[2] is None:
                    settle(state, *first)
                else:
                    second = known((s[2], row))
                    if second is None:
                        stack.append((s[2], row))
                    else:
                        settle(state, second[0], first[1] or second[1])
        if not known((0, start))[0]:
            return None
        path, step, row = [], 0, start
        while steps[step][0] != "done":
            s = steps[step]
            if s[0] == "row":
                path.append(s[1])
                step, row = step + 1, row + 1
            else:
                step = s[1] if known((s[1], row))[0] else s[2]
        return path


class Memory:
    """Outcome of states: firm ones, and those that met the last row allowed and may change when that moves."""

    def __init__(self):
        self.firm: dict[tuple[int, int], bool] = {}
        self.loose: dict[tuple[int, int], bool] = {}
        self.end = -1

    def reach(self, end: int) -> None:
        if end != self.end:
            self.loose.clear()
            self.end = end


def match_pattern(df: DataFrame, by: Sequence[str], ts: str, pattern: str, define: dict[str, str], within: str | None,
                  skip: str = "past", rows: str = "one", skip_to: str | None = None, tie: Sequence[str] = (),
                  navigate: dict[str, Callable] | None = None, carry: Sequence[str] = (),
                  slice_width: str = "1 hour", hot_rows: int = sl.HOT_ROWS) -> DataFrame:
    """MATCH_RECOGNIZE for patterns with quantifiers and alternation.

    ``pattern``: variables, ``( | )``, ``* + ? {n,m}``, greedy or reluctant with a trailing ``?``.
    ``define``: SQL conditions on the row, evaluated by Spark; ``prev(column)`` in them reads the previous row
    of the key. A variable without one takes any row. ``navigate`` adds conditions on rows matched before:
    ``{"C": lambda row, first, last: row("country") != first("A", "country")}``; ``carry`` names the columns they
    read. All rows of a match lie less than ``within`` apart; None sets no limit.
    ``skip``: "past" the last row, to the "next" row, to the "first" or "last" row of variable ``skip_to``.

    Output per match: keys, match_id (row number of its first row), match_start, match_end, match_rows and, per variable,
    ``first_<v>``, ``last_<v>`` (structs of the other columns) and ``count_<v>``. ``rows="all"`` gives the
    matched rows instead, with match_id and variable.

    Sequences of variables and choices are matched by ``rowmatch``, without Python, as long as no key holds a large share of the rows. Such
    keys are cut into slices of time, which needs ``within``; nested groups and ``navigate`` need the matcher below.
    """
    if skip not in SKIPS:
        raise ValueError(f"skip must be one of {SKIPS}")
    p, navigate, carry = Pattern(pattern), navigate or {}, list(carry)
    if len(p.variables) > 26:
        raise ValueError("more than 26 pattern variables")
    unknown = ({*define, *navigate} | ({skip_to} if skip in ("first", "last") else set())) - set(p.variables)
    if unknown:
        raise ValueError(f"not in the pattern: {unknown}")
    parts = rowmatch.factors(pattern)
    plain = parts is not None and not navigate and len(p.variables) <= rowmatch.MOST_VARIABLES
    if plain and (not within or hot_rows == sl.HOT_ROWS and ranges.cut(df, by, [ts]) is None):
        labels = rowmatch.Labels(parts)
        base = rowmatch.numbered(df, by, ts, tie, labels, define, within)
        found = rowmatch.detail(base, rowmatch.extents(base, by, labels, within, skip, skip_to), by, labels, df.columns).drop("match_number")
        return _matches(found, df, by, ts, p.variables, rows)
    if not within:
        raise ValueError("nested groups and conditions on matched rows need a limit: within")
    clean = sl.mark_busy(df.where(F.col(ts).isNotNull()), by, hot_rows)
    placed = rank_over(clean, by, [ts, *tie], {"_at": "row_number"})
    looked = sorted({c for text in define.values() for c in re.findall(r"prev\((\w+)\)", text)})
    labeled = placed
    if looked:
        labeled = shift(placed, by, [ts, *tie, "_at"], {f"_prev_{c}": ("lag", c, 1) for c in looked})
    bits = {v: 1 << i for i, v in enumerate(p.variables)}
    mask = F.lit(0)
    for v, bit in bits.items():
        test = F.expr(re.sub(r"prev\((\w+)\)", r"_prev_\1", define[v])) if v in define else F.lit(True)
        mask = mask + F.when(test, F.lit(bit)).otherwise(F.lit(0))
    marked = labeled.select(*by, sl.HOT, *[c for c in carry if c not in by], F.col(ts).alias("_ts"),
                            durations.since_epoch(ts).alias("_us"), "_at", mask.cast("long").alias("_m"))
    halo = sl.with_time_halo(marked, by, "_ts", slice_width, within, backward=False, hot_rows=hot_rows)

    limit, keys = durations.micros(within), list(by)
    letters = {v: chr(ord("a") + i) for i, v in enumerate(p.variables)}
    found_type = T.StructType([df.schema[k] for k in by] + [
        T.StructField(sl.SLICE, T.LongType()), T.StructField("_at", T.LongType()),
        T.StructField("_path", T.StringType()), T.StructField("_resume", T.LongType())])
    names, group_columns, hot_column = [f.name for f in found_type.fields], [*keys, sl.SLICE], sl.HOT

    def matches_in(at, us, own, masks, columns) -> Iterator[tuple[int, str, int]]:
        """Matches of one slice: first row number, letters, row number to resume at.

        Where the slice is a whole key, rows that a match skips need no match of their own.
        """
        whole, memory = not columns[hot_column][0], Memory()

        def fits(v: str, row: int, taken) -> bool:
            if not masks[row] & bits[v]:
                return False
            if v not in navigate:
                return True

            def bound(which: str, column: str, newest: bool):
                # the row under test already counts as its own variable
                hit, link = (row if which == v else None), taken
                while link and not (newest and hit is not None):
                    hit, link = (link[1] if link[0] == which else hit), link[2]
                return None if hit is None else columns[column][hit]

            return bool(navigate[v](lambda c: columns[c][row], lambda w, c: bound(w, c, False),
                                    lambda w, c: bound(w, c, True)))

        end, resume = 0, 0
        for i in range(len(at)):
            if i < resume:
                continue
            while end < len(us) and us[end] < us[i] + limit:
                end += 1
            path = p.match(fits, i, end, not navigate, memory) if own[i] else None
            if not path:  # an empty match is no match
                continue
            if skip == "past":
                step = len(path)
            elif skip == "next":
                step = 1
            elif skip_to not in path:
                step = len(path)
            else:
                place = path.index(skip_to) if skip == "first" else len(path) - 1 - path[::-1].index(skip_to)
                step = max(place, 1)  # a target at the start must still advance
            if whole:
                resume = i + step
            yield at[i], "".join(letters[v] for v in path), at[i] + step

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches sorted by key, slice and row; one slice at a time is in memory."""
        group, held = None, None

        def finished():
            rows = matches_in(*(held[c] for c in ("_at", "_us", "_own", "_m")), held)
            return [(*group, *r) for r in rows]

        for pdf in batches:
            found, values = [], {c: pdf[c].to_list() for c in pdf.columns}
            groups = list(zip(*[values[c] for c in group_columns]))
            start = 0
            for i in range(1, len(groups) + 1):
                if i < len(groups) and _same(groups[i], groups[start]):
                    continue
                if not _same(groups[start], group):
                    if held:
                        found += finished()
                    group, held = groups[start], {c: [] for c in values}
                for c, v in values.items():
                    held[c] += v[start:i]
                start = i
            yield pd.DataFrame(found, columns=names).astype(object)
        if held:
            yield pd.DataFrame(finished(), columns=names).astype(object)

    def matches_of(part: DataFrame) -> DataFrame:
        rows = part.select(*by, *[c for c in carry if c not in by], sl.SLICE, sl.HOT, "_own", "_us", "_at", "_m")
        return (rows.repartition(*by, sl.SLICE).sortWithinPartitions(*by, sl.SLICE, "_at")
                .mapInPandas(walk, found_type))

    matches = matches_of(halo)
    if skip != "next":
        matches = choose_matches(matches, matches_of(halo.where(sl.HOT)), by, ["_path"])
    # back to the rows: a match covers contiguous row numbers of its key
    steps = matches.select(*[F.col(k).alias("_s_" + k) for k in by], F.col("_at").alias("match_id"),
                           F.posexplode(F.split("_path", "(?<=.)(?=.)")).alias("_i", "_letter"))
    steps = steps.withColumn("_s__at", F.col("match_id") + F.col("_i"))
    variable = F.create_map(*[F.lit(x) for v, letter in letters.items() for x in (letter, v)])[F.col("_letter")]
    detail = placed.join(steps, sl.same_keys(placed, steps, (*by, "_at"), "_s_")).select(
        *[placed[c] for c in df.columns], placed["_at"], "match_id", variable.alias("variable"))
    return _matches(detail, df, by, ts, p.variables, rows)


def _matches(detail: DataFrame, df: DataFrame, by: Sequence[str], ts: str, variables: Sequence[str], rows: str) -> DataFrame:
    """Matched rows, or one row for each match."""
    if rows == "all":
        return detail.drop("_at")
    body = F.struct(*[F.col(c).alias(c) for c in df.columns if c not in by])
    aggs = [F.min(ts).alias("match_start"), F.max(ts).alias("match_end"), F.count(F.lit(1)).alias("match_rows")]
    for v in variables:
        mine = F.when(F.col("variable") == v, F.col("_at"))
        aggs += [F.min_by(body, mine).alias(f"first_{v}"), F.max_by(body, mine).alias(f"last_{v}"),
                 F.count(mine).alias(f"count_{v}")]
    return detail.groupBy(*by, "match_id").agg(*aggs)


# --- relaxed contiguity and alerts --------------------------------------------------------------

def followed_by(df: DataFrame, by: Sequence[str], ts: str, first: str, then: str, within: str,
                any_later: bool = False, negated: bool = False, hot_rows: int = sl.HOT_ROWS, times: int = 1, until: str | None = None,
                tie: Sequence[str] = ()) -> DataFrame:
    """Rows of ``first`` with a later row of ``then`` less than or exactly ``within`` after it.

    Default: the first such row (followedBy); ``any_later``: all of them (followedByAny); ``times``: the n-th of them (times(n));
    ``until``: none of them from a row on that meets this condition (the stop condition of a loop), be it such a row itself;
    ``negated``: rows of ``first`` without one (notFollowedBy). The later row's columns get the prefix ``next_``. Rows of one key and time
    stand in the order of ``tie``; without it they must have different times. Nulls stand first.
    """
    rest = [c for c in df.columns if c not in by]
    if any_later:
        if times != 1 or until or tie:
            raise ValueError("all later rows have no n-th one, no stop condition and no order")
        from millrace.operators.joins import interval_join
        later = df.where(then).select(*by, *[F.col(c).alias("next_" + c) for c in rest])
        return interval_join(df.where(first), later, by, ts, "next_" + ts, "1 microsecond", within, "inner")
    if times < 1:
        raise ValueError("times must be 1 or more")
    # The nearest later row, or the n-th, and the nearest stop are carried back along the key, so no pairs are made.
    rows = sl.with_time_halo(df.where(F.col(ts).isNotNull()), by, ts, within, within, backward=False, hot_rows=hot_rows)
    back = [F.col(c).desc() for c in (ts, *tie)]
    following = Window.partitionBy(*by, sl.SLICE).orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    hit, place = F.coalesce(F.expr(then), F.lit(False)), F.struct(ts, *tie)
    body = F.struct(*[F.col(c).alias("next_" + c) for c in rest], place.alias("_place"))
    rows = rows.withColumns({"_hit": hit, "_row": F.when(hit, body)})
    if times > 1:
        rows = rows.withColumn("_row", F.when(F.col("_hit"), F.lag("_row", times - 1).over(Window.partitionBy(*by, sl.SLICE, "_hit").orderBy(*back))))
    carried = {"_n": F.last(F.when(F.col("_hit"), F.struct("_row")), ignorenulls=True).over(following)["_row"]}
    if until:
        carried["_stop"] = F.last(F.when(F.expr(until), place), ignorenulls=True).over(following)
    seen = rows.withColumns(carried).where(F.col("_own") & F.expr(first))
    near = F.coalesce(durations.since_epoch(F.col("_n.next_" + ts)) - durations.since_epoch(ts) <= F.lit(durations.micros(within)), F.lit(False))
    if until:
        near = near & F.coalesce(F.col("_n._place") < F.col("_stop"), F.lit(True))
    if negated:
        missed = seen.where(~near).select(*df.columns)
        return missed.unionByName(df.where(first).where(F.col(ts).isNull()))
    return seen.where(near).select(*df.columns, *[F.col("_n.next_" + c).alias("next_" + c) for c in rest])


def keyed_alert(df: DataFrame, ts: str, size: str, by: Sequence[str], aggs: dict[str, Column], condition: str,
                severity: str) -> DataFrame:
    """Windows of a key whose aggregates meet a condition, with a severity label."""
    from millrace.operators.windows import tumble
    return tumble(df, ts, size, by, aggs).where(condition).withColumn("severity", F.lit(severity))
