"""MATCH_RECOGNIZE on Spark's own expressions: labels of rows as a text, matches by the engine's regular expressions, MEASURES by aggregates.

Every row gets one character that says which variables' conditions it meets. The characters of a key, in order, are a text in which a
pattern is a regular expression over sets of characters; its groups say how many rows each part of the pattern took. No Python runs.
Conditions see the row and rows at fixed distances (PREV, NEXT); conditions on rows matched before, and groups within groups, are
``patterns.match_pattern``'s matter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace import durations
from millrace.operators import slices as sl

SKIPS = ("next", "past", "first", "last")
#: A character of a text is this one plus the set of variables, as bits; no other character of a pattern is among them.
BASE, MOST_VARIABLES = 0x3400, 10
START, PART = "\x01", "\x02"

_FACTOR = re.compile(r"\s*(?:([A-Za-z_]\w*)|\(\s*([A-Za-z_]\w*(?:\s*\|\s*[A-Za-z_]\w*)*)\s*\))\s*([*+?]|\{\d*,?\d*\})?(\?)?")
_CALL = re.compile(r"(?:\b(RUNNING|FINAL)\s+)?\b(FIRST|LAST|SUM|AVG|MIN|MAX|COUNT|PREV|NEXT)\s*\(\s*(?:([A-Za-z_]\w*)\s*\.\s*)?(\w+|\*)\s*(?:,\s*(\d+)\s*)?\)", re.I)
_SHIFT = re.compile(r"\b(PREV|NEXT)\s*\(\s*(?:([A-Za-z_]\w*)\s*\.\s*)?(\w+)\s*(?:,\s*(\d+)\s*)?\)", re.I)


class Factor(NamedTuple):
    """One of some variables, repeated as the quantifier says."""
    variables: tuple[str, ...]
    quantifier: str


def factors(pattern: str) -> list[Factor] | None:
    """Parts of a pattern that is a sequence of variables or choices of variables, each with a quantifier; None for any other."""
    out, at, text = [], 0, pattern.strip()
    while at < len(text):
        m = _FACTOR.match(text, at)
        if not m or not (m.group(1) or m.group(2)) or (m.group(3) or "").strip("{},") == "" and "{" in (m.group(3) or ""):
            return None
        low = re.sub(r"^\{,", "{0,", m.group(3) or "")
        out.append(Factor(tuple(re.split(r"\s*\|\s*", m.group(1) or m.group(2))), low + (m.group(4) or "")))
        at = m.end()
    return out or None


class Labels:
    """Characters of sets of variables."""

    def __init__(self, parts: list[Factor]):
        self.parts = parts
        self.variables = list(dict.fromkeys(v for f in parts for v in f.variables))
        if len(self.variables) > MOST_VARIABLES:
            raise ValueError(f"more than {MOST_VARIABLES} pattern variables")
        self.letters = {v: chr(ord("a") + k) for k, v in enumerate(self.variables)}

    def holding(self, variables: Sequence[str]) -> list[int]:
        bits = sum(1 << self.variables.index(v) for v in variables)
        return [m for m in range(1 << len(self.variables)) if m & bits]

    def groups(self) -> str:
        """The pattern as a regular expression with one group for each part."""
        return "".join("([" + "".join(chr(BASE + m) for m in self.holding(f.variables)) + "]" + f.quantifier + ")" for f in self.parts)

    def label(self, define: dict[str, Column]) -> Column:
        mask = F.lit(0)
        for k, v in enumerate(self.variables):
            mask = mask + (F.when(define[v], F.lit(1 << k)).otherwise(F.lit(0)) if v in define else F.lit(1 << k))
        sets = "".join(chr(BASE + m) for m in range(1 << len(self.variables)))
        return F.substring(F.lit(sets), mask + 1, F.lit(1))

    def path(self, groups: list[Column]) -> Column:
        """Letters of the variables that the rows of a match were taken as; the first of a choice that fits."""
        out = []
        for f, text in zip(self.parts, groups):
            masks = self.holding(f.variables)
            first = [self.letters[next(v for v in f.variables if m >> self.variables.index(v) & 1)] for m in masks]
            out.append(F.translate(text, "".join(chr(BASE + m) for m in masks), "".join(first)))
        return F.concat(*out)


def shifted(text: str, variable: str | None, needed: dict[str, Column], window) -> str:
    """Replace PREV and NEXT by columns of the rows at that distance, and the own variable's prefix by nothing."""
    def column(m: re.Match) -> str:
        kind, own, name, n = m.group(1).upper(), m.group(2), m.group(3), int(m.group(4) or 1)
        if own and own != variable:
            raise ValueError(f"condition of {variable} reads {own}: conditions on other variables' rows are not possible here")
        alias = f"_{kind.lower()}_{n}_{name}"
        needed[alias] = (F.lag if kind == "PREV" else F.lead)(name, n).over(window)
        return alias
    out = _SHIFT.sub(column, text)
    return re.sub(rf"\b{variable}\s*\.\s*", "", out) if variable else out


def numbered(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str], labels: Labels, define: dict[str, str], within: str | None,
             extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows with ``_at`` (number in the key), ``_label`` and, with ``within``, ``_us`` and ``_near`` (rows from here on within it)."""
    w = Window.partitionBy(*by).orderBy(*sl.order_columns([ts, *tie]))
    needed: dict[str, Column] = dict(extra or {})
    tests = {v: shifted(text, v, needed, w) for v, text in define.items()}
    out = df.where(F.col(ts).isNotNull()).withColumns({"_at": F.row_number().over(w).cast("bigint"), "_us": durations.since_epoch(ts), **needed})
    if within:
        ahead = Window.partitionBy(*by).orderBy("_us").rangeBetween(0, durations.micros(within) - 1)
        # rows of the same time before this one are counted too, and taken off again
        here = Window.partitionBy(*by, "_us").orderBy("_at")
        out = out.withColumn("_near", F.count(F.lit(1)).over(ahead) - F.row_number().over(here) + 1)
    return out.withColumn("_label", labels.label({v: F.expr(t) for v, t in tests.items()}))


def _split(texts: DataFrame, by: Sequence[str], labels: Labels, overlapping: bool) -> DataFrame:
    """Matches of ``text``: ``_at`` of their first row and ``_path``. Overlapping: one from each row on; else one after another."""
    k = len(labels.parts)
    marks = START + "".join(f"${j + 1}{PART}" for j in range(k))
    pattern = labels.groups()
    if overlapping:
        # a look ahead takes one row a match, so the next one may begin with the next row
        pattern, marks = f"(?=({pattern}))(?s:(.))", START + "".join(f"${j + 2}{PART}" for j in range(k)) + f"${k + 2}"
    pieces = F.split(F.regexp_replace("text", F.lit(pattern), F.lit(marks)), START)
    rows = texts.select(*by, *[c for c in texts.columns if c not in (*by, "text")], F.posexplode(pieces).alias("_i", "_piece"))
    fields = F.split("_piece", PART, -1)
    first = F.col("_i") == 0
    rows = rows.select(*[c for c in rows.columns if c != "_piece"],
                       F.when(first, F.length("_piece")).otherwise(F.length(F.get(fields, F.lit(k)))).alias("_rest"),
                       F.when(~first, labels.path([F.get(fields, F.lit(j)) for j in range(k)])).alias("_path"))
    before = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("_rest") if overlapping else F.col("_rest") + F.coalesce(F.length("_path"), F.lit(0))
    rows = rows.withColumn("_at", (F.coalesce(F.sum(taken).over(before), F.lit(0)) + 1).cast("bigint"))
    return rows.where("length(_path) > 0").drop("_i", "_rest")


def resume(skip: str, letter: str | None, at: Column, path: Column) -> Column:
    """Where the search goes on after a match; a target at its start must still advance."""
    if skip == "next":
        return at + 1
    if skip == "past":
        return at + F.length(path)
    place = F.instr(path, letter) - 1 if skip == "first" else F.length(path) - F.instr(F.reverse(path), letter)
    return at + F.when(F.instr(path, letter) == 0, F.length(path)).otherwise(F.greatest(place, F.lit(1)))


def _gathered(rows: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_spans"))


def extents(rows: DataFrame, by: Sequence[str], labels: Labels, within: str | None, skip: str, skip_to: str | None) -> DataFrame:
    """``match_id`` (``_at`` of the first row) and ``_path`` of each match, from ``numbered`` rows."""
    body = F.struct("_at", "_label", *(["_us", "_near"] if within else []))
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(body)).alias("_rows"))
    texts = listed.select(*by, "_rows", F.array_join(F.transform("_rows", lambda r: r["_label"]), "").alias("text"))
    if not within and skip == "past":
        return _split(texts.drop("_rows"), by, labels, False).select(*by, F.col("_at").alias("match_id"), "_path")
    if within:
        limit = durations.micros(within)
        span = F.element_at("_rows", -1)["_us"] - F.element_at("_rows", 1)["_us"]
        if skip == "past":  # where the whole key lies within the limit, matches follow one another in the text
            direct = _split(texts.where(span < limit).drop("_rows"), by, labels, False)
            texts = texts.where(span >= limit)
        # Matches go back to the one row of their key, so that its rows are there once and not beside each match.
        found = _gathered(_split(texts.drop("_rows"), by, labels, True), by, "_at", "_path")
        found = found.select(*[F.col(k).alias("_g_" + k) for k in by], "_spans")
        found = texts.join(found, sl.same_keys(texts, found, by, "_g_")).select(*[texts[k] for k in by], "_rows", "text", "_spans")
        row = lambda at: F.get("_rows", (at - 1).cast("int"))

        def fit(m: Column) -> Column:
            at, path = m["_at"], m["_path"]
            fits = row(at + F.length(path) - 1)["_us"] - row(at)["_us"] < limit
            near = F.substring("text", at.cast("int"), row(at)["_near"].cast("int"))
            shorter = labels.path([F.regexp_extract(near, "^" + labels.groups(), j + 1) for j in range(len(labels.parts))])
            return F.struct(at.alias("_at"), F.when(fits, path).otherwise(shorter).alias("_path"))

        spans = found.select(*by, F.filter(F.transform("_spans", fit), lambda m: F.length(m["_path"]) > 0).alias("_spans"))
    else:
        spans = _gathered(_split(texts.drop("_rows"), by, labels, True), by, "_at", "_path")
    if skip == "next":
        found = spans.select(*by, F.explode("_spans").alias("_s")).select(*by, "_s._at", "_s._path")
    else:
        go = lambda m: resume(skip, labels.letters.get(skip_to or ""), m["_at"], m["_path"]).cast("bigint")
        kind = spans.schema["_spans"].dataType
        chosen = F.aggregate("_spans", F.struct(F.lit(0).cast("bigint").alias("go"), F.array().cast(kind).alias("kept")),
                             lambda acc, m: F.when(m["_at"] >= acc["go"], F.struct(go(m).alias("go"), F.concat(acc["kept"], F.array(m)).alias("kept"))).otherwise(acc))
        found = spans.select(*by, F.explode(chosen["kept"]).alias("_s")).select(*by, "_s._at", "_s._path")
        if within and skip == "past":
            found = found.unionByName(direct.select(*by, "_at", "_path"))
    return found.select(*by, F.col("_at").alias("match_id"), "_path")


def detail(rows: DataFrame, matches: DataFrame, by: Sequence[str], labels: Labels, columns: Sequence[str]) -> DataFrame:
    """Rows of matches with ``_at``, ``match_id``, ``match_number`` and ``variable``."""
    order = Window.partitionBy(*by).orderBy("match_id")
    steps = matches.withColumn("match_number", F.row_number().over(order).cast("bigint"))
    steps = steps.select(*[F.col(k).alias("_s_" + k) for k in by], "match_id", "match_number", F.posexplode(F.split("_path", "(?<=.)(?=.)")).alias("_i", "_letter"))
    steps = steps.withColumn("_s__at", F.col("match_id") + F.col("_i"))
    variable = F.create_map(*[F.lit(x) for v, letter in labels.letters.items() for x in (letter, v)])[F.col("_letter")]
    return rows.join(steps, sl.same_keys(rows, steps, (*by, "_at"), "_s_")).select(*[rows[c] for c in columns], rows["_at"], "match_id", "match_number", variable.alias("variable"))


def call(kind: str, variable: str | None, column: str, n: int, over) -> Column:
    """One aggregate of a measure over the rows of a match (or those up to the current one)."""
    mine = F.lit(True) if variable is None else F.col("variable") == variable
    if kind == "COUNT":
        return over(F.count(F.when(mine, F.lit(1) if column == "*" else F.col(column))))
    value, at = F.when(mine, F.col(column)), F.when(mine, F.col("_at"))
    if kind in ("FIRST", "LAST"):
        if not n:
            return over((F.min_by if kind == "FIRST" else F.max_by)(column, at))
        listed = F.sort_array(over(F.collect_list(F.when(mine, F.struct("_at", F.col(column).alias("v"))))), kind == "FIRST")
        return F.get(listed, n)["v"]
    return over({"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[kind](value))


class Measures:
    """Measures as SQL text, with their calls replaced by columns."""

    def __init__(self, texts: dict[str, str], labels: Labels, window):
        self.calls: dict[str, tuple] = {}
        self.needed: dict[str, Column] = {}
        self.labels, self.window = labels, window
        self.texts = {name: self._read(text) for name, text in texts.items()}

    def _name(self, *spec) -> str:
        known = {v: k for k, v in self.calls.items()}
        return known.get(spec) or self.calls.setdefault(f"_call{len(self.calls)}", spec) and f"_call{len(self.calls) - 1}"

    def _variable(self, name: str | None) -> str | None:
        if name is not None and name not in self.labels.variables:
            raise ValueError(f"not in the pattern: {name}")
        return name

    def _read(self, text: str) -> str:
        def one(m: re.Match) -> str:
            mode, kind, variable, column, n = (m.group(1) or "RUNNING").upper(), m.group(2).upper(), self._variable(m.group(3)), m.group(4), int(m.group(5) or 0)
            if kind in ("PREV", "NEXT"):
                alias = f"_{kind.lower()}_{n or 1}_{column}"
                self.needed[alias] = (F.lag if kind == "PREV" else F.lead)(column, n or 1).over(self.window)
                kind, column, n = "LAST", alias, 0
            return self._name(mode, kind, variable, column, n)
        out = re.sub(r"\bMATCH_NUMBER\s*\(\s*\)", "match_number", text, flags=re.I)
        out = re.sub(r"\bCLASSIFIER\s*\(\s*\)", lambda m: self._name("RUNNING", "LAST", None, "variable", 0), out, flags=re.I)
        out = _CALL.sub(one, out)
        return re.sub(r"\b([A-Za-z_]\w*)\.(\w+)\b", lambda m: self._name("RUNNING", "LAST", self._variable(m.group(1)), m.group(2), 0), out)


def match_rows(df: DataFrame, by: Sequence[str], ts: str, pattern: str, define: dict[str, str], measures: dict[str, str], within: str | None = None,
               skip: str = "past", skip_to: str | None = None, rows: str = "one", tie: Sequence[str] = ()) -> DataFrame:
    """MATCH_RECOGNIZE with MEASURES.

    ``pattern``: variables and choices ``( A | B )`` in sequence, each with ``* + ? {n,m}``, greedy or reluctant. ``define``: SQL conditions, with
    ``PREV(column, n)`` and ``NEXT(column, n)``; a variable without one takes any row. ``measures``: SQL over FIRST, LAST (with an offset), SUM, AVG,
    MIN, MAX, COUNT of ``column``, ``V.column`` or ``V.*``, PREV, NEXT, ``V.column`` (its last row's), MATCH_NUMBER() and CLASSIFIER().
    ``rows="one"`` gives the keys and the measures of each match; ``rows="all"`` gives the matched rows with ``match_number``, ``variable`` and the measures up to
    that row (``FINAL`` before a call: of the whole match). ``within``, if given, bounds all rows of a match to lie less than that apart.
    Rows without a time match nothing. The labels of a key, one character a row, are one text in one task.
    """
    if skip not in SKIPS:
        raise ValueError(f"skip must be one of {SKIPS}")
    parts = factors(pattern)
    if parts is None:
        raise ValueError(f"not a sequence of variables and choices: {pattern!r}")
    labels = Labels(parts)
    unknown = (set(define) | ({skip_to} if skip in ("first", "last") else set())) - set(labels.variables)
    if unknown:
        raise ValueError(f"not in the pattern: {unknown}")
    window = Window.partitionBy(*by).orderBy(*sl.order_columns([ts, *tie]))
    read = Measures(measures, labels, window)
    base = numbered(df, by, ts, tie, labels, define, within, read.needed)
    matches = extents(base, by, labels, within, skip, skip_to)
    found = detail(base, matches, by, labels, [*df.columns, *read.needed])
    if rows == "all":
        whole = Window.partitionBy(*by, "match_id")
        upto = whole.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = found.withColumns({k: call(*spec, lambda a, w=whole if mode == "FINAL" else upto: a.over(w)) for k, (mode, *spec) in read.calls.items()})
        return found.select(*df.columns, "match_number", "variable", *[F.expr(t).alias(n) for n, t in read.texts.items()])
    each = found.groupBy(*by, "match_id", "match_number").agg(F.count(F.lit(1)).alias("_rows"), *[call(*spec, lambda a: a).alias(k) for k, (_, *spec) in read.calls.items()])
    return each.select(*by, *[F.expr(t).alias(n) for n, t in read.texts.items()])
