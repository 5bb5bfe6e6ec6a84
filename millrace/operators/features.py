"""Feature columns, feature jobs and point-in-time lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.scalar import logarithm, rounded
from millrace.operators import joins, over, windows

KINDS = ("passthrough", "cast", "math", "coalesce", "ifnull", "upper", "lower", "trim", "substring", "round", "abs",
         "log", "hash_encode", "date_format", "ts_to_epoch", "epoch_to_ts", "lag", "normalise", "bucket", "custom")


def feature_column(column: str, kind: str = "passthrough", param: str = "", alias: str | None = None) -> Column:
    """Column of one feature; ``lag`` needs the table, see ``add_features``."""
    c, name = F.col(column) if column else None, alias or column
    if kind == "passthrough":
        out = c
    elif kind == "cast":
        out = c.try_cast(param or "double")
    elif kind == "math":
        out = F.expr(param or column)
    elif kind in ("coalesce", "ifnull"):
        out = F.coalesce(c, F.expr(param or "0"))
    elif kind in ("upper", "lower", "trim", "abs"):
        out = getattr(F, kind)(c)
    elif kind == "substring":
        start, _, length = (param or "1 FOR 3").upper().partition("FOR")
        out = F.expr(f"substring({column}, {int(start)}" + (f", {int(length)})" if length else ")"))
    elif kind == "round":
        out = F.round(c, int(param or 2))
    elif kind == "log":
        out = logarithm(c)
    elif kind == "hash_encode":
        out = F.md5(c.cast("string"))
    elif kind == "date_format":
        out = F.date_format(c, param or "yyyy-MM-dd")
    elif kind == "ts_to_epoch":
        out = F.unix_timestamp(c)
    elif kind == "epoch_to_ts":
        out = F.from_unixtime(c)
    elif kind == "normalise":
        low, high = [float(x) for x in (param or "0,1").split(",")]
        out, name = (c - low) / F.nullif(F.lit(high - low), F.lit(0.0)), f"{name}_norm"
    elif kind == "bucket":
        limits = [float(x) for x in param.split(",") if x.strip()]
        out = c
        if limits:
            chain = F
            for i, limit in enumerate(limits):
                chain = chain.when(c < limit, F.lit(f"bucket_{i}"))
            out = chain.otherwise(F.lit(f"bucket_{len(limits)}"))
    elif kind == "custom":
        return F.expr(param) if alias is None else F.expr(param).alias(alias)
    else:
        raise ValueError(f"unknown feature kind {kind!r}; one of {KINDS}")
    return out.alias(name)


def add_features(df: DataFrame, features: Sequence[dict], time_column: str = "event_time") -> DataFrame:
    """Select features: dicts with ``col``, ``kind``, ``param`` and ``alias``.

    ``lag`` takes the key column as param, orders by the time column and is named ``<alias>_lag``.
    """
    lags = {}
    for f in features:
        if f.get("kind") == "lag":
            name = f"{f.get('alias') or f['col']}_lag"
            lags.setdefault(f.get("param") or "id", {})[name] = ("lag", f["col"], 1)
    for key, columns in lags.items():
        df = over.shift(df, [key], [time_column], columns)
    out = []
    for f in features:
        if f.get("kind") == "lag":
            out.append(F.col(f"{f.get('alias') or f['col']}_lag"))
        elif f.get("kind") == "round" and isinstance(df.select(f["col"]).schema[0].dataType, T.DoubleType):
            out.append(rounded(f["col"], int(f.get("param") or 2)).alias(f.get("alias") or f["col"]))
        else:
            out.append(feature_column(f.get("col"), f.get("kind", "passthrough"), f.get("param", ""), f.get("alias")))
    return df.select(*out)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fit_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``<c>_min`` and ``<c>_max``, for ``normalise_fitted``."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def normalise_fitted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to the bounds found in the table itself."""
    bounds = fit_bounds(df, columns)
    joined = df.join(F.broadcast(bounds))  # a single row
    return joined.select(*df.columns, *[
        ((F.col(c) - F.col(f"{c}_min")) / F.nullif(F.col(f"{c}_max") - F.col(f"{c}_min"), F.lit(0))).alias(f"{c}_norm")
        for c in columns])


def rolling_features(df: DataFrame, ts: str, by: Sequence[str], slide: str, size: str, aggs: dict[str, Column],
                     time_name: str = "feature_time") -> DataFrame:
    """Sliding aggregates stamped with the window's end, the time they become known."""
    out = windows.hop(df, ts, slide, size, by, aggs)
    return out.select(*by, F.col("window_end").alias(time_name), *aggs)


def feature_lookup(df: DataFrame, features: DataFrame, by: Sequence[str], ts: str, feature_ts: str,
                   ttl: str | None = None, passthrough: Sequence[str] | None = None) -> DataFrame:
    """Features of an entity as known at each row's time; NULL if there is none or it is older than ``ttl``."""
    left = df.select(*dict.fromkeys([*by, ts, *passthrough])) if passthrough is not None else df
    return joins.asof_join(left, features, by, ts, feature_ts, "left", ttl)


@dataclass
class FeatureJob:
    """Features, then windows or a grouping, on a table or stream.

    ``windows``: dicts with type (tumble, hop, session, cumulate), size, slide or step, by, aggs (name to SQL).
    Transforms run before the windows, which therefore see the derived columns as well as the source's.
    """
    features: list[dict] = field(default_factory=list)
    windows: list[dict] = field(default_factory=list)
    group_by: list[str] | None = None
    aggs: dict[str, str] = field(default_factory=dict)
    having: str | None = None
    where: str | None = None
    time_column: str = "event_time"

    def transformed(self, df: DataFrame) -> DataFrame:
        if self.where:
            df = df.where(self.where)
        if not self.features:
            return df
        if not (self.windows or self.group_by is not None):
            return add_features(df, self.features, self.time_column)
        keep = [{"col": c} for c in df.columns]
        derived = [f for f in self.features if (f.get("alias") or f.get("col")) not in df.columns
                   or f.get("kind") in ("lag", "normalise")]
        return add_features(df, keep + derived, self.time_column)

    def build(self, df: DataFrame) -> list[DataFrame]:
        """One result per window, or a single one."""
        base = self.transformed(df)
        out = []
        for w in self.windows:
            aggs = {n: F.expr(e) for n, e in w["aggs"].items()}
            by, kind = w.get("by", []), w["type"]
            if kind == "tumble":
                r = windows.tumble(base, self.time_column, w["size"], by, aggs)
            elif kind == "hop":
                r = windows.hop(base, self.time_column, w["slide"], w["size"], by, aggs)
            elif kind == "session":
                r = windows.session(base, self.time_column, w["size"], by, aggs)
            elif kind == "cumulate":
                r = windows.cumulate(base, self.time_column, w["step"], w["size"], by, aggs)
            else:
                raise ValueError(f"unknown window type {kind!r}")
            out.append(r.where(w["having"]) if w.get("having") else r)
        if self.group_by is not None:
            r = base.groupBy(*self.group_by).agg(*[F.expr(e).alias(n) for n, e in self.aggs.items()])
            out.append(r.where(self.having) if self.having else r)
        return out or [base]
