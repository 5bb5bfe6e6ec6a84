"""Per-key row selection: dedup, top-N, changelogs and upserts (bounded tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from millrace.operators import slices as sl
from millrace.operators.over import rank_over, shift

# Spark prunes rank filters before the shuffle up to this limit (windowGroupLimitThreshold).
GROUP_LIMIT = 1000
SALTS = 64


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int,
          rank_column: str | None = None) -> DataFrame:
    """First ``n`` rows per key, along columns of any type that has an order.

    Up to GROUP_LIMIT rows Spark keeps only n rows per key and map task before the shuffle. For a larger n a salt does the
    same: the first n rows of each key and salt are chosen first, so a busy key is never one task's work.
    """
    first = sl.order_columns(order)
    rows = df
    if n > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        chosen = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*first))
        rows = salted.withColumn("_rn", chosen).where(F.col("_rn") <= n).drop("_salt", "_rn")
    out = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*first))).where(F.col("_rn") <= n)
    if rank_column:
        return out.withColumnRenamed("_rn", rank_column)
    return out.drop("_rn")


def dedup(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last along ``order``."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    turned = list(order) if keep == "first" else [o[1:] if o.startswith("-") else "-" + o for o in order]
    return top_n(df, by, turned, 1)


def decode_cdc(df: DataFrame, op: str = "op", before: str = "before", after: str = "after") -> DataFrame:
    """Change events with before/after images to rows with ``row_kind`` (+I, -U, +U, -D).

    Operation codes: c or r = insert, u = update (two rows), d = delete.
    """
    rest = [c for c in df.columns if c not in (op, before, after)]
    code = F.lower(F.col(op))
    images = (F.when(code.isin("c", "r"), F.array(_image("+I", after)))
              .when(code == "u", F.array(_image("-U", before), _image("+U", after)))
              .when(code == "d", F.array(_image("-D", before))))
    return (df.select(*rest, F.explode(images).alias("_c"))
            .select(*rest, F.col("_c.row_kind").alias("row_kind"), "_c.row.*"))


def _image(kind: str, column: str):
    return F.struct(F.lit(kind).alias("row_kind"), F.col(column).alias("row"))


def changelog_normalize(df: DataFrame, by: Sequence[str], order: Sequence[str], mode: str,
                        kind: str = "row_kind", parts: int | None = None) -> DataFrame:
    """Normal form of a changelog whose rows carry full images.

    * ``upsert``: the current row of every key that was not deleted last,
    * ``retract``: inserts, -U/+U pairs with the true previous image, and deletes,
    * ``append``: inserted rows only.
    """
    if mode == "append":
        return df.where(F.col(kind) == "+I")
    live = df.where(F.col(kind) != "-U")
    if mode == "upsert":
        return dedup(live, by, order, "last").where(F.col(kind) != "-D")
    if mode != "retract":
        raise ValueError(f"unknown changelog mode: {mode}")
    data = [c for c in df.columns if c not in (kind, *by)]
    packed = live.withColumn("_now", F.struct(kind, *data))
    seen = shift(packed, by, order, {"_prev": ("lag", "_now", 1)}, parts)
    gone = F.col(kind) == "-D"
    alive = F.col("_prev").isNotNull() & (F.col("_prev." + kind) != "-D")

    def row(k: str, image: str):
        return F.struct(F.lit(k).alias("k"), *[F.col(f"{image}.{c}").alias(c) for c in data])

    out = (F.when(~gone & ~alive, F.array(row("+I", "_now")))
           .when(~gone & alive, F.array(row("-U", "_prev"), row("+U", "_now")))
           .when(gone & alive, F.array(row("-D", "_prev"))))
    change = [F.col(o.lstrip("-")).alias("change_" + o.lstrip("-")) for o in order]
    return (seen.select(*by, *change, F.explode(out).alias("_c"))
            .select(*by, *["change_" + o.lstrip("-") for o in order],
                    F.col("_c.k").alias(kind), *[F.col("_c." + c).alias(c) for c in data]))


def upsert_latest(changes: DataFrame, target: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target after the last change per key was written over it; changed rows win over present ones."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return dedup(both, by, ["_new", *order], "last").drop("_new")


def delete_keys(target: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """DELETE on tables without row-level deletes: the rows to keep."""
    return target.join(keys.select(*by), list(by), "left_anti")


def update_rows(target: DataFrame, condition: str, assignments: dict[str, str]) -> DataFrame:
    """UPDATE … SET … WHERE as a rewrite; columns keep their types."""
    types = dict(target.dtypes)
    changed = {c: F.when(F.expr(condition), F.expr(e).cast(types[c])).otherwise(F.col(c))
               for c, e in assignments.items()}
    return target.select(*[changed.get(c, F.col(c)).alias(c) for c in target.columns])
