"""Chat formatting: logged snapshots that a longer conversation continues are collapsed, the rest is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Turns of one slice, and of one part of a rendered conversation.
SLICE = 256


def escaped(text: Column) -> Column:
    """Marks of the template that a text contains are broken by a space."""
    return F.replace(F.replace(text, F.lit("<|im_start|>"), F.lit("<|im_start |>")), F.lit("<|im_end|>"), F.lit("<|im_end |>"))


def placed(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with their place in the conversation (from 1) and the hash of the conversation up to them.

    Turns stand in order of ``turn``, then role, then text; rows that repeat a turn wholly count once; rows without a conversation
    are left out; null roles and texts are empty. A conversation is cut into slices of ``SLICE`` turn numbers, whose
    counts and hashes are carried over from slice to slice, so a very long one is not one task's work. A prefix's hash
    is the XOR of its turns' hashes, each salted by its place; two of 64 bits are kept.
    """
    c = {"conv_id": conv_id, "turn": turn, "role": role, "text": text}
    rows = turns.where(F.col(f"`{conv_id}`").isNotNull()).select(*[
        (F.col(f"`{own}`") if name in ("conv_id", "turn") else F.coalesce(F.col(f"`{own}`").cast("string"), F.lit(""))).alias(name) for name, own in c.items()])
    rows = rows.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE).cast("bigint"), F.lit(-(2 ** 62)))).dropDuplicates(["conv_id", "slice", "turn", "role", "text"])
    in_slice = Window.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    before = counts.select("conv_id", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    at = rows.join(before, ["conv_id", "slice"]).withColumn("place", F.col("before") + F.row_number().over(in_slice)).drop("before")
    hashed = at.withColumns({"h1": F.xxhash64("place", "role", "text"), "h2": F.xxhash64("text", "place", "role", F.lit(1))})
    sums = hashed.groupBy("conv_id", "slice").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    carried = sums.select("conv_id", "slice", *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias("c" + s[1]) for s in ("s1", "s2")])
    upto = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (hashed.join(carried, ["conv_id", "slice"])
            .select("conv_id", "place", "role", "text", *[F.col(f"c{k}").bitwiseXOR(F.bit_xor(f"h{k}").over(upto)).alias(f"p{k}") for k in "12"]))


def maximal(turns: DataFrame) -> DataFrame:
    """Of ``placed`` turns: ``conv_id``, ``n_turns`` and ``n_copies`` of conversations that no longer one continues.

    Equal conversations are one, under their least id. Conversations are first made distinct, then prefixes are made distinct, so neither
    a conversation logged very often nor a very common beginning meets itself in the anti-join.
    """
    whole = turns.groupBy("conv_id").agg(F.max(F.struct("place", "p1", "p2")).alias("w"))
    distinct = (whole.groupBy(F.col("w.place").alias("place"), F.col("w.p1").alias("p1"), F.col("w.p2").alias("p2"))
                .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")))
    prefixes = (turns.join(whole.select("conv_id", F.col("w.place").alias("n_turns")), "conv_id").where(F.col("place") < F.col("n_turns"))
                .select("place", "p1", "p2").distinct())
    return distinct.join(prefixes, ["place", "p1", "p2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``part``, ``n_turns``, ``n_copies``, ``text``: maximal conversations in the ChatML template.

    A part holds at most ``SLICE`` turns, so a conversation of many turns does not become one row. See ``placed`` for nulls, ties and repeated
    rows; an empty table gives no rows.
    """
    own = placed(turns, conv_id, turn, role, text)
    line = F.concat(F.lit("<|im_start|>"), escaped(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit("<|im_end|>\n"))
    kept = own.join(maximal(own), "conv_id").withColumn("part", F.floor((F.col("place") - 1) / SLICE).cast("bigint"))
    return (kept.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
            .select("conv_id", "part", "n_turns", "n_copies", F.array_join("lines.line", "").alias("text")))
