"""Python table functions, band joins and deep pages against brute force."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from helpers import rows
from millrace.functions import tables
from millrace.operators import joins, relational


class TopGap:
    """The widest gap between neighbouring values of a key that is above a limit."""

    def __init__(self):
        self.last, self.best, self.key = None, None, None

    def eval(self, row, limit: float):
        self.key = row["k"]
        if self.last is not None and row["v"] - self.last > (self.best or limit):
            self.best = row["v"] - self.last
        self.last = row["v"]

    def terminate(self):
        if self.best is not None:
            yield self.key, self.best


def test_table_function_with_arguments_order_and_null_keys(spark, events):
    tables.register(spark, "top_gap", TopGap, "k BIGINT, gap DOUBLE")
    df = events.select(F.when(F.col("user_id") != 3, F.col("user_id")).alias("k"), "event_id", F.col("value").alias("v")).repartition(5)
    got = rows(tables.apply(df, "top_gap", ["k"], ["v", "-event_id"], [1.5]))
    want = []
    for k in {r.k for r in df.collect()}:
        values = sorted(r.v for r in df.collect() if r.k == k)
        gaps = [b - a for a, b in zip(values, values[1:]) if b - a > 1.5]
        want += [(k, round(max(gaps), 6))] if gaps else []
    assert got == sorted(want, key=repr) and len(want) > 5
    with pytest.raises(ValueError):
        tables.register(spark, "nothing", int, "k BIGINT")


def test_streaks_of_empty_tables(spark, events):
    tables.register(spark, "streaks", tables.Streaks, tables.STREAKS)
    empty = events.limit(0).select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("id"))
    assert tables.apply(empty, "streaks", ["key"], ["id"]).collect() == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_band_join(spark, events, how):
    """Half of the values are one value; bands are open, empty, null-bounded and of a single point."""
    left = events.select("event_id", F.when(F.col("event_id") % 2 == 0, 7.0).when(F.col("event_id") % 31 != 1, F.col("value")).alias("v"))
    right = spark.createDataFrame([(1, 0.0, 3.0), (2, 7.0, 7.0), (3, 9.0, 8.0), (4, None, 1.0), (5, 100.0, None), (6, None, None), (7, 6.9, 7.1), (8, 1e9, 2e9), (9, -5.0, -1.0)],
                                  "b int, low double, high double")
    got = joins.band_join(left, right, "v", "low", "high", how, parts=16)
    cond = left.v.isNotNull() & (right.low.isNull() | (left.v >= right.low)) & (right.high.isNull() | (left.v <= right.high))
    want = left.join(right.where("low IS NULL OR high IS NULL OR low <= high"), cond, how)
    assert rows(got, "event_id", "b") == rows(want, "event_id", "b") and got.count() > 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_band_join_on_times_and_empty_sides(spark, events):
    left = events.select("event_id", "ts")
    right = events.where("event_type = 'error'").select(F.col("event_id").alias("e"), (F.col("ts") - F.expr("INTERVAL 3 HOURS")).alias("a"), F.col("ts").alias("b"))
    got = joins.band_join(left, right, "ts", "a", "b", parts=20)
    assert rows(got, "event_id", "e") == rows(left.join(right, (left.ts >= right.a) & (left.ts <= right.b)), "event_id", "e")
    assert joins.band_join(left.limit(0), right, "ts", "a", "b").collect() == [] and joins.band_join(left, right.limit(0), "ts", "a", "b").collect() == []
    with pytest.raises(ValueError):
        joins.band_join(left, left, "ts", "ts", "ts")


def test_hot_value_of_a_band_join_is_dealt(spark):
    left = spark.range(4000).select("id", F.lit(1.0).alias("v"))
    right = spark.createDataFrame([(0.5, 1.5)], "lo double, hi double")
    got = joins.band_join(left, right, "v", "lo", "hi", parts=16)
    assert got.count() == 4000
    assert "pmod" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("first, last", [(1, 10), (400, 460), (991, 1000), (995, 1100), (2000, 2010), (1, 1000)])
def test_deep_pages(events, first, last):
    df = events.select("event_type", "value", "event_id")
    got = relational.deep_page(df, ["-event_type", "value", "event_id"], first, last, 30)
    want = [tuple(r) for r in df.orderBy(F.desc("event_type"), "value", "event_id").collect()][first - 1:last]
    assert [tuple(r) for r in got.collect()] == want


def test_deep_page_sorts_few_ranges(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("x"))
    got = relational.deep_page(df, ["x"], 50_001, 50_100, 50)
    assert got.count() == 100 and relational.deep_page(df.limit(0), ["x"], 1, 5).collect() == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    limits = [int(n) for n in __import__("re").findall(r"LocalLimit (\d+)|GlobalLimit (\d+)", plan) for n in n if n]
    assert limits and max(limits) < 8000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_band_join_of_many_widths(spark, how):
    """Widths from nothing to all, values that are infinite, NaN or far out."""
    odd = spark.createDataFrame([(-1, float("nan")), (-2, float("inf")), (-3, float("-inf")), (-4, -1e12), (-5, None)], "id long, v double")
    left = spark.range(3000).select("id", (F.col("id") * 7919 % 1009 / 8).alias("v")).unionByName(odd)
    start = F.col("b") * 613 % 1013 / 8
    right = spark.range(60).select(F.col("id").alias("b")).select("b", start.alias("low"), (start + F.when(F.col("b") % 7 > 0, F.pow(F.lit(2.0), F.col("b") % 19 - 9)).otherwise(0)).alias("high"))
    right = right.unionByName(spark.createDataFrame([(100, 126.0, float("nan")), (101, float("-inf"), 0.0), (102, float("nan"), float("nan"))], "b long, low double, high double"))
    got = joins.band_join(left, right, "v", "low", "high", how, parts=16)
    assert rows(got, "id", "b") == rows(left.join(right, (left.v >= right.low) & (left.v <= right.high), how), "id", "b")


def test_pairs_of_a_band_join_grow_with_its_matches(spark):
    """Rows that meet on a cell: ranges of a fixed number of rows made 16 parts of 20,000 x 20,000 pairs, 25 million."""
    left = spark.range(20_000).select(F.col("id").alias("x"), F.col("id").cast("double").alias("v"))
    right = left.select(F.col("x").alias("b"), (F.col("v") - 0.1).alias("low"), (F.col("v") + 0.1).alias("high"))
    got = joins.band_join(left, right, "v", "low", "high", parts=16)
    assert got.count() == 20_000
    join = got._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().apply(0)
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    a, b = [DataFrame(dataset.ofRows(spark._jsparkSession, join.children().apply(i)), spark) for i in (0, 1)]
    keys = [k for k in ("level", "cell", "part") if "_" + k in a.columns]
    left_rows = a.groupBy(*[F.col("_" + k).alias(k) for k in keys]).agg(F.count("*").alias("n"))
    right_rows = b.groupBy(*[F.col("_r_" + k).alias(k) for k in keys]).agg(F.count("*").alias("m"))
    assert left_rows.join(right_rows, keys).agg(F.sum(F.col("n") * F.col("m"))).first()[0] < 200_000


def test_table_function_makes_no_arrow_table_for_each_row(spark):
    tables.register(spark, "streaks", tables.Streaks, tables.STREAKS)
    df = spark.range(5000).select((F.col("id") % 3).alias("key"), (F.col("id") % 2).cast("string").alias("value"), "id")
    got = tables.apply(df, "streaks", ["key"], ["id"])
    assert got.count() == 5000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def rows_to_meet(spark, got):
    """Rows of both sides at the join."""
    join = got._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().apply(0)
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    return [DataFrame(dataset.ofRows(spark._jsparkSession, join.children().apply(i)), spark).count() for i in (0, 1)]


def test_widths_of_few_bands_copy_no_rows_of_a_band_join(spark):
    """Bands cut short by the last value, and one over all values: each of their widths was a copy of the 4,000 rows."""
    left = spark.range(4000).select(F.col("id").alias("x"), (F.col("id") / 10).alias("v"))
    right = spark.range(4100).select(F.col("id").alias("b"), (F.col("id") / 10 - 1.97).alias("low"), (F.col("id") / 10 + 2.03).alias("high"))
    right = right.unionByName(spark.createDataFrame([(-1, -1e9, 1e9), (-2, 7.0, 7.0)], "b long, low double, high double"))
    got = joins.band_join(left, right, "v", "low", "high", parts=16)
    assert rows(got, "x", "b") == rows(left.join(right, (left.v >= right.low) & (left.v <= right.high)), "x", "b")
    a, b = rows_to_meet(spark, got)
    assert a == 4000 and b < 4 * 4102


@pytest.mark.parametrize("bands, want", [
    ({}, {}), ({-3: 1, 0: 2, 2: 50_000}, {-3: 2, 0: 2, 2: 2}), ({2: 50_000, 6: 3, 30: 1}, {2: 2, 6: 2, 30: 30}),
    ({-8: 900_000, 6: 900_000}, {-8: -8, 6: 6}), ({5: 10}, {5: 5})])
def test_levels_of_a_band_join(bands, want):
    """A level with many bands stays, one with few goes to the nearest in use, unless it is too far below."""
    assert joins._filed(bands, 1_000_000, [float(x) for x in range(0, 100_001, 1000)]) == want


def test_levels_of_a_band_join_heed_where_the_rows_are():
    """Nearly all rows lie in a thousandth of the span: there, wider cells would hold a tenth of them."""
    spread, dense = [x * 1000.0 for x in range(101)], [x / 10 for x in range(100)] + [100_000.0]
    bands = {-5: 2000, 0: 50_000}
    assert joins._filed(bands, 1_000_000, spread) == {-5: 0, 0: 0}
    assert joins._filed(bands, 1_000_000, dense) == {-5: -5, 0: 0}
