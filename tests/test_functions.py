"""Stated vectors of the functions, and their edge inputs."""

import math
import pytest
from pyspark.sql import functions as F

from helpers import rows
from millrace.functions import library as L, scalar as S
from millrace.operators import relational as rel


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("score,level", [(0.90, "CRITICAL"), (0.80, "CRITICAL"), (0.60, "HIGH"), (0.55, "HIGH"), (0.40, "MEDIUM"),
                                         (0.30, "MEDIUM"), (0.10, "LOW")])
def test_classify_risk(spark, score, level):
    assert one(spark, L.classify_risk(F.col("s")), s=score) == level


@pytest.mark.parametrize("level,asset,tx,sanctioned,out", [
    ("MEDIUM", 95000, 25, 0, "CRITICAL"), ("LOW", 200, 5, 1, "CRITICAL"), ("HIGH", 60000, 0, 0, "CRITICAL"),
    ("HIGH", 50, 1, 0, "MEDIUM"), ("MEDIUM", 200, 5, 0, "MEDIUM"), ("LOW", 50, 1, 0, "LOW")])
def test_enrich_severity(spark, level, asset, tx, sanctioned, out):
    c = L.enrich_severity(F.col("l"), F.col("a"), F.col("t"), F.col("s"))
    assert one(spark, c, l=level, a=asset, t=tx, s=sanctioned) == out


def test_weighted_avg(spark):
    df = spark.createDataFrame([(0.9, 100000.0), (0.2, 500.0), (0.6, 50000.0)], "v double, w double")
    assert df.agg(L.weighted_avg(F.col("v"), F.col("w")).alias("x")).first().x == pytest.approx(120100 / 150500)
    assert df.where("false").agg(L.weighted_avg(F.col("v"), F.col("w")).alias("x")).first().x is None


@pytest.mark.parametrize("amount,band", [(10000, "WHALE"), (9999, "LARGE"), (2500, "LARGE"), (500, "MEDIUM"), (50, "SMALL"), (49, "MICRO")])
def test_amount_band(spark, amount, band):
    assert one(spark, L.amount_band(F.col("a")), a=amount) == band


@pytest.mark.parametrize("ms,flag", [(49, "INSTANT"), (50, "FAST"), (150, "NORMAL"), (400, "SLOW")])
def test_velocity_flag(spark, ms, flag):
    assert one(spark, L.velocity_flag(F.col("m")), m=ms) == flag


@pytest.mark.parametrize("ms,risk,tier", [(99, 0.29, "PLATINUM"), (99, 0.3, "GOLD"), (199, 0.54, "GOLD"), (399, 0.79, "SILVER"),
                                          (399, 0.80, "BREACHED"), (400, 0.1, "BREACHED")])
def test_sla_tier(spark, ms, risk, tier):
    assert one(spark, L.sla_tier(F.col("m"), F.col("r")), m=ms, r=risk) == tier
    L.register_band_functions(spark)
    assert spark.sql(f"SELECT sla_tier({ms}, {risk}D) AS x").first().x == tier


@pytest.mark.parametrize("card,out", [(None, "****-****-****-****"), ("1234567", "****-****-****-****"), ("12345678", "1234-****-****-5678"),
                                      ("4111111111111234", "4111-****-****-1234")])
def test_mask_card(spark, card, out):
    assert one(spark, S.mask_card(F.col("c").cast("string")), c=card) == out


@pytest.mark.parametrize("mail,out", [(None, "**@***.***"), ("a@x.org", "**@***.***"), ("ab@x.org", "ab***@x.org"), ("nobody", "**@***.***"),
                                      ("alice@x.org", "al***@x.org")])
def test_mask_email(spark, mail, out):
    assert one(spark, S.mask_email(F.col("m").cast("string")), m=mail) == out


@pytest.mark.parametrize("code,out", [(" usd ", "USD"), ("Sgd", "SGD"), ("XXX", "UNKNOWN"), (None, "UNKNOWN")])
def test_normalize_currency(spark, code, out):
    assert one(spark, S.normalize_currency(F.col("c").cast("string")), c=code) == out


def test_duration_text(spark):
    assert one(spark, S.fmt_duration(F.col("s")), s=7500) == "2h 5m"
    L.register_band_functions(spark)
    assert spark.sql("SELECT fmt_duration(7500) AS x").first().x == "2h 5m"


def test_json(spark):
    doc = '{"a": 1, "b": {"c": [1, 2]}, "n": null, "t": "x", "bad": "q"}'
    df = spark.createDataFrame([(doc,)], "d string")
    got = df.select(S.json_value("d", "$.a", "int"), S.json_value("d", "$.b"), S.json_value("d", "$.bad", "int", -1),
                    S.json_query("d", "$.b"), S.json_query("d", "$.a"), S.json_exists("d", "$.n"), S.json_exists("d", "$.t")).first()
    assert tuple(got) == (1, None, -1, '{"c":[1,2]}', None, False, True)


@pytest.mark.parametrize("value,digits,out", [(1.999, 2, 1.99), (-1.999, 2, -1.99), (5.0, 0, 5.0), (0.05, 1, 0.0)])
def test_truncate(spark, value, digits, out):
    assert one(spark, S.truncate("v", digits), v=value) == pytest.approx(out)


def test_split_index_is_literal(spark):
    assert one(spark, S.split_index("s", ".", 1), s="a.b.c") == "b"
    assert one(spark, S.split_index("s", "|", 3), s="a|b") is None


def test_logarithm_at_the_edge(spark):
    got = spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "v double").select(S.logarithm("v").alias("x")).collect()
    assert got[0].x == float("-inf") and got[1].x == 0.0 and got[2].x != got[2].x


def test_function_inventory(spark):
    L.create_sql_function(spark, "plus_two", "x INT", "INT", "x + 2")
    assert "plus_two" in L.list_functions(spark)
    L.create_sql_function(spark, "plus_two", "x INT", "INT", "x + 3", if_not_exists=True)
    assert spark.sql("SELECT plus_two(1) AS x").first().x == 3
    L.drop_function(spark, "plus_two")
    assert not L.function_exists(spark, "plus_two")


def test_split_route_with_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, v int")
    parts = rel.split_route(df, {"low": "v < 10", "any": "v IS NOT NULL"}, rest="rest")
    assert [rows(parts[k], "id") for k in ("low", "any", "rest")] == [[(1,)], [(1,), (3,)], [(2,)]]


def test_search_ignores_case_and_nulls(spark):
    df = spark.createDataFrame([(1, "Abc"), (2, None), (3, "xyz")], "id int, s string")
    assert rows(rel.search_any(df, "aB"), "id") == [(1,)]


def test_edges(spark):
    df = spark.range(10)
    assert rel.redistribute(df, "hash", ["id"], 3).rdd.getNumPartitions() == 3
    assert rel.redistribute(df, "rebalance", partitions=2).rdd.getNumPartitions() == 2
    assert "Rebalance" in rel.redistribute(df, "rebalance")._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        rel.redistribute(df, "hash")


def test_rounding_of_doubles_as_sql_does(spark):
    """Values where Spark's own round, by decimal text, differs from DuckDB's, by scaling; ends of the range."""
    import duckdb
    values = [(368.07866875499997, 8), (109.14999999999999, 1), (-109.14999999999999, 1), (29.249999999999996, 1), (-29.249999999999996, 1), (2.5, 0), (-2.5, 0), (1e300, 8), (5e307, 8), (0.0, 8)]
    texts = ", ".join(f"round({v!r}::DOUBLE, {d})" for v, d in values)
    want = duckdb.connect().execute(f"SELECT {texts}").fetchall()[0]
    df = spark.range(1)
    got = tuple(df.select(*[S.rounded(F.lit(v), d).alias(f"c{i}") for i, (v, d) in enumerate(values)]).first())
    assert got == want
    assert tuple(df.select(*[F.round(F.lit(v), d).alias(f"c{i}") for i, (v, d) in enumerate(values)]).first()) != want
    odd = df.select(S.rounded(F.lit(float("nan")), 2).alias("a"), S.rounded(F.lit(float("-inf")), 2).alias("b"), S.rounded(F.lit(None), 2).alias("c")).first()
    assert math.isnan(odd.a) and odd.b == float("-inf") and odd.c is None


def test_named_queries_round_as_their_sql(spark, tmp_path):
    """Logarithms and averages whose scaled value meets a half; Spark's round by text gave another last digit."""
    import duckdb
    from queries.all import ORACLE, QUERIES
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) MINUTE AS ts, i AS user_id, 'view' AS event_type,
      CASE WHEN i = 1 THEN 1924.79 WHEN i = 2 THEN 109.14999999999999 WHEN i = 3 THEN 312.298957295 WHEN i = 4 THEN 163.44119310999997 WHEN i = 5 THEN 36.673836356320486 ELSE i * 0.13 + 1 END::DOUBLE AS value, '' AS props FROM range(200) t(i)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("feat_math", "fn_math2", "flow_race_positions", "flow_race_tyres"):
        got, want = QUERIES[name](spark, str(tmp_path)).toArrow(), con.execute(ORACLE[name]).to_arrow_table()
        order = [(c, "ascending") for c in ("event_id", "window_start", "driver") if c in want.column_names]
        got, want = (t.select(sorted(want.column_names)).sort_by(order).to_pylist() for t in (got, want))
        assert got == want, name
