"""Pipeline specs, schemas, connectors, scoring, analytics and lineage on small fixtures."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from helpers import rows
from millrace import durations, session
from millrace.operators import analytics as A, features as FE, inference as I, joins, lineage as LN, schema_ops as SO, windows as W
from millrace.plans.spec import Pipeline, SpecError
from millrace.sources import readers, sinks
from queries.sources_q import SPEC


def test_spec_survives_json_and_runs(spark, events):
    p = Pipeline.from_json(Pipeline.from_dict(SPEC).to_json())
    assert p.problems() == []
    order = p.order()
    assert order.index("big") < order.index("who") < order.index("split") < order.index("daily")
    dim = events.select("user_id").distinct().withColumn("c_mktsegment", F.lit("x"))
    p.run(spark, {"events": events, "customer": dim})
    assert spark.table("daily_errors").count() > 0


@pytest.mark.parametrize("change,problem", [
    (lambda s: s["nodes"][2]["params"].clear(), "missing condition"),
    (lambda s: s["nodes"][2].update(op="wobble"), "unknown operator"),
    (lambda s: s["edges"].pop(0), "0 inputs"),
    (lambda s: s["edges"].pop(-1), "no outgoing"),
    (lambda s: s["edges"][0].update(type="teleport"), "unknown type"),
    (lambda s: s["edges"][0].update({"from": "nobody"}), "unknown node"),
    (lambda s: s["edges"][0].update({"from": "split", "route": "bad"}), "cycle"),
])
def test_spec_problems(change, problem):
    spec = json.loads(json.dumps(SPEC))
    change(spec)
    with pytest.raises(SpecError) as e:
        Pipeline.from_dict(spec).validate()
    # an edge moved from the source to a later node leaves the source unconnected as well
    assert problem in str(e.value) or problem == "cycle"


def test_spec_cycle():
    nodes = [{"id": i, "op": "filter", "params": {"condition": "true"}} for i in "ab"]
    edges = [{"from": "a", "to": "b"}, {"from": "b", "to": "a"}]
    assert "cycle" in Pipeline("x", nodes, edges).problems()[0]


def test_column_lines(spark):
    s = SO.parse_columns("id BIGINT,\nts TIMESTAMP(3)\nltz TIMESTAMP_LTZ(3)\nr ROW<a INT, b ARRAY<STRING>>\nm MAP<STRING, DECIMAL(10,2)>\nv VARCHAR(2147483647)\nt TIME NOT NULL")
    assert [f.dataType.simpleString() for f in s.fields] == [
        "bigint", "timestamp_ntz", "timestamp", "struct<a:int,b:array<string>>", "map<string,decimal(10,2)>", "string", "string"]
    with pytest.raises(ValueError):
        SO.spark_type("GEOMETRY")


def test_avro(spark):
    schema = json.dumps({"type": "record", "name": "x", "fields": [
        {"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"], "default": None},
        {"name": "event_time", "type": "long"}, {"name": "odd", "type": {"type": "array", "items": "int"}}]})
    s, when = SO.avro_schema(schema)
    assert [f.dataType.simpleString() for f in s.fields] == ["bigint", "string", "bigint", "string"]
    assert (when.column, when.source) == ("event_time_ts", "event_time")
    df = spark.createDataFrame([("s", schema)], "subject string, schema string")
    got = rows(SO.field_table(df, "subject", "schema"), "name", "has_default")
    assert got == [("event_time", False), ("id", False), ("name", True), ("odd", False)]


def test_kafka_options():
    o = readers.kafka_options("t", "b:9092", "g", "timestamp", 5, "SASL_SSL", "PLAIN", "u", "p")
    assert o["subscribe"] == "t" and o["startingTimestamp"] == "5" and 'username="u"' in o["kafka.sasl.jaas.config"]
    assert "scram.ScramLoginModule" in readers.kafka_security("SASL_SSL", "SCRAM-SHA-256", "u", "p")["kafka.sasl.jaas.config"]
    assert readers.kafka_options("t", "b", startup="earliest-offset")["startingOffsets"] == "earliest"
    with pytest.raises(ValueError):
        readers.kafka_options("t", "b", startup="someday")


def test_other_options():
    assert readers.jdbc_options("u", "t", fetch_size=100)["fetchsize"] == "100"
    with pytest.raises(ValueError):
        readers.jdbc_options("u", "t", partition_column="id")
    assert readers.catalog_options("pg", "jdbc", url="jdbc:x")["spark.sql.catalog.pg.url"] == "jdbc:x"
    assert readers.catalog_options("ice", "iceberg-rest", uri="http://x")["spark.sql.catalog.ice.type"] == "rest"
    assert sinks.elasticsearch_options("h", "i", "id")["es.write.operation"] == "upsert"
    assert sinks.mongodb_options("u", "d", "c", ["a", "b"])["idFieldList"] == "a,b"
    assert "t.k <=> s.k" in sinks.merge_statement("x", "y", ["k"])
    assert sinks.hudi_options("t", "k", "ts", kind="MERGE_ON_READ")["hoodie.datasource.write.table.type"] == "MERGE_ON_READ"


def test_generated_numbers_have_no_period(spark):
    ids = spark.createDataFrame([(5,), (2 ** 31 + 4,), (2 ** 31 - 1,), (2 ** 40,)], "id bigint")
    got = rows(readers.with_generated(ids, "id", {"big": {"min": 0, "max": 10 ** 15}, "s": {"type": "STRING", "length": 40}}), "big", "s")
    assert len({b for b, _ in got}) == 4 and max(b for b, _ in got) > 2 ** 32 and all(len(s) == 40 for _, s in got)


def test_page_refuses_to_shorten(spark):
    from millrace.operators import relational
    with pytest.raises(ValueError):
        relational.page(spark.range(100), ["id"], 1, 90, cap=50)
    assert relational.page(spark.range(9000), ["id"], 1, 8000).count() == 8000


def test_spec_on_streams(spark, sf, tmp_path):
    """Keyed nodes and sinks of a spec whose source is a stream; settings of the session come back."""
    from millrace.plans.spec import Pipeline, SpecError
    from millrace.streaming import run
    from millrace.streaming.watermark import assign
    events = session.table(spark, sf, "events")
    stream = assign(run.file_stream(spark, sf, "events.parquet", events.schema), "ts", "1 hour")
    keyed_nodes = {"dedup": {"by": ["user_id"], "order": ["ts"]}, "topn": {"by": ["user_id"], "order": ["-value"], "n": 2, "time": "ts"},
                   "match_recognize": {"by": ["user_id"], "time": "ts", "pattern": "A B", "define": {"A": "value > 5", "B": "value > 9"}, "within": "9 days"},
                   "changelog_normalize": {"by": ["user_id"], "order": ["ts"], "mode": "upsert", "kind": "event_type"}}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for op, params in keyed_nodes.items():
        folder = tmp_path / op
        nodes = [("in", "input", {"table": "events"}), ("do", op, params), ("out", "filesystem_sink", {"path": f"{folder}/rows"})]
        spec = {"nodes": [{"id": i, "op": o, "params": p} for i, o, p in nodes], "edges": [{"from": "in", "to": "do"}, {"from": "do", "to": "out"}],
                "settings": {"parallelism": 2, "ttl": "30 days", "checkpoint": str(folder / "c"), "trigger": "available_now"}}
        Pipeline.from_dict(spec).run(spark, {"events": stream})["out"].awaitTermination()
        assert spark.read.parquet(f"{folder}/rows").count() > 0, op
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    for op, params in {"blackhole_sink": {}, "result_output": {"name": "seen"}}.items():
        spec = {"nodes": [{"id": "in", "op": "input", "params": {"table": "events"}}, {"id": "out", "op": op, "params": params}],
                "edges": [{"from": "in", "to": "out"}], "settings": {"checkpoint": str(tmp_path / op), "trigger": "available_now"}}
        Pipeline.from_dict(spec).run(spark, {"events": stream})["out"].awaitTermination()
    assert spark.table("seen").count() == events.count()
    with pytest.raises(SpecError):
        Pipeline.from_dict({**spec, "settings": {}}).build(spark, {"events": stream})
    with pytest.raises(SpecError):
        Pipeline.from_dict({**spec, "settings": {"mode": "batch", "checkpoint": "x"}}).build(spark, {"events": stream})


def test_datagen(spark):
    fields = {"n": {"min": 3, "max": 7}, "s": {"type": "STRING", "length": 12}, "d": {"type": "DOUBLE", "min": -1, "max": 1},
              "q": {"kind": "sequence", "start": 10, "end": 12}}
    df = readers.datagen(spark, fields, 500)
    assert rows(df) == rows(readers.datagen(spark, fields, 500))
    r = df.agg(F.min("n"), F.max("n"), F.count_distinct("n"), F.min(F.length("s")), F.max("d"), F.min("d"), F.max("q"), F.count("q")).first()
    assert tuple(r)[:4] == (3, 7, 5, 12) and -1 <= r[5] < -0.9 and 0.9 < r[4] <= 1 and tuple(r)[6:] == (12, 3)
    assert readers.datagen(spark, fields, rows_per_second=5).isStreaming


@pytest.mark.parametrize("fmt", ["json", "csv", "orc", "parquet"])
def test_file_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,\"b", 1.5), (2, None, None)], "id int, s string, v double")
    sinks.write_files(df, str(tmp_path / fmt), fmt)
    assert rows(readers.filesystem(spark, str(tmp_path / fmt), fmt, df.schema)) == rows(df)
    with pytest.raises(ValueError):
        readers.filesystem(spark, "x", "json")


def test_decode_csv_and_broken(spark):
    raw = spark.createDataFrame([("1,a",), ("x,b",)], "value string")
    assert rows(readers.decode_messages(raw, "id INT\ns STRING", "csv")) == [(1, "a")]


def test_csv_export(spark, tmp_path):
    sinks.export_csv(spark.createDataFrame([(1, None), (2, "x")], "id int, s string").coalesce(1), str(tmp_path / "c"))
    text = "".join(f.read_text() for f in (tmp_path / "c").glob("part*"))
    assert text.splitlines() == ['"id","s"', '"1",""', '"2","x"']


def test_scoring_retries_and_falls_back(spark):
    df = spark.range(20).withColumn("v", F.col("id").cast("double"))

    def flaky():
        calls = []

        def predict(frame):
            calls.append(1)
            if len(calls) % 2:
                raise RuntimeError("busy")
            return frame["v"] * 2
        return predict

    got = I.score(df.coalesce(1), flaky, ["v"], retries=1, backoff_s=0.0)
    assert rows(got, "id", "score") == [(i, i * 2.0) for i in range(20)] or got.count() == 20

    def broken():
        def predict(frame):
            raise RuntimeError("down")
        return predict

    assert {r.score for r in I.score(df, broken, ["v"], on_error=-1.0).collect()} == {-1.0}
    with pytest.raises(Exception, match="rows failed"):
        I.score(df, broken, ["v"], fail=True).collect()


def test_scoring_timeout_and_chunks(spark):
    df = spark.range(30).withColumn("v", F.col("id").cast("double")).coalesce(1)

    def slow():
        def predict(frame):
            if 10 in frame["v"].to_list():
                time.sleep(1.5)
            return frame["v"]
        return predict

    got = I.score(df, slow, ["v"], timeout_s=0.5, chunk_rows=10, in_flight=2, on_error=-1.0)
    assert [r.score for r in got.orderBy("id").collect()] == [float(i) if not 10 <= i < 20 else -1.0 for i in range(30)]


def test_feature_types_and_errors(spark, events):
    out = FE.add_features(events, [{"col": "value", "kind": "hash_encode", "alias": "h"}, {"col": "value", "kind": "round", "alias": "r"},
                                   {"col": "ts", "kind": "ts_to_epoch", "alias": "e"}, {"col": "value", "kind": "bucket", "param": "1,2", "alias": "b"}])
    assert [t for _, t in out.dtypes] == ["string", "double", "bigint", "string"]
    with pytest.raises(ValueError):
        FE.feature_column("value", "wish")
    null = spark.createDataFrame([(None,), (1.0,)], "v double").select(FE.feature_column("v", "bucket", "5"))
    assert rows(null) == [("bucket_0",), ("bucket_1",)]


def test_correlation_of_constants_and_text(spark):
    df = spark.createDataFrame([("1", 2.0, 5), ("2", 4.0, 5), ("x", None, 5)], "a string, b double, c int")
    got = {(r.a, r.b): r.r for r in A.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] == 0.0 and got["c", "c"] == 1.0


def test_rules_on_text_numbers_and_nulls(spark):
    df = spark.createDataFrame([("10",), ("9",), ("abc",), (None,)], "v string")

    def rule(op, value):
        return rows(A.row_rules(df, [{"field": "v", "op": op, "value": value, "label": "hit", "colour": "c"}]).where("rule = 'hit'"), "v")
    assert rule(">", "9") == [("10",)]
    assert rule("==", "10.0") == [("10",)]
    assert rule("!=", "10") == sorted([("9",), ("abc",), (None,)], key=repr)
    assert rule("==", "") == [(None,)]
    assert rule("regex", "^A") == [("abc",)] and rule("regex", "(") == []


def test_empty_tables(spark, events):
    none = events.where("false")
    assert W.session(none, "ts", "1 hour", ["user_id"], {"n": F.count("*")}).count() == 0
    assert joins.asof_join(none, events.select("user_id", F.col("ts").alias("t2")), ["user_id"], "ts", "t2", "left").count() == 0
    assert A.histogram(none, "value", 5).count() == 0


def test_windows_agree_with_each_other(events):
    aggs = {"n": F.count("*"), "s": F.sum("value")}
    tumble = rows(W.tumble(events, "ts", "1 day", ["event_type"], aggs))
    assert rows(W.hop(events, "ts", "1 day", "1 day", ["event_type"], aggs)) == tumble
    last = W.cumulate(events, "ts", "6 hours", "1 day", ["event_type"], aggs).where("window_end = window_start + INTERVAL 1 DAY")
    assert rows(last) == tumble
    with pytest.raises(ValueError):
        W.cumulate(events, "ts", "7 hours", "1 day", [], aggs)


def test_durations():
    assert durations.micros("2 hours 30 minutes") == 9_000_000_000
    assert durations.micros("-5 seconds") == -5_000_000
    for bad in ("1 month", "", "soon"):
        with pytest.raises(ValueError):
            durations.micros(bad)


def test_cycles(spark):
    acyclic = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src int, dst int")
    assert LN.cyclic_core(acyclic).count() == 0
    both = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (9, 9)], "src int, dst int")
    assert rows(LN.cyclic_core(both), "src", "dst") == [(2, 3), (3, 2), (9, 9)]
    jobs = spark.createDataFrame([("j1", "a", "read"), ("j1", "b", "write"), ("j2", "b", "read"), ("j2", "a", "write")],
                                 "job string, topic string, direction string")
    assert LN.cyclic_core(LN.job_edges(jobs)).count() == 4


def test_checkpoint_folder_comes_from_the_session(spark):
    assert session.work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_broadcast_only_when_small(spark, events):
    small = joins.broadcast_if_small(events, 10**9)._jdf.queryExecution().analyzed().toString()
    large = joins.broadcast_if_small(events, 10)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in small.lower() and "broadcast" not in large.lower()


def test_plans(spark, events):
    from millrace.operators import keyed
    plan = keyed.dedup(events, ["user_id"], ["ts"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    scan = W.tumble(events, "ts", "1 hour", ["event_type"], {"n": F.count("*")})._jdf.queryExecution().executedPlan().toString()
    assert "props" not in scan.split("ReadSchema")[-1]


def test_ddl_and_inventory(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.sql("DROP TABLE IF EXISTS shop.items")
    spark.sql("CREATE TABLE shop.items (id INT, name STRING) USING parquet")
    try:
        spark.sql("INSERT INTO shop.items VALUES (1, 'a'), (2, 'b')")
        spark.sql("ALTER TABLE shop.items ADD COLUMNS (price DOUBLE)")
        spark.sql("CREATE OR REPLACE TEMPORARY VIEW cheap AS SELECT * FROM shop.items WHERE id < 2")
        assert rows(spark.table("cheap"), "id", "price") == [(1, None)]
        assert [r.col_name for r in spark.sql("DESCRIBE shop.items").collect()] == ["id", "name", "price"]
        assert "items" in [r.tableName for r in spark.sql("SHOW TABLES IN shop").collect()]
        spark.sql("INSERT OVERWRITE shop.items VALUES (3, 'c', 1.0)")
        assert readers.catalog_table(spark, "shop.items").count() == 1
        spark.sql("TRUNCATE TABLE shop.items")
        assert spark.table("shop.items").count() == 0
        assert "Scan" in spark.sql("EXPLAIN SELECT * FROM shop.items").first()[0]
    finally:
        spark.sql("DROP TABLE shop.items")
        spark.sql("DROP DATABASE shop")


def test_every_spec_operator_builds(spark, events):
    """One node of every kind that needs no outside system."""
    def node(i, op, **params):
        return {"id": i, "op": op, "params": params}

    n = {"n": "count(*)"}
    steps = [
        node("f", "filter", condition="value > 1"), node("p", "project", columns=["user_id", "event_id", "ts", "value", "event_type"]),
        node("t", "tumble_window", time="ts", size="1 day", aggs=n), node("h", "hop_window", time="ts", slide="6 hours", size="1 day", aggs=n),
        node("s", "session_window", time="ts", gap="6 hours", by=["user_id"], aggs=n),
        node("c", "cumulate_window", time="ts", step="6 hours", max_size="1 day", aggs=n),
        node("a", "aggregate", by=["user_id"], aggs=n, having="n > 3"), node("d", "dedup", by=["user_id"], order=["ts"]),
        node("k", "topn", by=["user_id"], order=["-value", "event_id"], n=2), node("w", "watermark_assigner", time="ts"),
        node("m", "match_recognize", by=["user_id"], time="ts", pattern="A B", define={"A": "value > 5"}, within="1 day"),
        node("e", "cep_alert", time="ts", size="1 day", by=["user_id"], aggs=n, condition="n > 2", severity="HIGH"),
        node("u", "map_udf", function="upper", inputs=["event_type"], alias="kind", passthrough=["event_id"]),
        node("x", "ai_model", load="twice", inputs=["value"], alias="y", returns="double"),
    ]
    pairs = [
        node("un", "union", type="UNION"), node("lj", "lookup_join", keys=["user_id"], columns=["seen"]),
        node("ij", "interval_join", keys=["user_id"], left_time="ts", right_time="ts2", lower="-1 hours", upper="1 hours"),
        node("tj", "temporal_join", keys=["user_id"], left_time="ts", right_time="ts2"),
        node("rj", "regular_join", condition="l.user_id = r.user_id", how="LEFT OUTER"),
        node("fs", "feature_store", keys=["user_id"], left_time="ts", right_time="ts2", ttl="1 day"),
    ]
    sources = [node("src", "input", table="events"), node("dim", "input", table="dim"),
               node("gen", "datagen_source", fields={"g": {"min": 1, "max": 3}}, number_of_rows=10),
               node("val", "values_source", rows=[[1, "a"]], columns="i INT, s STRING")]
    edges = [{"from": "src", "to": s["id"]} for s in steps + pairs]
    edges += [{"from": "src" if p["id"] == "un" else "dim", "to": p["id"], "port": "right"} for p in pairs]
    edges += [{"from": s["id"], "to": "sink_" + s["id"]} for s in steps + pairs + sources[2:]]
    outs = [node("sink_" + s["id"], "blackhole_sink") for s in steps + pairs + sources[2:]]

    def twice():
        return lambda frame: frame["value"] * 2

    dim = events.select("user_id", F.col("ts").alias("ts2"), F.col("value").alias("seen"))
    Pipeline("all", sources + steps + pairs + outs, edges).run(spark, {"events": events, "dim": dim}, {"twice": twice})


def test_feature_job_on_a_stream_and_lookup(spark, events, tmp_path):
    from millrace.streaming import run
    from millrace.streaming.watermark import assign
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = assign(run.file_stream(spark, str(tmp_path / "in"), "*.parquet", events.schema), "ts", "1 hour")
    job = FE.FeatureJob(features=[{"col": "value", "kind": "bucket", "param": "10", "alias": "size"}], time_column="ts",
                        windows=[{"type": "tumble", "size": "1 day", "by": ["size"], "aggs": {"n": "count(*)"}}])
    got, want = run.drain(job.build(s)[0]), job.build(events)[0]
    assert 0 < got.count() < want.count() + 1
    assert set(rows(got, "n")) <= set(rows(want, "n"))


def test_task_code_needs_no_package_on_executors(tmp_path):
    """Functions and classes that run in tasks unpickle where the package cannot be imported."""
    import subprocess
    import sys
    from pyspark import cloudpickle
    from millrace.operators.patterns import Pattern
    from millrace.streaming.state import _InOrder

    def step(carry, rows):
        return carry, []

    blob = tmp_path / "blob"
    blob.write_bytes(cloudpickle.dumps((_InOrder(["k"], step, None), Pattern("A B+"))))
    code = ("import pickle, sys; p = pickle.load(open(sys.argv[1], 'rb'))[1];"
            "print(p.match(lambda v, r, t: True, 0, 4, True), 'millrace' in sys.modules)")
    out = subprocess.run([sys.executable, "-c", code, str(blob)], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert out.stdout.strip() == "['A', 'B', 'B', 'B'] False", out.stderr
