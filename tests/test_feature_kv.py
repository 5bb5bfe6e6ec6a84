"""The key-value feature store: newest rows, time to live, tables and streams, restarts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import rows
from millrace.sources.feature_kv import FeatureStore, Folder, StreamWriter, Settings, Written
from test_streams import folder, stream  # noqa: F401 - the folder is a fixture

SCHEMA = "k BIGINT, s STRING, at TIMESTAMP, v DOUBLE"


@pytest.fixture()
def store(spark, tmp_path):
    spark.dataSource.register(FeatureStore)
    options = {"path": (tmp_path / "store").as_uri(), "keys": "k,s", "ts": "at", "buckets": "4"}

    def put(values, mode="append"):
        spark.createDataFrame(values, SCHEMA).repartition(3).write.format("feature_kv").options(**options).mode(mode).save()

    def get(**more):
        return rows(spark.read.format("feature_kv").schema(SCHEMA).options(**options, **more).load(), "k", "s", "v")

    return put, get, options


def day(n, hour=0):
    return datetime(2024, 1, n, hour)


def test_newest_rows_and_time_to_live(store):
    put, get, _ = store
    put([(1, "a", day(1), 1.0), (1, "a", day(5), 5.0), (1, None, day(2), 2.0), (None, "a", day(3), 3.0), (2, "b", None, 9.0)])
    put([(1, "a", day(3), 3.0), (2, "a", day(9), 9.0), (1, None, day(2), 2.5)])
    put([])
    assert get() == sorted([(1, "a", 5.0), (1, None, 2.5), (None, "a", 3.0), (2, "a", 9.0)], key=repr)  # of equal times the later commit
    assert get(asOf="2024-01-04") == sorted([(1, "a", 3.0), (1, None, 2.5), (None, "a", 3.0)], key=repr)
    assert get(asOf="2024-01-04", ttl="36 hours") == sorted([(1, "a", 3.0), (None, "a", 3.0)], key=repr)
    assert get(ttl="1 day") == []
    put([(7, "z", day(1), 7.0)], "overwrite")
    assert get() == [(7, "z", 7.0)]


def test_empty_store_and_bad_options(spark, store):
    _, get, options = store
    assert get() == []
    with pytest.raises(Exception, match="feature_kv needs"):
        spark.read.format("feature_kv").schema(SCHEMA).options(path=options["path"]).load().collect()


def test_a_batch_written_twice_counts_once(store):
    _, _, options = store
    folder = Folder(options["path"])
    writer = StreamWriter(Settings(options))
    for n in (0, 1):
        folder.write(f"data/00000/{n}.parquet", b"rows")
        writer.commit([Written([f"data/00000/{n}.parquet"]), None], 7)
    assert folder.names("_commits") == ["000000000000-stream-7.json"] and folder.names("data/00000") == ["0.parquet"]
    folder.write("data/00000/2.parquet", b"rows")
    writer.abort([Written(["data/00000/2.parquet"])], 8)
    assert folder.names("data/00000") == ["0.parquet"]


def test_streams_write_restart_and_read(spark, events, folder, store, tmp_path):  # noqa: F811
    _, _, options = store
    options = {**options, "keys": "user_id", "ts": "ts"}
    source = stream(spark, events, folder).select("user_id", "ts", "event_id", "value")

    def run(checkpoint):
        q = (source.writeStream.format("feature_kv").options(**options).outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / checkpoint)).start())
        q.awaitTermination()

    run("c1")
    commits = Folder(options["path"]).names("_commits")
    assert len(commits) >= 3
    run("c1")  # nothing new
    run("c2")  # the same batches under the same name: written before
    assert Folder(options["path"]).names("_commits") == commits
    got = spark.read.format("feature_kv").schema(source.schema).options(**options).load()
    assert rows(got, "user_id", "event_id") == rows(events.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id")), "user_id", "event_id")
    seen = spark.readStream.format("feature_kv").schema(source.schema).options(**options).load()
    for _ in range(2):
        q = seen.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start(str(tmp_path / "out"))
        q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "event_id") == rows(events, "event_id")
