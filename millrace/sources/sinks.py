"""Sinks: files, Kafka messages, JDBC, console, noop, results, and several from one input."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace import session
from millrace.sources.readers import kafka_security


def write_files(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                max_rows_per_file: int | None = None, mode: str = "append", **options) -> None:
    """Rows go to the task of their partition values first, so that a partition is not one file per task.

    AQE splits a busy partition value over several tasks.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.save(path)


def stream_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                 roll: str | None = None, name: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Files per micro-batch; the trigger interval is the rolling interval. Commits are exactly once."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=roll) if roll else writer
    return writer.start(path)


def encode_messages(df: DataFrame, key: Sequence[str] = (), fmt: str = "json") -> DataFrame:
    """Rows to (key, value) messages; NULL fields are written."""
    if fmt == "json":
        value = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    elif fmt == "csv":
        value = F.to_csv(F.struct("*"))
    elif fmt == "avro":
        from pyspark.sql.avro.functions import to_avro
        value = to_avro(F.struct("*"))
    else:
        raise ValueError(f"cannot encode {fmt!r}")
    columns = [value.alias("value")]
    if key:
        columns.insert(0, F.to_json(F.struct(*key)).alias("key"))
    return df.select(*columns)


def encode_upserts(df: DataFrame, key: Sequence[str], kind: str = "row_kind") -> DataFrame:
    """Changelog to keyed messages: deletes become tombstones, before-images are not sent."""
    body = [c for c in df.columns if c != kind]
    value = F.when(F.col(kind) != "-D", F.to_json(F.struct(*body), {"ignoreNullFields": "false"}))
    return df.where(F.col(kind) != "-U").select(F.to_json(F.struct(*key)).alias("key"), value.alias("value"))


def kafka_sink_options(topic: str, bootstrap_servers: str, transactional: bool = False, **security) -> dict[str, str]:
    o = {"kafka.bootstrap.servers": bootstrap_servers, "topic": topic,
         **kafka_security(security.get("security_protocol"), security.get("sasl_mechanism"), security.get("username"),
                          security.get("password"))}
    return {**o, "kafka.enable.idempotence": "true"} if transactional else o


def with_partitioner(messages: DataFrame, partitioner: str, partitions: int) -> DataFrame:
    """Kafka partition per message: ``fixed`` by producing task or ``round-robin``."""
    if partitioner == "fixed":
        return messages.withColumn("partition", (F.spark_partition_id() % partitions).cast("int"))
    if partitioner == "round-robin":
        return messages.withColumn("partition", (F.monotonically_increasing_id() % partitions).cast("int"))
    raise ValueError(f"unknown partitioner {partitioner!r}")


def jdbc_writer(staging: Callable[[str], str], merge: Callable[[str], None] | None = None,
                **options) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: each batch overwrites its own staging table, then ``merge`` upserts from it.

    A repeated batch id writes the same table again, so a retry changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table = staging(str(batch_id))
        batch.write.mode("overwrite").format("jdbc").options(**options, dbtable=table).save()
        if merge:
            merge(table)
    return write


def elasticsearch_options(hosts: str, index: str, id_column: str | None = None, username: str | None = None,
                          password: str | None = None) -> dict[str, str]:
    """Options of the Elasticsearch connector (separate package); an id column makes writes upserts."""
    o = {"es.nodes": hosts, "es.resource": index, "es.net.http.auth.user": username, "es.net.http.auth.pass": password}
    if id_column:
        o.update({"es.mapping.id": id_column, "es.write.operation": "upsert"})
    return {k: v for k, v in o.items() if v}


def mongodb_options(uri: str, database: str, collection: str, id_columns: Sequence[str] = ()) -> dict[str, str]:
    """Options of the MongoDB connector (separate package)."""
    o = {"connection.uri": uri, "database": database, "collection": collection}
    return {**o, "idFieldList": ",".join(id_columns), "operationType": "replace"} if id_columns else o


def hudi_options(table: str, record_key: str, precombine: str, partition: str | None = None,
                 kind: str = "COPY_ON_WRITE", operation: str = "upsert") -> dict[str, str]:
    """Options of the Hudi writer (separate package)."""
    o = {"hoodie.table.name": table, "hoodie.datasource.write.recordkey.field": record_key,
         "hoodie.datasource.write.precombine.field": precombine, "hoodie.datasource.write.table.type": kind,
         "hoodie.datasource.write.operation": operation}
    return {**o, "hoodie.datasource.write.partitionpath.field": partition} if partition else o


def merge_statement(target: str, source: str, keys: Sequence[str]) -> str:
    """MERGE for table formats that have it (Iceberg, Delta, Hudi)."""
    on = " AND ".join(f"t.{k} <=> s.{k}" for k in keys)
    return f"MERGE INTO {target} t USING {source} s ON {on} WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"


def console(df: DataFrame, rows: int = 20):
    return df.writeStream.format("console").start() if df.isStreaming else df.show(rows, truncate=False)


def blackhole(df: DataFrame, checkpoint: str | None = None):
    """Run the plan and discard the rows."""
    if df.isStreaming:
        writer = df.writeStream.format("noop")
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    df.write.format("noop").mode("overwrite").save()


def result_output(df: DataFrame, name: str, limit: int | None = None, order: Sequence[Column] = (), path: str | None = None, writer=None):
    """Temp view of the first rows; of a stream, files below ``path`` (by default a folder of its own) and a view over those written by now.

    Call ``refresh_results`` to see what a stream has written since. Rows do not gather in the driver.
    """
    if df.isStreaming:
        spark = df.sparkSession
        path = path or session.work_dir(spark, "results")
        writer = writer or df.writeStream.outputMode("append").queryName(name).option("checkpointLocation", path + "-checkpoint")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        query = writer.format("parquet").option("path", path).start()
        query.results = lambda: refresh_results(spark, name, path, df.schema, limit, order)
        query.results()
        return query
    out = df.orderBy(*order) if order else df
    out = out.limit(limit) if limit is not None else out
    out.createOrReplaceTempView(name)
    return out


def refresh_results(spark, name: str, path: str, schema, limit: int | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """The view over the rows that a stream has committed to ``path``."""
    return result_output(spark.read.schema(schema).parquet(path), name, limit, order)


def write_table(df: DataFrame, table: str, keys: Sequence[str] = (), writer=None):
    """Rows into a table of a catalog: appended, or merged by ``keys`` where the table's format has MERGE (Iceberg, Delta, Hudi).

    On a stream every micro-batch is merged; a repeated batch changes nothing, as it merges the same rows again. Rows of a batch must differ in their keys.
    Appends are exactly once where the format has that; a table of plain files may get a batch twice after a failure.
    """
    def put(batch: DataFrame, batch_id: int | None = None) -> None:
        if not keys:
            batch.write.mode("append").saveAsTable(table)
            return
        view = "_merge_" + table.replace(".", "_")
        batch.createOrReplaceTempView(view)
        batch.sparkSession.sql(merge_statement(table, view, keys))

    if not df.isStreaming:
        return put(df)
    spark, writer = df.sparkSession, writer or df.writeStream.outputMode("append")
    # Spark's file sink would hide the rows that a table of plain files has already
    files = spark.catalog.tableExists(table) and not spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where(
        "col_name = 'Provider' AND lower(data_type) IN ('parquet', 'orc', 'csv', 'json', 'text')").isEmpty()
    return writer.foreachBatch(put).start() if keys or files else writer.toTable(table)


def export_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header; NULLs are empty."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("nullValue", None) \
        .option("emptyValue", "").csv(path)


Branch = tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], None]]


def write_branches(df: DataFrame, branches: dict[str, Branch], persist: bool = False) -> None:
    """Several (transform, write) branches from one input.

    Each branch scans its own columns of the input, which costs less than keeping all of a file table on the executors' disks.
    ``persist`` keeps the input instead, where it is small and dear to compute.
    """
    if persist:
        df.persist(StorageLevel.DISK_ONLY)
    try:
        for transform, write in branches.values():
            write(transform(df))
    finally:
        if persist:
            df.unpersist()


def stream_branches(df: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]],
                    write: Callable[[DataFrame, str, int], None], checkpoint: str, name: str | None = None,
                    available_now: bool = False) -> StreamingQuery:
    """All branches from every micro-batch in one query; ``write(rows, branch, batch id)`` must be idempotent."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.DISK_ONLY)
        try:
            for branch, transform in branches.items():
                write(transform(batch), branch, batch_id)
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def files_by_batch(path: str, fmt: str = "parquet") -> Callable[[DataFrame, str, int], None]:
    """Writer for ``stream_branches``: a batch owns its folder, so a repeated batch replaces itself."""
    def write(rows: DataFrame, branch: str, batch_id: int) -> None:
        rows.write.mode("overwrite").format(fmt).save(f"{path}/{branch}/batch_id={batch_id}")
    return write
