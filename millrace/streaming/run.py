"""Drive a stream over what is there now and hand back its output as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace import session

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def file_stream(spark: SparkSession, folder: str, name_glob: str, schema, files_per_trigger: int | None = None,
                fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", name_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def drain(df: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available input exactly once into files and read them back.

    Only rows that the watermark has finalised come out. Starting again with the same folders resumes.
    """
    spark = df.sparkSession
    path = path or session.work_dir(spark, "stream")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (df.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", checkpoint or path + "-checkpoint").start(path))
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(df.schema).parquet(path)
