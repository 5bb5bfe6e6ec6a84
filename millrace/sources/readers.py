"""Sources: generated rows, files, Kafka, JDBC, catalogs, inline rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.operators.schema_ops import parse_columns

FORMATS = ("parquet", "orc", "json", "csv", "avro")
#: Generated integers are below this.
_RANGE = 2 ** 60


def mixed(id_column: Column, seed: int) -> Column:
    """Integer in [0, 2**60) from the MD5 of id and seed only, so that reruns agree and no period is met."""
    digest = F.md5(F.concat_ws(":", id_column.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def generated_field(id_column: Column, spec: dict, seed: int) -> Column:
    """One field: ``kind`` random (default) or sequence; ``min``/``max``, ``length``, ``start``/``end``; ``type``."""
    kind, name = spec.get("type", "BIGINT").upper(), spec.get("kind", "random")
    if name == "sequence":
        start = int(spec.get("start", 0))
        out = id_column + start
        if "end" in spec:
            out = F.when(out <= int(spec["end"]), out)
        return out if kind == "BIGINT" else out.cast(kind)
    if name != "random":
        raise ValueError(f"unknown generator kind {name!r}")
    r = mixed(id_column, seed)
    if kind in ("STRING", "VARCHAR"):
        length = int(spec.get("length", 100))
        parts = [F.lpad(F.hex(mixed(id_column, seed + 1000 * i)), 15, "0") for i in range(-(-length // 15))]
        return F.lower(F.left(F.concat(*parts), F.lit(length)))
    if kind == "BOOLEAN":
        return r % 2 == 0
    if kind in ("DOUBLE", "FLOAT") or kind.startswith("DECIMAL"):
        low, high = float(spec.get("min", 0)), float(spec.get("max", 1))
        return (F.lit(low) + r / F.lit(float(_RANGE - 1)) * F.lit(high - low)).cast(kind)
    low, high = int(spec.get("min", 0)), int(spec.get("max", 2 ** 31 - 1))
    if not 0 < high - low + 1 <= _RANGE:
        raise ValueError(f"an integer range holds 1 to 2**60 values: {low} to {high}")
    return (F.lit(low).cast("long") + r % F.lit(high - low + 1)).cast(kind)


def with_generated(df: DataFrame, id_column: str, fields: dict[str, dict], seed: int = 1) -> DataFrame:
    """Generated fields for the ids of any table or stream."""
    return df.select(*df.columns, *[generated_field(F.col(id_column), spec, seed + 31 * i).alias(name)
                                    for i, (name, spec) in enumerate(fields.items())])


def datagen(spark: SparkSession, fields: dict[str, dict], number_of_rows: int | None = None,
            rows_per_second: int | None = None, seed: int = 1, time_column: str | None = None) -> DataFrame:
    """Bounded with ``number_of_rows``, else a stream of ``rows_per_second`` rows (with the arrival time)."""
    if number_of_rows is not None:
        base = spark.range(number_of_rows)
    else:
        base = (spark.readStream.format("rate").option("rowsPerSecond", rows_per_second or 10).load()
                .select(F.col("value").alias("id"), F.col("timestamp").alias("_at")))
    out = with_generated(base, "id", fields, seed).drop("id")
    if "_at" in out.columns:
        out = out.withColumnRenamed("_at", time_column) if time_column else out.drop("_at")
    return out


def filesystem(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | T.StructType | None = None,
               streaming: bool = False, **options) -> DataFrame:
    """Files as a table or stream. Avro needs the spark-avro package on the class path."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(parse_columns(schema) if isinstance(schema, str) else schema)
    elif streaming or fmt in ("json", "csv"):
        raise ValueError(f"declare the schema of {'a stream' if streaming else fmt}")
    return reader.load(path)


def kafka_options(topic: str, bootstrap_servers: str, group_id: str | None = None, startup: str = "latest-offset",
                  timestamp_ms: int | None = None, security_protocol: str | None = None,
                  sasl_mechanism: str | None = None, username: str | None = None, password: str | None = None,
                  max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    """Reader options. ``group-offsets`` is the checkpoint's business in Spark, so it starts at the latest."""
    o = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic}
    if startup in ("latest-offset", "group-offsets"):
        o["startingOffsets"] = "latest"
    elif startup == "earliest-offset":
        o["startingOffsets"] = "earliest"
    elif startup == "timestamp":
        if timestamp_ms is None:
            raise ValueError("start by timestamp needs timestamp_ms")
        o["startingTimestamp"] = str(timestamp_ms)
    else:
        raise ValueError(f"unknown startup mode {startup!r}")
    if group_id:
        o["kafka.group.id"] = group_id
    if max_offsets_per_trigger:
        o["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return {**o, **kafka_security(security_protocol, sasl_mechanism, username, password)}


def kafka_security(protocol: str | None, mechanism: str | None, username: str | None,
                   password: str | None) -> dict[str, str]:
    o = {}
    if protocol:
        o["kafka.security.protocol"] = protocol
    if mechanism:
        o["kafka.sasl.mechanism"] = mechanism
    if username and password:
        module = "scram.ScramLoginModule" if (mechanism or "").startswith("SCRAM") else "plain.PlainLoginModule"
        o["kafka.sasl.jaas.config"] = (f"org.apache.kafka.common.security.{module} required "
                                       f'username="{username}" password="{password}";')
    return o


def kafka(spark: SparkSession, schema: str | T.StructType, fmt: str = "json", **settings) -> DataFrame:
    """Decoded Kafka stream; needs the spark-sql-kafka package on the class path."""
    raw = spark.readStream.format("kafka").options(**kafka_options(**settings)).load()
    return decode_messages(raw, schema, fmt)


def decode_messages(raw: DataFrame, schema: str | T.StructType, fmt: str = "json", ignore_errors: bool = True,
                    avro_json: str | None = None) -> DataFrame:
    """(key, value) messages to columns. Broken JSON or CSV rows are dropped, or fail the query."""
    s = parse_columns(schema) if isinstance(schema, str) else schema
    text = F.col("value").cast("string")
    mode = {"mode": "PERMISSIVE" if ignore_errors else "FAILFAST"}
    if fmt == "raw":
        return raw.select(F.col("value").cast(s.fields[0].dataType).alias(s.fields[0].name))
    if fmt == "avro":
        from pyspark.sql.avro.functions import from_avro
        return raw.select(from_avro("value", avro_json).alias("v")).select("v.*")
    if fmt not in ("json", "csv"):
        raise ValueError(f"cannot decode {fmt!r}")
    bad = "_corrupt_record"
    marked = T.StructType([*s.fields, T.StructField(bad, T.StringType())])
    if fmt == "json":
        v = F.from_json(text, marked, {**mode, "columnNameOfCorruptRecord": bad})
    else:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.fields)
        v = F.from_csv(text, ddl, {**mode, "columnNameOfCorruptRecord": bad})
    return (raw.select(v.alias("v")).where(F.col("v").isNotNull() & F.col(f"v.{bad}").isNull())
            .select(*[F.col(f"v.{f.name}").alias(f.name) for f in s.fields]))


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 driver: str | None = None, fetch_size: int | None = None, partition_column: str | None = None,
                 lower: object = None, upper: object = None, partitions: int | None = None) -> dict[str, str]:
    """A partition column splits the read over executors; without one a single task reads all rows."""
    o = {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver, "fetchsize": fetch_size}
    split = {"partitionColumn": partition_column, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions}
    if partition_column:
        if None in split.values():
            raise ValueError("a partitioned read needs lower, upper and partitions")
        o.update(split)
    return {k: str(v) for k, v in o.items() if v is not None}


def jdbc(spark: SparkSession, **settings) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**settings)).load()


def pulsar_options(service_url: str, topic: str, start: str = "latest") -> dict[str, str]:
    """Options of the Pulsar connector (separate package)."""
    return {"service.url": service_url, "topic": topic, "startingOffsets": start}


def kinesis_options(stream: str, region: str, start: str = "LATEST") -> dict[str, str]:
    """Options of the Kinesis connector (separate package)."""
    return {"kinesis.streamName": stream, "kinesis.region": region, "kinesis.startingPosition": start}


def catalog_options(name: str, kind: str, **settings) -> dict[str, str]:
    """Session settings that register a catalog: jdbc, iceberg-hive, iceberg-rest, iceberg-glue, hive, delta."""
    p = f"spark.sql.catalog.{name}"
    if kind == "jdbc":
        return {p: "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog",
                **{f"{p}.{k}": str(v) for k, v in settings.items()}}
    if kind.startswith("iceberg-"):
        o = {p: "org.apache.iceberg.spark.SparkCatalog", **{f"{p}.{k}": str(v) for k, v in settings.items()}}
        if kind == "iceberg-glue":
            return {**o, f"{p}.catalog-impl": "org.apache.iceberg.aws.glue.GlueCatalog"}
        return {**o, f"{p}.type": kind.split("-", 1)[1]}
    if kind == "hive":
        return {"spark.sql.catalogImplementation": "hive", "spark.hadoop.hive.metastore.uris": settings["uris"]}
    if kind == "delta":
        return {"spark.sql.extensions": "io.delta.sql.DeltaSparkSessionExtension",
                "spark.sql.catalog.spark_catalog": "org.apache.spark.sql.delta.catalog.DeltaCatalog"}
    raise ValueError(f"unknown catalog kind {kind!r}")


def catalog_table(spark: SparkSession, name: str, catalog: str | None = None, database: str | None = None) -> DataFrame:
    if catalog:
        spark.catalog.setCurrentCatalog(catalog)
    if database:
        spark.catalog.setCurrentDatabase(database)
    return spark.table(name)


def values(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """Inline rows with a DDL schema; literals in the plan, so nothing is shipped through Python."""
    fields = T.StructType.fromDDL(columns).fields
    literals = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*literals)))
