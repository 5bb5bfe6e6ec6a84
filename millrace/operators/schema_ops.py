"""Schemas: type names, Avro records, diffs, compatibility and validation over many subjects."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

# Avro primitive to SQL type, and the type changes readers survive.
AVRO_TYPES = {"string": "STRING", "int": "INT", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE",
              "boolean": "BOOLEAN", "bytes": "BINARY", "null": "STRING"}
WIDENING = (("int", "long"), ("float", "double"), ("null", "string"))
SQL_TYPES = {"STRING": "string", "INT": "int", "BIGINT": "long", "FLOAT": "float", "DOUBLE": "double",
             "BOOLEAN": "boolean", "BYTES": "bytes"}


def spark_type(name: str) -> str:
    """Spark DDL type of a declared column type, e.g. ``TIMESTAMP(3)`` or ``ROW<a INT, b STRING>``."""
    text = re.sub(r"\s+NOT\s+NULL$", "", name.strip(), flags=re.I)
    upper = text.upper()
    nested = re.fullmatch(r"(ARRAY|MULTISET|MAP|ROW)\s*<(.*)>", text, flags=re.I | re.S)
    if nested:
        kind, parts = nested.group(1).upper(), _split_top(nested.group(2))
        if kind == "ARRAY":
            return f"ARRAY<{spark_type(parts[0])}>"
        if kind == "MULTISET":  # element to number of occurrences
            return f"MAP<{spark_type(parts[0])}, INT>"
        if kind == "MAP":
            return f"MAP<{spark_type(parts[0])}, {spark_type(parts[1])}>"
        fields = [p.strip().split(None, 1) for p in parts]
        return "STRUCT<" + ", ".join(f"{n.strip('`')}: {spark_type(t)}" for n, t in fields) + ">"
    base = upper.split("(")[0].strip()
    if base == "TIMESTAMP_LTZ":
        return "TIMESTAMP"
    if base in ("TIMESTAMP", "DATETIME"):
        return "TIMESTAMP_NTZ"
    if base == "TIME":  # Spark has no time-of-day type switched on; kept as HH:mm:ss
        return "STRING"
    if base in ("BYTES", "VARBINARY", "BINARY"):
        return "BINARY"
    if base in ("VARCHAR", "CHAR"):
        return text.upper() if "(" in text and "2147483647" not in text else "STRING"
    if base in ("DECIMAL", "NUMERIC", "DEC"):
        return upper.replace("NUMERIC", "DECIMAL") if base != "DEC" else upper.replace("DEC", "DECIMAL")
    if base in ("TINYINT", "SMALLINT", "INT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE", "STRING", "BOOLEAN", "DATE"):
        return base
    raise ValueError(f"unknown type {name!r}")


def _split_top(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]]]


def parse_columns(lines: str) -> T.StructType:
    """Schema from text with one ``name TYPE`` per line; trailing commas are allowed."""
    fields = []
    for line in lines.splitlines():
        line = line.strip().rstrip(",")
        if line:
            name, kind = line.split(None, 1)
            fields.append(f"`{name.strip('`')}` {spark_type(kind)}")
    return T.StructType.fromDDL(", ".join(fields))


@dataclass
class EventTime:
    """A time column, the column it is computed from (epoch milliseconds) and the allowed delay."""
    column: str
    source: str | None
    delay: str = "5 seconds"

    def apply(self, df: DataFrame) -> DataFrame:
        if self.source:
            df = df.withColumn(self.column, F.timestamp_millis(self.source))
        return df.withWatermark(self.column, self.delay)


def avro_fields(schema: str) -> list[tuple[str, str, bool]]:
    """(name, type, has default) per field; a nullable union is its other types joined by ``|``."""
    fields = json.loads(schema or "{}").get("fields", [])
    out = []
    for f in fields:
        kind = f["type"]
        if isinstance(kind, list):
            kind = "|".join(str(k) for k in kind if k != "null")
        out.append((f["name"], str(kind), "default" in f))
    return out


def avro_schema(schema: str) -> tuple[T.StructType, EventTime | None]:
    """Spark schema of an Avro record, and event time if a long column looks like a time stamp."""
    fields = avro_fields(schema)
    ddl = ", ".join(f"`{n}` {AVRO_TYPES.get(t.lower(), 'STRING')}" for n, t, _ in fields)
    time = next((n for n, t, _ in fields if re.search("time|ts|timestamp|created|updated", n, re.I)
                 and re.search("long|string", t, re.I)), None)
    is_long = time is not None and dict((n, t) for n, t, _ in fields)[time] == "long"
    return T.StructType.fromDDL(ddl), EventTime(time + "_ts", time) if is_long else None


FIELD_ARRAY = "STRUCT<type: STRING, fields: ARRAY<STRUCT<name: STRING, type: STRING, default: STRING>>>"


def field_table(schemas: DataFrame, subject: str, schema: str) -> DataFrame:
    """One row per field of many Avro schemas held as JSON text: subject, name, type, has_default."""
    parsed = schemas.select(subject, F.from_json(schema, FIELD_ARRAY).alias("s"),
                            F.from_json(schema, "STRUCT<fields: ARRAY<STRING>>").alias("raw"))
    each = parsed.select(subject, F.explode(F.arrays_zip("s.fields", F.col("raw.fields").alias("text"))).alias("f"))
    # a union arrives as JSON text: drop its brackets, quotes and the null branch
    kind = F.array_join(F.filter(F.split(F.regexp_replace("f.fields.type", r'[\[\]"\s]', ""), ","),
                                 lambda t: t != "null"), "|")
    # "default": null is a default too, so the key is looked for in the field's own text
    return each.select(subject, F.col("f.fields.name").alias("name"),
                       F.when(F.col("f.fields.type") == "null", "null").otherwise(kind).alias("type"),
                       F.array_contains(F.json_object_keys("f.text"), "default").alias("has_default"))


def schema_diff(old: DataFrame, new: DataFrame, subject: str) -> DataFrame:
    """Differences of two field tables, for all subjects at once: change (added, removed, changed), breaking."""
    a = old.select(subject, "name", F.col("type").alias("old_type"), F.col("has_default").alias("_d1"))
    b = new.select(subject, "name", F.col("type").alias("new_type"), F.col("has_default").alias("_d2"))
    both = a.join(b, [subject, "name"], "full_outer")
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
              .when(F.col("old_type") != F.col("new_type"), "changed"))
    widened = F.lit(False)
    for x, y in WIDENING:
        widened = widened | ((F.col("old_type") == x) & (F.col("new_type") == y))
    breaking = (F.when(F.col("change") == "changed", ~widened)
                .otherwise(~F.coalesce("_d1", "_d2")))
    return (both.withColumn("change", change).where(F.col("change").isNotNull())
            .select(subject, "name", "change", "old_type", "new_type", breaking.alias("breaking")))


def compatible(diff: DataFrame, subject: str) -> DataFrame:
    """Per subject with differences: number of breaking ones and whether it stays compatible."""
    return diff.groupBy(subject).agg(F.count_if("breaking").alias("breaking_changes")).withColumn(
        "compatible", F.col("breaking_changes") == 0)


def schema_validate(columns: DataFrame, registry: DataFrame, subject: str) -> DataFrame:
    """Issues between declared columns (``name, type``) and registry fields: level and kind.

    err = type mismatch, warn = column unknown to the registry or field without default not declared,
    info = field with a default not declared.
    """
    names = F.create_map(*[x for k, v in SQL_TYPES.items() for x in (F.lit(k), F.lit(v))])
    c = columns.select(subject, F.lower("name").alias("_n"), F.col("name").alias("column"), F.col("type").alias("declared"))
    r = registry.select(subject, F.lower("name").alias("_n"), F.col("name").alias("field"),
                        F.col("type").alias("registered"), "has_default")
    m = c.join(r, [subject, "_n"], "full_outer").withColumn("_sql", names[F.upper("declared")])
    kind = (F.when(F.col("field").isNull(), "unknown column")
            .when(F.col("column").isNull(), "missing column")
            .when(F.col("_sql").isNotNull() & (F.col("_sql") != F.lower("registered")), "type mismatch"))
    level = (F.when(kind == "type mismatch", "err")
             .when((kind == "missing column") & F.col("has_default"), "info").otherwise("warn"))
    return (m.withColumns({"issue": kind, "level": level}).where(F.col("issue").isNotNull())
            .select(subject, F.coalesce("column", "field").alias("name"), "issue", "level", "declared", "registered"))
