"""Helpers of the operators: documents through Arrow tasks, folds, shared folders."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace import session

#: Words of letters and digits in text whose A-Z were lowered; bytes of UTF-8 above 0x7F all belong to words.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOLDS = 5
#: Rows that a worker gets at once, so that a batch of many texts is not unpacked whole.
ROWS = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.table(spark, sf_dir, "documents")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text (fold 0, held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """At most ``sample`` rows of ``docs`` outside fold 0 with their label, chosen by a hash of the id.

    The label table has few columns, so choosing happens there; what is broadcast is at most ``sample`` pairs. An id
    with several labels counts with the greatest; null ids and labels are left out.
    """
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
              .groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    return docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("_id")).drop("_id")


def map_documents(docs: DataFrame, text: str, carry: Sequence[str], make: Callable[[], Callable], fields: str,
                  inputs: Sequence[Column] = ()) -> DataFrame:
    """Run ``make()`` once per task and its result on each batch; returns column ``doc`` and ``fields``.

    The worker gets the texts as a list of bytes (null: empty) and an Arrow array for each of ``inputs``, and returns one
    Arrow array for each of ``fields`` (DDL). ``doc`` is a struct of the carried columns, so that no name can clash.
    Spark bounds a batch by rows and bytes; nothing is shuffled.
    """
    inside = text in carry
    columns = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")]
    columns += [] if inside else [F.col(f"`{text}`").cast("string").alias("text")]
    columns += [c.alias(f"in{i}") for i, c in enumerate(inputs)]
    packed = docs.select(*columns)
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([packed.schema["doc"], *added.fields])
    first = 1 if inside else 2

    def run(batches):
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                doc = batch.column(0)
                texts = doc.field(text) if inside else batch.column(1)
                texts = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
                arrays = work(texts, *batch.columns[first:])
                yield pa.RecordBatch.from_arrays([doc, *arrays], names=schema.names)

    return packed.mapInArrow(run, schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write and read back: a cut of the lineage in the folder that the cluster shares."""
    spark = df.sparkSession
    path = session.work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean() -> None:
    """At the start of a task: give back what tasks of other operators left in this worker, words kept by encoders and memory that they freed."""
    import ctypes
    import sys
    for encoder in getattr(sys.modules.get("tokenizers"), "_encoders_by_path", {}).values():
        encoder.words.clear()
        encoder.kept = 0
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def send(spark: SparkSession, value) -> Broadcast:
    """Broadcast objects of this package; they travel by value, so executors need no copy of it. See ``received``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    return pickle.loads(sent.value)



def skewless_join(rows: DataFrame, keys: DataFrame, on: Sequence[str], n: str, most: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, one row for each key, whose column ``n`` says how many of ``rows`` it meets.

    Keys that meet more than 1 / ``most`` of all are at most ``most`` and are broadcast, so their rows stay where they are; the
    others are joined by a shuffle, in which none is large.
    """
    total = keys.agg(F.sum(n)).first()[0] or 0
    limit = max(total // most, 1000)
    busy = F.broadcast(keys.where(F.col(n) > limit).drop(n))
    rest = rows.join(busy.select(*on), list(on), "left_anti").join(keys.where(F.col(n) <= limit).drop(n), list(on))
    return rest.unionByName(rows.join(busy, list(on)))
