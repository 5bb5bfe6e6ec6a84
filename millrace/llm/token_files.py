"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on document ids, stripes read in parallel."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from millrace.llm.common import map_documents
from millrace.llm.tokens import WordEncoder, tokenizer_path


def ordered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ranged over partitions and sorted by id, then text; rows equal in both may stand in any order.

    A last key, a hash of the row's place in the input, lets a range border fall inside one id that many rows share.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"_text": F.xxhash64("text"), "_spread": F.xxhash64(F.monotonically_increasing_id())})
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_text"), F.col("_spread")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, tokenizer: str | None = None,
          row_index: int = 1000, stripe_bytes: int = 64 << 20) -> None:
    """Tokenise and write one ORC file for each range of ids, in ascending order of ids (null ids first).

    Columns: ``doc_id``, ``block`` (number of the range, ascending), ``start_in_block`` (ids of earlier documents of the block),
    ``n_tokens``, ``ids``. Every document ends with ``end_id``; null text is empty text. Bloom filters and the min/max of each
    stripe and row group are on ``doc_id``, so a search for documents reads few stripes.
    """
    file = tokenizer or tokenizer_path()
    rows = ordered(docs, doc_id, text)

    def make():
        from pyspark import TaskContext
        encoder, block, end = WordEncoder.shared(file), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        written = [0]

        def work(texts):
            ids = [b + end for b in encoder.encode(texts)]
            sizes = np.array([len(b) // 4 for b in ids], np.int64)
            ends = np.cumsum(sizes)
            starts = written[0] + ends - sizes
            written[0] += int(sizes.sum())
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            return [pa.array(np.full(len(ids), block, np.int64)), pa.array(starts), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)]

        return work

    out = map_documents(rows, "text", ["doc_id"], make, "block bigint, start_in_block bigint, n_tokens bigint, ids array<int>")
    (out.select("doc.doc_id", "block", "start_in_block", "n_tokens", "ids").write
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index)).option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd")
        .orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` from files of ``write``.

    Only the small columns of the blocks are summed; the sums (one row per file) are broadcast. Files written from an empty
    table give no rows.
    """
    files = spark.read.schema("doc_id bigint, block bigint, start_in_block bigint, n_tokens bigint, ids array<int>").orc(path)
    totals = files.groupBy(F.col("block").alias("_block")).agg(F.max(F.col("start_in_block") + F.col("n_tokens")).alias("_ids"))
    before = totals.select("_block", (F.sum("_ids").over(Window.orderBy("_block")) - F.col("_ids")).alias("_before"))
    return (files.join(F.broadcast(before), F.col("block") == F.col("_block"))
            .select("doc_id", (F.col("_before") + F.col("start_in_block")).alias("start"), "n_tokens", "ids"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the filter is pushed to ORC, where min/max and Bloom filters skip stripes and row groups."""
    return read(spark, path).where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def ids_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``n_tokens`` counted from them and the crc32 of their little-endian 32-bit form."""
    names = ["doc_id", "start"]
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy().astype(np.int64) * 4
            raw = memoryview(ids.values.to_numpy().astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at) // 4),
                                              pa.array(crcs, pa.int64())], names=schema.names)

    return rows.select(*names, "ids").mapInArrow(run, schema)
