"""Key-value store of features as a Spark data source, for tables and streams: the newest row of each key, with a time to live.

``spark.dataSource.register(FeatureStore)``, then ``format("feature_kv")``. Rows are dealt over buckets by their key; a task writes one file for each
bucket it meets, and a commit is one small file that names them. Files that no commit names do not exist for readers, so a task that
is run again, or a batch that is written again after a restart, leaves nothing behind. A reader's partition is a bucket.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader,
                                    InputPartition, WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.durations import micros


@dataclass
class Written(WriterCommitMessage):
    files: list


@dataclass
class Bucket(InputPartition):
    files: list


class Folder:
    """A folder of any file system that Arrow knows (a path or a URI), shared by the driver and the executors."""

    def __init__(self, path: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(path)

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.File and not f.base_name.endswith(".tmp"))

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        """All of the file or none of it."""
        at = f"{self.path}/{name}"
        made = f"{at}.{uuid4().hex}.tmp"
        self.fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(made) as f:
            f.write(data)
        self.fs.move(made, at)

    def drop(self, files: list[str]) -> None:
        for name in files:
            self.fs.delete_file(f"{self.path}/{name}")


class Settings:
    def __init__(self, options: dict):
        known = {k.lower(): v for k, v in options.items()}
        self.path, self.ts = known.get("path"), known.get("ts")
        self.keys = [k.strip() for k in known.get("keys", "").split(",") if k.strip()]
        if not (self.path and self.ts and self.keys):
            raise ValueError("feature_kv needs the options path, keys and ts")
        self.ttl = micros(known["ttl"]) if known.get("ttl") else None
        self.as_of = None
        if known.get("asof"):
            at = datetime.fromisoformat(known["asof"])
            self.as_of = (at.replace(tzinfo=at.tzinfo or timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        self.buckets, self.writer = int(known.get("buckets", 16)), known.get("writer", "stream")


class Store:
    """Writes a task's rows; common to tables and streams."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Written:
        s, folder, open_files = self.settings, Folder(self.settings.path), {}
        for batch in batches:
            keys = [batch.column(k).cast(pa.string()).to_pylist() for k in s.keys]
            bucket = np.array([crc32(repr(key).encode()) % s.buckets for key in zip(*keys)], np.int64)
            for b in sorted(set(bucket.tolist())):
                if b not in open_files:
                    name = f"data/{b:05d}/{uuid4().hex}.parquet"
                    folder.fs.create_dir(f"{folder.path}/data/{b:05d}", recursive=True)
                    open_files[b] = name, pyarrow.parquet.ParquetWriter(f"{folder.path}/{name}", batch.schema, filesystem=folder.fs)
                open_files[b][1].write_batch(batch.filter(pa.array(bucket == b)))
        for _, writer in open_files.values():
            writer.close()
        return Written([name for name, _ in open_files.values()])

    def commit_as(self, name: str, messages: list, overwrite: bool = False) -> None:
        """Name the files in the next commit, unless there is one of this name: then it was written before, and the first time counts."""
        folder, files = Folder(self.settings.path), [f for m in messages if m for f in m.files]
        done = folder.names("_commits")
        if any(n.split("-", 1)[1] == f"{name}.json" for n in done):
            folder.drop(files)
            return
        last = max([int(n.split("-")[0]) for n in done], default=-1)
        folder.write(f"_commits/{last + 1:012d}-{name}.json", json.dumps(files).encode())
        if overwrite:
            folder.drop([f"_commits/{n}" for n in done])

    def abandon(self, messages: list) -> None:
        Folder(self.settings.path).drop([f for m in messages if m for f in m.files])


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, settings: Settings, overwrite: bool):
        self.store, self.overwrite = Store(settings), overwrite

    def write(self, iterator):
        return self.store.rows(iterator)

    def commit(self, messages):
        self.store.commit_as(f"table-{uuid4().hex}", messages, self.overwrite)

    def abort(self, messages):
        self.store.abandon(messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, settings: Settings):
        self.store = Store(settings)

    def write(self, iterator):
        return self.store.rows(iterator)

    def commit(self, messages, batchId):
        self.store.commit_as(f"{self.store.settings.writer}-{batchId}", messages)

    def abort(self, messages, batchId):
        self.store.abandon(messages)


class NewestRows(DataSourceReader):
    """One row for each key: the newest at ``asOf`` that is not older than ``ttl`` by then; of equal times the one committed last."""

    def __init__(self, settings: Settings, names: list[str], schema: pa.Schema):
        self.settings, self.names, self.schema = settings, names, schema

    def partitions(self):
        folder, by_bucket = Folder(self.settings.path), {}
        for name in folder.names("_commits"):
            for f in json.loads(folder.read(f"_commits/{name}")):
                by_bucket.setdefault(f.split("/")[1], []).append(f)
        return [Bucket(files) for _, files in sorted(by_bucket.items())] or [Bucket([])]

    def read(self, partition):
        s, folder, newest = self.settings, Folder(self.settings.path), None
        for name in partition.files:  # a bucket's rows are merged file by file, so only its newest rows are held
            rows = pyarrow.parquet.read_table(f"{folder.path}/{name}", filesystem=folder.fs)
            at = rows[s.ts].cast(pa.timestamp("us", rows.schema.field(s.ts).type.tz)).cast(pa.int64())
            rows = rows.append_column("_at", at)
            rows = rows.filter(pc.fill_null(pc.less_equal(at, pa.scalar(s.as_of, pa.int64())) if s.as_of is not None else pc.is_valid(at), False))
            both = rows if newest is None else pa.concat_tables([newest, rows])
            order = pa.array(np.argsort(both["_at"].to_numpy(), kind="stable"))
            both = both.take(order)
            last = both.append_column("_n", pa.array(np.arange(both.num_rows))).group_by(s.keys).aggregate([("_n", "max")])["_n_max"]
            newest = both.take(last.combine_chunks().sort())
        if newest is None or not newest.num_rows:
            return
        if s.ttl is not None:
            now = s.as_of if s.as_of is not None else time.time_ns() // 1000
            newest = newest.filter(pc.greater_equal(newest["_at"], pa.scalar(now - s.ttl, pa.int64())))
        yield from newest.select(self.names).cast(self.schema).to_batches()


class Commits(DataSourceStreamReader):
    """Rows as they were committed; an offset is the name of the last commit read, a partition the files of a bucket."""

    def __init__(self, settings: Settings, names: list[str], schema: pa.Schema):
        self.settings, self.names, self.schema = settings, names, schema

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        return {"after": max(Folder(self.settings.path).names("_commits"), default="")}

    def partitions(self, start, end):
        folder, by_bucket = Folder(self.settings.path), {}
        for name in folder.names("_commits"):
            if start["after"] < name <= end["after"]:
                for f in json.loads(folder.read(f"_commits/{name}")):
                    by_bucket.setdefault(f.split("/")[1], []).append(f)
        return [Bucket(files) for _, files in sorted(by_bucket.items())]

    def read(self, partition):
        folder = Folder(self.settings.path)
        for name in partition.files:
            yield from pyarrow.parquet.read_table(f"{folder.path}/{name}", filesystem=folder.fs, columns=self.names).cast(self.schema).to_batches()


class FeatureStore(DataSource):
    """Options: ``path``, ``keys`` (names, by commas), ``ts`` (time of a row), ``ttl`` (a duration), ``asOf`` (an ISO time, UTC unless it says; rows after it do not count; by default all do, and the time to live ends now), ``buckets``
    (16; must stay the same for a path), ``writer`` (name of a stream; batches of different streams do not replace each other).

    One writer commits at a time. A table reads the newest rows, a stream all rows commit by commit. Rows with a null time are never newest.
    """

    @classmethod
    def name(cls):
        return "feature_kv"

    def schema(self):
        raise ValueError("give the rows' schema: spark.read.format('feature_kv').schema(...)")

    def writer(self, schema, overwrite):
        return BatchWriter(Settings(self.options), overwrite)

    def streamWriter(self, schema, overwrite):
        return StreamWriter(Settings(self.options))

    def reader(self, schema):
        return NewestRows(Settings(self.options), schema.names, to_arrow_schema(schema))

    def streamReader(self, schema):
        return Commits(Settings(self.options), schema.names, to_arrow_schema(schema))
