"""A Python data source of tables that grow by commits: ``loom_commits``.

A table is a folder that all machines mount. Tasks write Parquet parts of at most ``part_rows`` rows under names of their own; the driver then lists the parts of the
tasks that succeeded in one numbered commit file, created only if no other has that number. What no commit lists doesn't exist: parts of failed,
repeated or speculative tasks are never read. A batch read takes all commits up to the latest that replaced the table's content (mode ``overwrite``),
with one partition a part. A stream's offset is the number of commits, so it reads each commit once; a stream that writes commits each of its batches once,
whatever is repeated after a failure.

Options: ``path``; ``part_rows`` (default 100,000); ``commits_per_trigger`` of a stream read (default all); ``stream`` of a stream write, the name by which
its batches are told from those of other streams (default ``stream``). Reads need the schema: ``spark.read.format("loom_commits").schema(...)``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

NAME, FOLDER = "loom_commits", "_commits"


@dataclass
class Part(InputPartition):
    file: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Table:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("option path is missing")
        self.path = options["path"].removeprefix("file://")

    def commits(self) -> int:
        """The number of commits; they are numbered from 0 without gaps."""
        folder = f"{self.path}/{FOLDER}"
        return sum(n.endswith(".json") for n in os.listdir(folder)) if os.path.isdir(folder) else 0

    def read(self, n: int) -> dict:
        with open(f"{self.path}/{FOLDER}/{n:020d}.json") as f:
            return json.load(f)

    def parts(self, since: int, until: int) -> list[Part]:
        """Parts of the commits from ``since`` on, before ``until``."""
        return [Part(f) for n in range(since, until) for f in self.read(n)["files"]]

    def append(self, entry: dict) -> None:
        os.makedirs(f"{self.path}/{FOLDER}", exist_ok=True)
        draft = f"{self.path}/{FOLDER}/.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump(entry, f)
        while True:
            try:  # a link can't replace a file: of two drivers that commit at once one gets the next number
                os.link(draft, f"{self.path}/{FOLDER}/{self.commits():020d}.json")
                break
            except FileExistsError:
                continue
        os.unlink(draft)


class _Reads:
    def __init__(self, options: dict, schema: StructType):
        self.table, self.names = _Table(options), schema.names

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with pq.ParquetFile(f"{self.table.path}/{part.file}") as f:
            for batch in f.iter_batches(batch_size=10_000, columns=self.names):
                yield batch.select(self.names)


class BatchReader(_Reads, DataSourceReader):
    def partitions(self) -> list[Part]:
        n = self.table.commits()
        first = max((k for k in range(n) if self.table.read(k)["replaces"]), default=0)
        return self.table.parts(first, n)


class StreamReader(_Reads, DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.step, self.at = int(options.get("commits_per_trigger", 0)), None

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        n = self.table.commits()
        if self.step:
            self.at = min(n, (self.at or 0) + self.step)
            return {"commits": self.at}
        return {"commits": n}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = max(self.at or 0, end["commits"])
        return self.table.parts(start["commits"], end["commits"])

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["commits"])


class _Writes:
    def __init__(self, options: dict, overwrite: bool):
        self.table, self.overwrite = _Table(options), overwrite
        self.most, self.stream = int(options.get("part_rows", 100_000)), options.get("stream", "stream")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.table.path, exist_ok=True)
        files, out, rows = [], None, 0
        try:
            for b in batches:
                for at in range(0, b.num_rows, self.most):
                    piece = b.slice(at, self.most)
                    if out is not None and rows + piece.num_rows > self.most:
                        out.close()
                        out = None
                    if out is None:
                        files.append(f"part-{uuid.uuid4().hex}.parquet")
                        out, rows = pq.ParquetWriter(f"{self.table.path}/{files[-1]}", b.schema), 0
                    out.write_batch(piece)
                    rows += piece.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def _drop(self, messages: list) -> None:
        for m in messages:
            for f in m.files if m else []:
                if os.path.exists(f"{self.table.path}/{f}"):
                    os.unlink(f"{self.table.path}/{f}")

    def _entry(self, messages: list, **more: object) -> dict:
        return {"files": [f for m in messages if m for f in m.files], "replaces": self.overwrite} | more


class BatchWriter(_Writes, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self.table.append(self._entry(messages))

    def abort(self, messages: list) -> None:
        self._drop(messages)


class StreamWriter(_Writes, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        done = any((e := self.table.read(n)).get("stream") == self.stream and e.get("batch") == batchId for n in range(self.table.commits()))
        if done:
            self._drop(messages)
        else:
            self.table.append(self._entry(messages, stream=self.stream, batch=batchId))

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class Commits(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options, schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options, False)


def register(spark: SparkSession) -> None:
    """Makes ``loom_commits`` known to the session."""
    spark.dataSource.register(Commits)
