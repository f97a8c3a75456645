"""``tokenbin``: headerless unsigned 16-bit token shards as a Spark data source.

Rows are sequences ``shard, seq_id, tokens``; one partition a shard, sequences read through a memory map (ranges of
bytes where there are no local files).  A range of sequences is an option, so only its bytes are read; filters are
Spark's own.  Writing appends a shard for each task, numbered after those that are there; ``overwrite`` replaces them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class TokenBin(DataSource):
    """Options: ``path`` (a folder of ``.bin`` files), ``seq_len`` (2048), ``files`` (only the first so many by name),
    ``first`` and ``limit`` (sequences of each shard from ``first`` to before ``limit``)."""

    @classmethod
    def name(cls) -> str:
        return "tokenbin"

    def schema(self) -> str:
        return "shard string, seq_id bigint, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark) -> None:
    """Makes ``spark.read.format("tokenbin")`` known."""
    spark.dataSource.register(TokenBin)


def _place(uri: str):
    """A filesystem and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if uri.startswith("file:"):
        return LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(uri) if "://" in uri else (LocalFileSystem(), uri)


def _shards(uri: str) -> list:
    """The shards of a folder by name; none if it isn't there."""
    from pyarrow.fs import FileSelector

    fs, where = _place(uri)
    found = fs.get_file_info(FileSelector(where, allow_not_found=True))
    return sorted((f for f in found if f.path.endswith(".bin")), key=lambda f: f.base_name)


@dataclass
class _Shard(InputPartition):
    path: str
    first: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.length = options["path"], int(options.get("seq_len", 2048))
        self.first, self.stop = int(options.get("first", 0)), int(options.get("limit", 1 << 62))
        self.files = int(options.get("files", 1 << 62))

    def partitions(self):
        found = [_Shard(f.path, self.first, min(f.size // 2 // self.length, self.stop)) for f in _shards(self.path)[: self.files]]
        return [s for s in found if s.first < s.stop] or [_Shard("", 0, 0)]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        if not partition.stop:
            return
        fs, _ = _place(self.path)
        name, step = partition.path.rsplit("/", 1)[-1], 2 * self.length
        if fs.type_name == "local":
            ids = np.memmap(partition.path, "<u2", "r")
            for i in range(partition.first, partition.stop):
                yield name, i, ids[i * self.length : (i + 1) * self.length].tolist()
        else:
            with fs.open_input_file(partition.path) as f:
                for i in range(partition.first, partition.stop):
                    yield name, i, np.frombuffer(f.read_at(step, i * step), "<u2").tolist()


@dataclass
class _Written(WriterCommitMessage):
    part: int
    path: str
    size: int


class _Writer(DataSourceWriter):
    """Tasks write below a folder of this job; the commit moves shards to their numbers and undoes that if one fails."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, where = _place(self.path)
        context, size = TaskContext.get(), 0
        fs.create_dir(f"{where}/{self.job}", recursive=True)
        path = f"{where}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        with fs.open_output_stream(path) as f:
            for r in rows:
                data = np.asarray(r["tokens"], "<u2").tobytes()
                f.write(data)
                size += len(data)
        return _Written(context.partitionId(), path, size)

    def commit(self, messages) -> None:
        fs, where = _place(self.path)
        old = _shards(self.path)
        numbers = [int(m[1]) for f in old if (m := re.search(r"(\d+)\D*$", f.base_name))]
        at, moved = 0 if self.overwrite else max(numbers, default=-1) + 1, []
        written = sorted((m for m in messages if m is not None and m.size), key=lambda m: m.part)
        if self.overwrite:
            for f in old:
                fs.delete_file(f.path)
        try:
            for k, m in enumerate(written):
                final = f"{where}/shard_{at + k:05d}.bin"
                fs.move(m.path, final)
                moved.append(final)
        except Exception:
            for f in moved:
                fs.delete_file(f)
            raise
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow.fs import FileType

        fs, where = _place(self.path)
        if fs.get_file_info(f"{where}/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{where}/{self.job}")
