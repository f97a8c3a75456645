"""Flat token files with 64-bit document offsets, memory-mapped on reading.

Documents are dealt by ranges of ``doc_id`` and sorted inside each range, so file after file holds them in
ascending order.  Each task writes three flat little-endian files: ``.bin`` unsigned 16-bit ids, ``.idx``
signed 64-bit token offsets (one more than documents) and ``.doc`` signed 64-bit document ids.  A manifest row
per file holds its counts; the place of a file in the whole stream (its base) is the prefix sum of the token
counts before it, so no task needs another task's data.

Defined results: a null text is empty (one end id); a null ``doc_id`` sorts first and is stored as the least
64-bit integer, and the manifest counts a file's nulls; repeated ``doc_id`` values are kept, ordered by a hash of their
text; very long texts are whole; other columns, whatever their names, are not read; an empty table gives no file and
an empty result.  Ids are written as batches come, under a name of the attempt; the files are moved to their place at
the end, so a repeated task leaves one copy.  Where a filesystem has no local files, reading asks for ranges of bytes.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.encoding import encoder, vocabulary_path
from corpusmill.session import fresh_path, lean, materialize

NULL_ID = -(2**63)
_MANIFEST = pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("nulls", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _place(uri: str):
    """A filesystem and the path in it; plain local files where the scheme allows."""
    if uri.startswith("file:"):
        return None, "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return None, uri
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class _Writer:
    """A file written piece by piece under a name of the attempt, then moved to its place."""

    def __init__(self, uri: str):
        self.fs, self.path = _place(uri)
        context = TaskContext.get()
        self.temporary = f"{self.path}.{context.taskAttemptId() if context else 0}"
        if self.fs is None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.file = open(self.temporary, "wb")
        else:
            self.fs.create_dir(os.path.dirname(self.path), recursive=True)
            self.file = self.fs.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def commit(self) -> None:
        self.file.close()
        if self.fs is None:
            os.replace(self.temporary, self.path)
        else:
            self.fs.move(self.temporary, self.path)


class _Mapped:
    """A flat file of numbers: a memory map, or ranges of bytes where there are no local files."""

    def __init__(self, uri: str, kind: str):
        fs, path = _place(uri)
        self.kind = np.dtype(kind)
        self.file = fs.open_input_file(path) if fs else None
        self.array = None if fs else np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, kind)

    def __getitem__(self, own: slice) -> np.ndarray:
        if self.file is None:
            return self.array[own]
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((own.stop - own.start) * size, own.start * size), self.kind)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_token_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 0) -> tuple[str, DataFrame]:
    """Encodes ``doc_id, text`` and writes the files below ``path``; returns it and the manifest with bases."""
    spark = lean(docs.sparkSession)
    path = path or fresh_path(spark, "tokens")
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, end = encoder(vocabulary).encode, end_id.to_bytes(2, "little")
        name, out, offsets, ids, nulls = f"{path}/part-{part:06d}", None, [0], [], 0
        for b in batches:
            if b.num_rows and out is None:
                out = _Writer(f"{name}.bin")
            nulls += b.column(0).null_count
            ids.extend(NULL_ID if i is None else i for i in b.column(0).to_pylist())
            for text in b.column(1):
                raw = encode(text.as_py()) + end
                out.write(raw)
                offsets.append(offsets[-1] + len(raw) // 2)
        if out:
            out.commit()
            for kind, data in (("idx", offsets), ("doc", ids)):
                file = _Writer(f"{name}.{kind}")
                file.write(np.asarray(data, "<i8").tobytes())
                file.commit()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)]), pa.array([offsets[-1]]), pa.array([nulls])], schema=_MANIFEST)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    manifest = materialize(dealt.mapInArrow(write, "part int, docs long, tokens long, nulls long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return path, manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Documents as the files hold them: ``doc_id, start, n_tokens, ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                name = f"{path}/part-{row['part']:06d}"
                ids, offsets, docs = _Mapped(f"{name}.bin", "<u2"), _Mapped(f"{name}.idx", "<i8"), _Mapped(f"{name}.doc", "<i8")
                for at in range(0, row["docs"], 8192):
                    stop = min(at + 8192, row["docs"])
                    edges = np.array(offsets[at : stop + 1])
                    crc = [crc32_of(ids[s:e]) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(docs[at:stop]), mask=np.arange(at, stop) < row["nulls"]), pa.array(edges[:-1] + row["base"]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())], schema=_READ
                    )

    files = manifest.select("part", "docs", "nulls", "base").repartition(max(1, manifest.count()))  # a task for each file
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(path: str, part: int, index: int) -> np.ndarray:
    """Random access: the ids of one document of one file, through the memory map."""
    name = f"{path}/part-{part:06d}"
    first, stop = _Mapped(f"{name}.idx", "<i8")[index : index + 2].tolist()
    return np.array(_Mapped(f"{name}.bin", "<u2")[first:stop])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` written to token files and read back."""
    path, manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_files(spark, path, manifest)
