"""Flat shards as a data source of Spark's: ``spark.read.format("inkwell_shards").load(folder)``, and ``write`` to it.

A shard is three little-endian files: 16-bit tokens, 64-bit offsets of its documents (one more than
documents), 32-bit byte lengths of their texts. Readers get ranges of documents, some
``RANGE_BYTES`` of tokens each, and read those bytes alone. Writers take rows that come by shard
and in order, write under names of their attempt in a folder of the job, and send the names to the driver, which
renames whole shards into place when all tasks are done; a job that fails leaves nothing. The folder
must be one that all machines mount.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "inkwell_shards"
SCHEMA = "ord long, shard int, tokens binary, n_bytes long"
#: Bytes of tokens that a task reads, about, and those that it hands over at once.
RANGE_BYTES, CELL_BYTES = 64 << 20, 16 << 20
# Kinds of a shard's files, by their types.
TOKENS, OFFSETS, LENGTHS = "tokens.u16", "offsets.i64", "bytes.i32"
KINDS = {TOKENS: "<u2", OFFSETS: "<i8", LENGTHS: "<i4"}
DRAFTS = "_drafts-"


def shard_name(number: int, kind: str) -> str:
    return f"shard_{number:05d}.{kind}"


@dataclass
class Documents(InputPartition):
    """Documents first to last (without) of a shard, the first of which has the number ord."""

    shard: int
    first: int
    last: int
    ord: int


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def _file(self, shard: int, kind: str) -> str:
        return f"{self.folder}/{shard_name(shard, kind)}"

    def partitions(self) -> list[Documents]:
        found = sorted(int(m[1]) for name in os.listdir(self.folder) if (m := re.fullmatch(rf"shard_(\d{{5,}})\.{re.escape(TOKENS)}", name)))
        if found != list(range(len(found))):
            raise ValueError(f"{self.folder} lacks a shard below {found[-1]}")
        out, total = [], 0
        for shard in found:
            size, docs, lengths = (os.path.getsize(self._file(shard, kind)) // np.dtype(KINDS[kind]).itemsize for kind in (TOKENS, OFFSETS, LENGTHS))
            docs -= 1
            with open(self._file(shard, OFFSETS), "rb") as f:
                begin = int.from_bytes(f.read(8), "little")
                f.seek(8 * docs)
                end = int.from_bytes(f.read(8), "little")
            if (begin, end, lengths) != (0, size, docs):
                raise ValueError(f"{self._file(shard, OFFSETS)} doesn't match the shard's other files")
            ranges = max(1, min(docs, -(-2 * size // RANGE_BYTES)))
            cuts = [docs * k // ranges for k in range(ranges + 1)]
            out += [Documents(shard, a, b, total + a) for a, b in zip(cuts, cuts[1:]) if a < b]
            total += docs
        return out

    def read(self, partition: Documents) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Documents):  # there is no shard
            return
        part = lambda kind, first, n: np.fromfile(self._file(partition.shard, kind), KINDS[kind], n, offset=first * np.dtype(KINDS[kind]).itemsize)
        n = partition.last - partition.first
        offsets, lengths = part(OFFSETS, partition.first, n + 1), part(LENGTHS, partition.first, n)
        if (np.diff(offsets) < 2).any():
            raise ValueError(f"a document of {self._file(partition.shard, OFFSETS)} has fewer than two tokens")
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CELL_BYTES // 2, side="right")) - 1)
            cells = part(TOKENS, int(offsets[at]), int(offsets[end] - offsets[at]))
            ends = ((offsets[at : end + 1] - offsets[at]) * 2).astype(np.int32)
            tokens = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(ends), pa.py_buffer(cells)])
            ords = np.arange(partition.ord + at, partition.ord + end, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ords), pa.array(np.full(end - at, partition.shard, np.int32)), tokens, pa.array(lengths[at:end].astype(np.int64))], names=["ord", "shard", "tokens", "n_bytes"])
            at = end


@dataclass
class Written(WriterCommitMessage):
    """(draft, name) of a task's files."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.drafts = folder, f"{folder}/{DRAFTS}{uuid.uuid4().hex[:12]}"
        Path(self.drafts).mkdir(parents=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        attempt, made, shard, tokens, offsets, lengths = TaskContext.get().taskAttemptId(), [], None, None, [0], []

        def draft(kind: str) -> str:
            made.append((f"{self.drafts}/{shard_name(shard, kind)}.{attempt}", f"{self.folder}/{shard_name(shard, kind)}"))
            return made[-1][0]

        def finish() -> None:
            tokens.close()
            np.array(offsets, KINDS[OFFSETS]).tofile(draft(OFFSETS))
            np.array(lengths, KINDS[LENGTHS]).tofile(draft(LENGTHS))

        last = -1
        for batch in iterator:
            for ord_, number, cell, size in zip(batch.column("ord"), batch.column("shard"), batch.column("tokens"), batch.column("n_bytes")):
                if number.as_py() != shard:
                    if shard is not None:
                        finish()
                    shard, offsets, lengths, last = number.as_py(), [0], [], -1
                    tokens = open(draft(TOKENS), "wb")
                if ord_.as_py() <= last:
                    raise ValueError(f"documents of shard {shard} aren't in order")
                last, data = ord_.as_py(), cell.as_buffer()
                tokens.write(data)
                offsets.append(offsets[-1] + len(data) // 2)
                lengths.append(size.as_py())
        if shard is not None:
            finish()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        files = [file for m in messages if m is not None for file in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            shutil.rmtree(self.drafts, ignore_errors=True)
            raise ValueError("a shard was written by two tasks: deal rows out by shard first")
        for draft, name in files:
            os.replace(draft, name)
        shutil.rmtree(self.drafts, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.drafts, ignore_errors=True)


class FlatShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and the package to its workers."""
    from inkwell.shipping import ship

    ship(spark)
    spark.dataSource.register(FlatShards)
