"""Parts of files that tasks read alone: row groups of Parquet, and ranges of bytes of JSON lines.

Where a source is needed up to a budget only, its pieces are taken in order, 1, 2, 4 and so on at a
time, until they hold it; what comes after in the same file isn't read. Workers open
the files themselves, so this is for mounted file systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import storage

#: Bytes of a piece of JSON lines, about: a line belongs to the piece in which it begins.
LINE_BYTES = 32 << 20
#: Lines or rows that a worker hands over at once.
ROWS_AT_ONCE = 4096


def pieces(files: list[str]) -> Iterator[tuple[str, int, int]]:
    """(mounted path, from, to) of the files' pieces in order; a file is opened when its first piece is asked for."""
    for file in files:
        path = storage.mounted(file)
        if path.endswith(".jsonl"):
            with open(path, "rb") as f:
                size = f.seek(0, 2)
            yield from ((path, at, min(at + LINE_BYTES, size)) for at in range(0, size, LINE_BYTES))
        else:
            with pq.ParquetFile(path) as f:
                groups = f.metadata.num_row_groups
            yield from ((path, g, g + 1) for g in range(groups))


def lines(path: str, at: int, to: int) -> Iterator[str]:
    """The texts of JSON lines that begin in a range. A blank or malformed line, or one without a text, is an error."""
    with open(path, "rb") as f:
        if at:  # the line that holds the byte before belongs to the piece before
            f.seek(at - 1)
            f.readline()
        while f.tell() < to and (line := f.readline()):
            text = json.loads(line).get("text")
            if not isinstance(text, str):
                raise ValueError(f"a line of {path} has no text")
            yield text


def _batches(path: str, at: int, to: int, key_column: str) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, keys) of a piece in order."""
    if path.endswith(".jsonl"):
        held = []
        for text in lines(path, at, to):
            held.append(text)
            if len(held) == ROWS_AT_ONCE:
                yield pa.array(held, pa.string()), pa.array(held, pa.string())
                held = []
        if held:
            yield pa.array(held, pa.string()), pa.array(held, pa.string())
        return
    with pq.ParquetFile(path) as f:
        has_key = key_column in f.schema_arrow.names
        for batch in f.iter_batches(ROWS_AT_ONCE, row_groups=list(range(at, to)), columns=["text", key_column] if has_key else ["text"]):
            texts = batch.column("text").cast(pa.string())
            yield texts, batch.column(key_column).cast(pa.string()) if has_key else texts


def read_pieces(spark: SparkSession, taken: list[tuple[str, int, int]], key_column: str = "id") -> DataFrame:
    """(piece, row, text, key): each piece is read by a task of its own; rows are numbered in a piece."""

    def read(batches):
        for batch in batches:
            for number, path, at, to in zip(*(c.to_pylist() for c in batch.columns)):
                row = 0
                for texts, keys in _batches(path, at, to, key_column):
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int64)), pa.array(np.arange(row, row + n)), texts, keys], names=["piece", "row", "text", "key"])
                    row += n

    asked = spark.createDataFrame([(i, *piece) for i, piece in enumerate(taken)], "piece long, path string, at long, to long")
    return asked.repartitionById(max(1, len(taken)), F.col("piece").cast("int")).mapInArrow(read, "piece long, row long, text string, key string")


def first_pieces(spark: SparkSession, files: list[str], budget: int, cost: str) -> tuple[list[tuple[str, int, int]], list[int]]:
    """(pieces from the first on that hold the budget, or all; rows before each)."""
    left, taken, rows, spent, step = pieces(files), [], [], 0, 1
    while spent < budget or not sum(rows):
        some = list(islice(left, step))
        if not some:
            break
        found = {r["piece"]: r for r in read_pieces(spark, some).groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(cost)).alias("cost")).collect()}
        rows += [found[i]["n"] if i in found else 0 for i in range(len(some))]
        spent += sum(r["cost"] or 0 for r in found.values())
        taken, step = taken + some, step * 2
    return taken, np.concatenate([[0], np.cumsum(rows)]).astype(int).tolist()[: len(taken)]
