"""Whole-document next-fit packing, in parallel and exact.

Next-fit starts a new batch at a document that doesn't fit the open one, so it looks
sequential: what a chunk of documents does depends on how full the open batch is when the chunk
begins. But that fill only decides how many of the chunk's first documents still fit. So what a
chunk does is a function of the room that is left, with a step for every such number: the batches
that it closes and the fill it leaves (one pass from its end, as later batches don't
depend on how they were reached). Where all of the chunk fits, the fill grows by its sum.

Such functions compose: two in a row are one with as many steps as the first, unless all of the first
fits, when the second's steps follow. A tree composes ``FAN`` of them a node, level by level; then states
go down it, from the root's to each chunk's. A function has no more steps than documents fit into one batch, a
few dozen at a training window, and the driver has only the number of chunks and the sum of lengths.
Then each chunk knows its state and numbers its documents.

Where a batch holds whole chunks (a shard of a billion tokens), functions would be as long as the
chunks. Then the driver has the chunks' totals alone and fetches the lengths of those chunks in
which a batch ends, many at a time: it guesses the next ends from the totals, and fetches anew
from where a guess was wrong.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import scratch

CHUNK = 1 << 16
#: Functions that a node of the tree composes.
FAN = 64
#: Chunks whose lengths are fetched at once, at 8 bytes a document.
FETCHED = 64


def _reach(lengths: np.ndarray, room: int) -> np.ndarray:
    """For each document, the first one after it that a batch begun there has no room for; an oversized one is alone."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.searchsorted(bounds, bounds[:-1] + room, side="right") - 1
    return np.maximum(ends, np.arange(len(lengths)) + 1)


@dataclass
class Steps:
    """What some documents in a row do to the open batch, by the room that it has left.

    Room from starts[i] on (and below the next): inc[i] batches are begun and the last has fill[i]. Room of
    ``total`` or more: all fit, and the fill grows by total; -1 where they are more than a batch.
    """

    starts: np.ndarray
    inc: np.ndarray
    fill: np.ndarray
    total: int

    def apply(self, fill: int, room: int) -> tuple[int, int]:
        """(batches begun, fill after)."""
        left = max(0, room - fill)
        if 0 <= self.total <= left:
            return 0, fill + self.total
        i = int(np.searchsorted(self.starts, left, side="right")) - 1
        return int(self.inc[i]), int(self.fill[i])

    def then(self, other: Steps, room: int) -> Steps:
        """This, then the other."""
        after = [other.apply(int(f), room) for f in self.fill]
        inc, fill = self.inc + np.array([n for n, _ in after], np.int64), np.array([f for _, f in after], np.int64)
        if self.total < 0:
            return Steps(self.starts, inc, fill, -1)
        on = other.starts + self.total < room
        total = self.total + other.total if other.total >= 0 else -1
        joined = lambda a, b: np.concatenate([a, b[on]])
        return Steps(joined(self.starts, other.starts + self.total), joined(inc, other.inc), joined(fill, other.fill), total if total <= room else -1)


def _steps(lengths: np.ndarray, room: int) -> Steps:
    """The function of a chunk."""
    n, ends = len(lengths), _reach(lengths, room)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    closed, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        e = ends[i]
        closed[i], left[i] = (0, bounds[n] - bounds[i]) if e == n else (closed[e] + 1, left[e])
    most = min(int(np.searchsorted(bounds, room, side="left")), n)  # no batch with a document has all the room left
    return Steps(bounds[:most].copy(), closed[:most] + 1, left[:most].copy(), int(bounds[n]) if bounds[n] <= room else -1)


FUNCTIONS = "node long, starts array<long>, inc array<long>, fill array<long>, total long"


def _functions(pdf: pd.DataFrame) -> list[tuple[int, Steps]]:
    """(node, function) of rows, in order of nodes."""
    pdf = pdf.sort_values("node")
    arrays = lambda c: [np.asarray(x, np.int64) for x in pdf[c]]
    return list(zip(pdf["node"].tolist(), map(Steps, arrays("starts"), arrays("inc"), arrays("fill"), pdf["total"].tolist())))


def _row(node: int, f: Steps) -> pd.DataFrame:
    return pd.DataFrame({"node": [node], "starts": [f.starts], "inc": [f.inc], "fill": [f.fill], "total": [f.total]})


def _composed(pdf: pd.DataFrame, room: int) -> pd.DataFrame:
    """A parent's function, of its children's."""
    functions = _functions(pdf)
    return _row(int(pdf["parent"].iloc[0]), reduce(lambda f, g: f.then(g, room), (f for _, f in functions)))


def _passed(pdf: pd.DataFrame, room: int) -> pd.DataFrame:
    """Children's states, of their functions and the parent's state."""
    fill, batch, out = int(pdf["begun_fill"].iloc[0]), int(pdf["begun_batch"].iloc[0]), []
    for node, f in _functions(pdf):
        out.append((node, fill, batch))
        inc, fill = f.apply(fill, room)
        batch += inc
    return pd.DataFrame(out, columns=["node", "fill", "batch"])


def _kept(rows: DataFrame, schema: str, label: str) -> DataFrame:
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _number(pdf: pd.DataFrame, room: int) -> pd.DataFrame:
    pdf = pdf.sort_values("ord")
    lengths = pdf["n"].to_numpy(np.int64)
    fill, batch = int(pdf["fill"].iloc[0]), int(pdf["batch"].iloc[0])
    n, ends = len(lengths), _reach(lengths, room)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = max(0, int(np.searchsorted(bounds, room - fill, side="right") - 1)) if fill else 0
    marks = np.zeros(n, np.int64)
    while at < n:
        marks[at] = 1
        at = int(ends[at])
    if not fill:
        marks[0] = 0
    return pd.DataFrame({"ord": pdf["ord"].to_numpy(), "n": lengths, "batch": batch + np.cumsum(marks)})


def _through(lengths: np.ndarray, fill: int, room: int) -> tuple[int, int]:
    """(batches closed in a chunk, fill it leaves), for the fill that it begins with."""
    n, ends = len(lengths), _reach(lengths, room)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = max(0, int(np.searchsorted(bounds, room - fill, side="right") - 1)) if fill else 0
    if at == n:
        return 0, fill + int(bounds[n])
    closed, begun = int(fill > 0), at
    while (at := int(ends[at])) < n:
        closed, begun = closed + 1, at
    return closed, int(bounds[n] - bounds[begun])


def _chain_tree(rows: DataFrame, room: int, chunks: int, fan: int = FAN, begun: tuple[int, int] = (0, 0)) -> DataFrame:
    """(chunk, fill, batch) at each chunk's begin. Where no batch is open before the first, a full one of the number before is, which comes to the same."""
    fill, batch = begun if begun[0] else (room, begun[1] - 1)
    one = lambda pdf: _row(int(pdf["chunk"].iloc[0]), _steps(pdf.sort_values("ord")["n"].to_numpy(np.int64), room))
    level = rows.groupBy("chunk").applyInPandas(one, FUNCTIONS)
    parent = F.call_function("div", F.col("node"), F.lit(fan))
    levels, nodes = [], chunks
    while nodes > fan:
        levels.append(_kept(level, FUNCTIONS, "steps"))
        level = levels[-1].withColumn("parent", parent).groupBy("parent").applyInPandas(lambda pdf: _composed(pdf, room), FUNCTIONS)
        nodes = -(-nodes // fan)
    down = lambda pdf: _passed(pdf, room)
    state = "node long, fill long, batch long"
    states = level.withColumns({"begun_fill": F.lit(fill).cast("long"), "begun_batch": F.lit(batch).cast("long"), "parent": F.lit(0)}).groupBy("parent").applyInPandas(down, state)
    for below in reversed(levels):
        begun = states.select(F.col("node").alias("parent"), F.col("fill").alias("begun_fill"), F.col("batch").alias("begun_batch"))
        states = below.withColumn("parent", parent).join(begun, "parent").groupBy("parent").applyInPandas(down, state)
    return states.select(F.col("node").alias("chunk"), "fill", "batch")


def _chain_totals(rows: DataFrame, room: int, totals: list[tuple[int, int]], at_once: int = FETCHED, begun: tuple[int, int] = (0, 0)) -> list[tuple[int, int, int]]:
    """The same from the chunks' totals, and the lengths of chunks in which a batch ends."""
    states, (fill, batch), held = [], begun, {}
    for i, (number, total) in enumerate(totals):
        states.append((number, fill, batch))
        if fill + total <= room:
            fill += total
            continue
        if number not in held:
            guess, wanted = fill, []
            for later, sum_ in totals[i:]:
                guess += sum_
                if guess > room:
                    wanted.append(later)
                    guess %= room
                if len(wanted) == at_once:
                    break
            found = rows.where(F.col("chunk").isin(wanted)).select("chunk", "ord", "n").toPandas().sort_values("ord")
            held = {int(c): part["n"].to_numpy(np.int64) for c, part in found.groupby("chunk")}
        closed, fill = _through(held.pop(number), fill, room)
        batch += closed
    return states


def _written(rows: DataFrame) -> DataFrame:
    """Lengths alone, written once in order of chunks: the passes below read no text, and those for some chunks skip the others."""
    path = scratch(rows.sparkSession, "lengths")
    rows.repartitionByRange("chunk").sortWithinPartitions("chunk", "ord").write.parquet(path)
    return rows.sparkSession.read.schema("ord long, n long, chunk long").parquet(path)


def next_fit(lengths: DataFrame, room: int, oversized: str = "raise", chunk: int = CHUNK, begun: tuple[int, int] = (0, 0)) -> DataFrame:
    """(ord, n, batch) for documents (ord, n) numbered from 0 without gaps; batches are numbered from 0.

    oversized: a document longer than the room fails the query ("raise"), or is a batch alone
    ("alone"). begun: (fill, number) of a batch that earlier documents have opened.
    """
    if room <= 0:
        raise ValueError("the room must be positive")
    n = F.col("n").cast("long")
    if oversized == "raise":
        n = F.when(n > room, F.raise_error(F.concat(F.lit("document "), F.col("ord").cast("string"), F.lit(f" doesn't fit {room}")))).otherwise(n)
    n = F.when(n <= 0, F.raise_error(F.lit("a document has no token"))).otherwise(n)
    rows = lengths.select(F.col("ord").cast("long").alias("ord"), n.alias("n"), F.floor(F.col("ord") / chunk).cast("long").alias("chunk"))
    rows = _written(rows)
    chunks, total = rows.agg(F.coalesce(F.max("chunk") + 1, F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if room * chunks > total // 8:  # a batch holds a good part of a chunk, or several
        totals = sorted((r["chunk"], r["t"]) for r in rows.groupBy("chunk").agg(F.sum("n").alias("t")).collect())
        started = rows.sparkSession.createDataFrame(_chain_totals(rows, room, totals, begun=begun) or [(0, *begun)], "chunk long, fill long, batch long")
    else:
        started = _chain_tree(rows, room, chunks, begun=begun)
    return rows.join(started, "chunk").groupBy("chunk").applyInPandas(lambda pdf: _number(pdf, room), "ord long, n long, batch long")


def batches(placed: DataFrame) -> DataFrame:
    """(batch, start_doc, end_doc, real_tokens) of next_fit's result."""
    return placed.groupBy("batch").agg(F.min("ord").alias("start_doc"), (F.max("ord") + 1).alias("end_doc"), F.sum("n").alias("real_tokens"))


def utilization(plan: DataFrame, window: int) -> DataFrame:
    """Share of the windows' positions that hold real tokens."""
    return plan.agg((F.sum("real_tokens") / (F.count(F.lit(1)) * window)).alias("utilization"), F.count(F.lit(1)).alias("n_batches"))
