"""Fixed-shape batches from a packing plan: segment bounds, positions, inputs and targets."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators.prefix import interval_of

#: Parts that documents are dealt out to, at most: a part's first document and batch are two numbers on the driver.
MOST_PARTS = 1 << 16
#: Bytes of documents that a part has, about.
PART_BYTES = 64 << 20
#: Numbers of finished batches that a worker hands over at once, about.
EMITTED = 1 << 18


def filler_chunks(remaining: Column, longest: int) -> Column:
    """Lengths of the segments that fill a batch up, none above the longest."""
    if longest <= 0:
        raise ValueError("a segment has a position at least")
    n = F.ceil(remaining / F.lit(longest)).cast("int")
    at = F.when(remaining > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.least(F.lit(longest).cast("long"), remaining.cast("long") - i.cast("long") * longest))


def segments(placed: DataFrame, window: int, longest: int) -> DataFrame:
    """(batch, real_tokens, lengths): lengths of a batch's documents in order, then of its filler."""
    own = placed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ord", "n"))).alias("parts"), F.sum("n").alias("real_tokens"))
    filler = filler_chunks(F.lit(window) - F.col("real_tokens"), longest)
    return own.select("batch", "real_tokens", F.concat(F.transform("parts", lambda p: p["n"].cast("long")), filler).alias("lengths"))


def bounds(lengths: Column) -> Column:
    """Where segments begin and end: a running sum from 0."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(lengths, zero, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def positions(lengths: Column) -> Column:
    """Positions that start again in each segment."""
    return F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0).cast("long"), n - 1)))


def loss_positions(batch: DataFrame) -> DataFrame:
    """(batch, slot, id, target, position) of a materialized batch's places that bear a loss."""
    places = batch.select("batch", F.posexplode(F.arrays_zip("ids", "targets", "positions")).alias("slot", "x"))
    return places.where(F.col("x.targets") != X.IGNORED).select("batch", "slot", F.col("x.ids").alias("id"), F.col("x.targets").alias("target"), F.col("x.positions").alias("position"))


def materialize(placed: DataFrame, documents: DataFrame, window: int, longest: int, pad: int = X.PAD) -> DataFrame:
    """(batch, ids, targets, positions, bounds) of next_fit's result and documents (ord, tokens), tokens framed.

    Lengths are planned first and tokens joined last, one equi-join on ord. A batch is
    bounded by its window.
    """
    return filled(placed.join(documents.select("ord", "tokens"), "ord"), window, longest, pad)


def filled(joined: DataFrame, window: int, longest: int, pad: int = X.PAD) -> DataFrame:
    """As materialize, of rows (batch, ord, n, tokens); rows dealt out by batch stay where they are."""
    parts = joined.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ord", "n", "tokens"))).alias("parts"), F.sum("n").cast("int").alias("real"))
    lengths = F.concat(F.transform("parts", lambda p: p["n"].cast("long")), filler_chunks(F.lit(window) - F.col("real"), longest))
    whole = lambda values, with_: F.concat(F.flatten(values), F.array_repeat(F.lit(with_), F.lit(window) - F.col("real")))
    return parts.withColumn("lengths", lengths).select(
        "batch",
        whole(F.transform("parts", lambda p: X.inputs(p["tokens"])), pad).alias("ids"),
        whole(F.transform("parts", lambda p: X.targets(p["tokens"])), X.IGNORED).alias("targets"),
        positions(F.col("lengths")).alias("positions"),
        bounds(F.col("lengths")).alias("bounds"),
    )


def part_starts(placed: DataFrame, n: int, parts: int) -> list[tuple[int, int]]:
    """(first document, its batch) of parts of next_fit's result over n documents: each begins with a batch, near an even cut."""
    begun = placed.groupBy("batch").agg(F.min("ord").alias("start"))
    cut = begun.groupBy(F.call_function("div", F.col("start") * F.lit(parts), F.lit(n)).alias("part")).agg(F.min(F.struct("start", "batch")).alias("first"))
    return sorted((r["first"]["start"], r["first"]["batch"]) for r in cut.collect())


class _Window:
    """A batch as it fills; numbers are copied once."""

    def __init__(self, batch: int, window: int, longest: int, pad: int):
        self.batch, self.window, self.longest, self.used, self.lengths = batch, window, longest, 0, []
        self.ids, self.targets = np.full(window, pad, np.int32), np.full(window, X.IGNORED, np.int32)

    def add(self, tokens: np.ndarray) -> None:
        n = len(tokens) - 1
        self.ids[self.used : self.used + n] = tokens[:-1]
        self.targets[self.used : self.used + n] = tokens[1:]
        self.used += n
        self.lengths.append(n)

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rest = self.window - self.used
        lengths = np.array(self.lengths + [min(self.longest, rest - i) for i in range(0, rest, self.longest)], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids, self.targets, np.arange(self.window, dtype=np.int64) - np.repeat(bounds[:-1], lengths), bounds


def _filling(starts: list[tuple[int, int]], tokens_of: Callable[[pa.Array], list[np.ndarray]], window: int, longest: int, pad: int):
    firsts = [first for first, _ in starts]

    def run(batches):
        open_, held = None, []

        def emitted():
            lists = lambda k, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(w[k]) for _, w in held])]), pa.int32()), pa.array(np.concatenate([w[k] for _, w in held]), kind))
            out = pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), *(lists(k, kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64())))], names=["batch", "ids", "targets", "positions", "bounds"])
            held.clear()
            return out

        for rows in batches:
            for number, tokens in zip(rows.column("ord").to_pylist(), tokens_of(rows.column(1))):
                if open_ is None:
                    open_ = _Window(starts[bisect_right(firsts, number) - 1][1], window, longest, pad)
                elif open_.used + len(tokens) - 1 > window:
                    held.append((open_.batch, open_.done()))
                    open_ = _Window(open_.batch + 1, window, longest, pad)
                    if len(held) * window * 4 >= EMITTED:
                        yield emitted()
                open_.add(tokens)
        if open_ is not None:
            held.append((open_.batch, open_.done()))
            yield emitted()

    return run


def streamed(placed: DataFrame, documents: DataFrame, tokens_of: Callable[[pa.Array], list[np.ndarray]], n: int, n_bytes: int, window: int, longest: int, pad: int = X.PAD) -> DataFrame:
    """(batch, ids, targets, positions, bounds) of next_fit's result over documents (ord, a column that ``tokens_of`` makes framed tokens of).

    Documents are dealt out to ranges of ord that begin with a batch, in one exchange, and sorted there.
    A task fills one window after the other and hands each over when the next document
    doesn't fit: it never holds more than the open one and a few that are done.
    """
    if longest <= 0:
        raise ValueError("a segment has a position at least")
    parts = min(MOST_PARTS, max(-(-n_bytes // PART_BYTES), documents.sparkSession.sparkContext.defaultParallelism))
    starts = part_starts(placed, max(1, n), parts)
    dealt = documents.repartitionById(max(1, len(starts)), interval_of(F.col("ord"), [first for first, _ in starts]).cast("int")).sortWithinPartitions("ord")
    return dealt.mapInArrow(_filling(starts, tokens_of, window, longest, pad), "batch long, ids array<int>, targets array<int>, positions array<long>, bounds array<long>")
