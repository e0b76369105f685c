"""Best-fit packing of tokenized documents into sequences of a fixed length, by minimum bin slack.

1. Each text becomes token ids and an end id; only longer ones are cut into pieces of
   ``capacity`` tokens, of which the first may be shorter. One narrow stage.
2. The pieces are counted by length: at most ``capacity`` numbers, the only thing that
   the driver sees.
3. ``plan_bins`` packs these counts. For a bin it takes the longest length left and finds
   the fullest feasible combination with it by a bitset subset-sum dynamic programme over
   the lengths available. As the same combination stays the fullest while its lengths
   last, it is used as often as they allow; each use is one bin. So a plan has no more
   patterns than there are lengths, give or take a few, for any number of pieces.
   Filling the first bins to the brim can use up the short lengths that the last ones need.
   So this is done for several reserves of short lengths, which are held back and then go where
   they leave the least room, and the plan with the fewest bins counts (of equals the one with
   the smaller reserve). The largest reserve is all lengths, which is best-fit decreasing: a plan
   never has more bins than that.
4. A piece's rank among those of its length says which bin and offset it gets. Ranks are
   counted in (length, salt) cells of bounded size, so a common length is dealt out to
   many tasks.

Defined cases: a null or empty text is one piece with the end id alone; a very long text is
many pieces, all but the first of full length; repeated rows are packed each; pieces of equal
length take their places by content, and where rows tie in all columns in any order; null ids are kept; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm import bpe
from inkwell.llm.shared import materialize, table

CAPACITY = 1024
END_ID = 2
#: Rows that a (length, salt) cell has on average, at most.
CELL_ROWS = 512
#: Lengths held back from the fullest combinations, as shares of the capacity; the last one holds back all.
RESERVES = (0, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1)


def _pieces(batches, vocabulary_path, capacity, end_id, with_ids):
    vocabulary = bpe.vocabulary(vocabulary_path)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    for batch in batches:
        rows, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            data = vocabulary.token_ids(text.as_py() or "") + end
            a, b, k = 0, (len(data) - 1) % step + 1, 0
            while a < len(data):
                part = data[a:b]
                rows.append(i)
                piece.append(k)
                start.append(a // 4)
                length.append((b - a) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                a, b, k = b, b + step, k + 1
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def tokenized_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32[, ids]: the pieces of each document."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(partial(_pieces, vocabulary_path=vocabulary_path, capacity=capacity, end_id=end_id, with_ids=with_ids), schema).withColumnRenamed("id", id_column)


def fullest(counts: dict[int, int], room: int) -> Counter:
    """The combination of available lengths with the largest sum up to room; of equals, one of longer lengths.

    reach has bit s set if some combination sums to s. A length's copies enter in runs of
    powers of two. The steps at which reach grew let the combination be read backwards.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        copies = min(counts[length], room // length) if length <= room else 0
        run = 1
        while copies > 0:
            use = min(run, copies)
            grown = (reach | reach << (length * use)) & full
            if grown != reach:
                steps.append((reach, length, use))
                reach = grown
            copies -= use
            run *= 2
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, Counter()
    for before, length, use in reversed(steps):
        if not before >> total & 1:
            found[length] += use
            total -= length * use
    return found


def _fullest_bins(left: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(pieces by length in a bin, number of such bins): for the longest length left, the fullest combination."""
    plan = []
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        pattern = fullest({k: n for k, n in rest.items() if n}, capacity - first)
        pattern[first] += 1
        times = min(left[length] // k for length, k in pattern.items())
        plan.append((pattern, times))
        for length, k in pattern.items():
            left[length] -= k * times
            if not left[length]:
                del left[length]
    return plan


def _best_fit(plan: list[tuple[Counter, int]], reserve: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """A plan with more pieces, longest first, each where it leaves the least room, else in a new bin. Equal bins are one entry."""
    rooms, bins = [], {}

    def put(room: int, pattern: Counter, times: int) -> None:
        if times:
            if room not in bins:
                insort(rooms, room)
            bins.setdefault(room, []).append((pattern, times))

    for pattern, times in plan:
        put(capacity - sum(length * k for length, k in pattern.items()), pattern, times)
    for length in sorted(reserve, reverse=True):
        n = reserve[length]
        while n:
            if (at := bisect_left(rooms, length)) < len(rooms):
                room = rooms[at]
                pattern, times = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:  # new bins
                room, pattern, times = capacity, Counter(), n
            # the fullest bin that has room takes all the copies it can before another has any
            each = min(room // length, n)
            used = min(times, n // each)
            if pattern:
                put(room, pattern, times - used)
            put(room - length * each, pattern + Counter({length: each}), used)
            n -= each * used
    return [entry for room in rooms for entry in bins[room]]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """(pieces by length in a bin, number of such bins), so that all counts are used up."""
    counts = {length: n for length, n in counts.items() if n}
    if counts and max(counts) > capacity:
        raise ValueError(f"a piece of {max(counts)} tokens doesn't fit {capacity}")
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best, fewest = [], None
    for share in RESERVES:
        held = {length: n for length, n in counts.items() if length <= share * capacity}
        plan = _fullest_bins({length: n for length, n in counts.items() if length not in held}, capacity)
        plan = _best_fit(plan, held, capacity) if held else plan
        bins = sum(times for _, times in plan)
        if fewest is None or bins < fewest:
            best, fewest = plan, bins
        if fewest == least:
            break
    return best


def _slots(plan: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """For each (length, pattern): the first rank it takes, how many a bin, the first bin and the offset there; sorted by length, rank."""
    ranks, rows, bins = Counter(), [], 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, ranks[length], pattern[length], bins, offset))
            ranks[length] += pattern[length] * times
            offset += length * pattern[length]
        bins += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "bin", "offset"), columns, strict=True))


def _place(batches, slots):
    shift = 1 << 48
    keys = slots["length"] * shift + slots["rank"]
    for batch in batches:
        names = batch.schema.names
        length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
        at = np.searchsorted(keys, length * shift + rank, side="right") - 1
        turn, nth = np.divmod(rank - slots["rank"][at], slots["each"][at])
        kept = [n for n in names if n not in ("rank", "salt")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(names.index(n)) for n in kept), pa.array(slots["bin"][at] + turn, pa.int64()), pa.array(slots["offset"][at] + nth * length, pa.int64())],
            names=[*kept, "sequence_id", "offset"],
        )


def pack_pieces(pieces: DataFrame, id_column: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (see tokenized_pieces). Its files say which rows meet in a cell, so that equal rows are dealt out too."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan_bins(counts, capacity))
    parts = F.expr(f"array({', '.join(str(max(1, -(-counts.get(n, 0) // CELL_ROWS))) for n in range(capacity + 1))})")
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    salted = pieces.withColumn("salt", F.pmod(place, F.get(parts, F.col("length").cast("int")).cast("long")))
    cells = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("ids_crc32", id_column, "piece")
    ranked = salted.join(cells, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1).drop("before")
    names = [c for c in pieces.columns if c != "length"]
    ranked = ranked.select(*names, "length", "rank")
    schema = T.StructType([f for f in ranked.schema if f.name != "rank"]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    return ranked.mapInArrow(partial(_place, slots=slots), schema)


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    pieces = materialize(tokenized_pieces(docs, id_column, text_column, capacity, end_id, vocabulary_path, with_ids), "pieces")
    packed = pack_pieces(pieces, id_column, capacity)
    return packed.select(id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids in order; packed must have been made with_ids. A group is one sequence, so its size is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
