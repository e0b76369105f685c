"""Running sums and budget prefixes over documents in order, without a single-partition window.

Documents are numbered, so a chunk is ``ord`` div a constant. Chunk totals are one aggregate;
their running sum has one row per chunk; a window within each chunk does the rest. A budget becomes
one number, found on costs alone, and a filter by it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def with_running_sum(rows: DataFrame, cost: str, out: str = "upto", order: str = "ord", chunk: int = CHUNK) -> DataFrame:
    """Adds the sum of ``cost`` over all rows up to and with this one."""
    chunked = rows.withColumn("__chunk", F.floor(F.col(order) / chunk))
    totals = chunked.groupBy("__chunk").agg(F.sum(cost).alias("__total"))
    # chunks of chunks, so that this window isn't one partition either
    super_ = totals.withColumn("__super", F.floor(F.col("__chunk") / chunk))
    inside = F.sum("__total").over(Window.partitionBy("__super").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    tops = super_.groupBy("__super").agg(F.sum("__total").alias("__top"))
    over = F.sum("__top").over(Window.orderBy("__super").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("__super", F.coalesce(over, F.lit(0)).alias("__over"))
    starts = super_.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(tops, "__super").select("__chunk", (F.col("__inside") + F.col("__over")).alias("__start"))
    own = F.sum(cost).over(Window.partitionBy("__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return chunked.withColumn("__own", own).join(starts, "__chunk").withColumn(out, F.col("__start") + F.col("__own")).drop("__chunk", "__own", "__start")


def first_documents(rows: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """A filter on the number, which a scan can push down; not an unordered limit."""
    return rows.where(F.col(order) < n)


def budget_end(rows: DataFrame, cost: str, budget: int, order: str = "ord", chunk: int = CHUNK) -> int:
    """The number after the last document that a budget takes: the one that crosses it is taken, and always the first.

    Only numbers and costs are read: totals by chunk, the chunk in which their running sum crosses the
    budget, then that chunk's documents.
    """
    narrow = rows.select(F.col(order).alias("ord"), F.col(cost).cast("long").alias("cost"))
    totals = narrow.groupBy(F.floor(F.col("ord") / chunk).alias("chunk")).agg(F.sum("cost").alias("cost"))
    summed = with_running_sum(totals, "cost", "upto", "chunk", chunk)
    crossed = summed.where(F.col("upto") >= budget).agg(F.min(F.struct("chunk", (F.col("upto") - F.col("cost")).alias("before"))).alias("at")).first()["at"]
    if crossed is None:  # all of them
        return (narrow.agg(F.max("ord")).first()[0] or 0) + 1
    inside = narrow.where((F.col("ord") >= crossed["chunk"] * chunk) & (F.col("ord") < (crossed["chunk"] + 1) * chunk))
    upto = F.sum("cost").over(Window.partitionBy(F.floor(F.col("ord") / chunk)).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("upto", upto + crossed["before"]).where(F.col("upto") >= budget).agg(F.min("ord")).first()[0] + 1


def within_budget(rows: DataFrame, cost: str, budget: int, order: str = "ord") -> DataFrame:
    """Documents until the budget is reached, with the one that crosses it; always the first. A filter by number: no row moves."""
    return first_documents(rows, budget_end(rows, cost, budget, order), order)


def bytes_within(rows: DataFrame, budget: int, text: str = "text", order: str = "ord") -> DataFrame:
    """The prefix of lines (text and line end) whose bytes use up the budget."""
    return within_budget(rows.withColumn("__cost", F.octet_length(text).cast("long") + 1), "__cost", budget, order).drop("__cost")


def rank_by_chunk(rows: DataFrame, chunk: str, *order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank, from 0: rows by chunk, then by the order, in each group of ``within``.

    Chunks are counted and their counts added up; only rows of one chunk are sorted together.
    """
    key = [*within, chunk]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*within).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*key, F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return rows.withColumn("__own", own).join(starts, key).withColumn("rank", F.col("__before") + F.col("__own")).drop("__own", "__before")


def interval_of(place: Column, starts: list[int]) -> Column:
    """How many starts after the first are at or below the place, by bisection; starts ascend."""
    if len(starts) < 2:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")
    half = lambda s: F.call_function("div", s["lo"] + s["hi"] + 1, F.lit(2)).cast("int")
    turn = lambda s, _: F.struct(F.when(F.get(held, half(s)) <= place, half(s)).otherwise(s["lo"]).alias("lo"), F.when(F.get(held, half(s)) <= place, s["hi"]).otherwise(half(s) - 1).alias("hi"))
    begun = F.struct(F.lit(0).alias("lo"), F.lit(len(starts) - 1).alias("hi"))
    return F.aggregate(F.array_repeat(F.lit(0), len(starts).bit_length()), begun, turn, lambda s: s["lo"])
