"""Next-fit packing of documents as they arrive.

A micro-batch is packed in parallel, by ``next_fit`` from the state that the one before left: the fill and
number of the open batch. The state after each micro-batch is published under its number, so a micro-batch
that is run again after a failure begins where it began before, overwrites its own rows, and
leaves the same. Nothing but the state, two numbers, is held from one to the next.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.packing import next_fit
from inkwell.operators.prefix import CHUNK, rank_by_chunk
from inkwell.session import scratch
from inkwell.sources import storage

LENGTHS = "ord long, n long"
PACKED = "ord long, n long, batch long"


def after(placed: DataFrame, begun: tuple[int, int]) -> tuple[int, int]:
    """(fill, number) of the batch that is open after these rows (n, batch)."""
    last = placed.groupBy("batch").agg(F.sum("n").alias("fill")).agg(F.max(F.struct("batch", "fill")).alias("last")).first()["last"]
    if last is None:
        return begun
    return last["fill"] + (begun[0] if last["batch"] == begun[1] else 0), last["batch"]


def _state(checkpoint: str, number: int) -> str:
    return storage.child(checkpoint, f"open/{number:09d}.json")


def pack_part(rows: DataFrame, number: int, out: str, checkpoint: str, room: int, oversized: str = "raise") -> None:
    """Pack a micro-batch (ord, n), in order of ord, after the micro-batch before it."""
    spark = rows.sparkSession
    begun = tuple(json.loads(storage.read_bytes(_state(checkpoint, number - 1)))) if number else (0, 0)
    # a stream's rows are read once: their numbers within the micro-batch are found on a written copy
    copy = scratch(spark, "arrived")
    rows.select("ord", "n").write.parquet(copy)
    try:
        held = spark.read.schema(LENGTHS).parquet(copy).withColumn("chunk", F.floor(F.col("ord") / CHUNK))
        ranked = rank_by_chunk(held, "chunk", "ord").select("rank", F.col("ord").alias("number"), "n")
        placed = next_fit(ranked.select(F.col("rank").alias("ord"), "n"), room, oversized, begun=begun).select(F.col("ord").alias("rank"), "batch")
        path = storage.child(out, f"part={number}")
        ranked.join(placed, "rank").select(F.col("number").alias("ord"), "n", "batch").write.mode("overwrite").parquet(path)
    finally:
        storage.remove(copy)
    left = after(spark.read.schema(PACKED).parquet(path), begun)
    storage.replace(_state(checkpoint, number), json.dumps(left).encode())


def pack_incrementally(spark: SparkSession, src: str, out: str, checkpoint: str, room: int, oversized: str = "raise", files_per_batch: int = 1 << 20) -> None:
    """Pack what a folder of Parquet (ord, n) has gained since the last call, then stop. Documents come after those of earlier micro-batches."""
    settled, said = storage.child(checkpoint, "arguments.json"), {"source": str(src), "room": room, "oversized": oversized}
    if not storage.exists(settled):
        storage.publish(settled, json.dumps(said, sort_keys=True).encode())
    elif json.loads(storage.read_bytes(settled)) != said:
        raise ValueError(f"{checkpoint} was begun with other arguments")
    stream = spark.readStream.schema(LENGTHS).option("maxFilesPerTrigger", files_per_batch).parquet(src)
    write = lambda rows, number: pack_part(rows, number, out, checkpoint, room, oversized)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", storage.child(checkpoint, "progress")).trigger(availableNow=True).start().awaitTermination()


def read_packed(spark: SparkSession, out: str) -> DataFrame:
    """(ord, n, batch) of all micro-batches."""
    return spark.read.schema(f"{PACKED}, part int").parquet(out).select("ord", "n", "batch")
