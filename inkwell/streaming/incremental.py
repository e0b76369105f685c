"""Incremental builds and metric logs with Structured Streaming."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.functions.tokenize import encoder as find_encoder
from inkwell.plans.build import counters, kept_documents
from inkwell.sources import storage
from inkwell.sources.documents import MANIFEST


def build_incrementally(spark: SparkSession, src: str, out: str, checkpoint: str, *, tokenizer: str = "bytes", max_bytes: int | None = None, max_tokens: int | None = None, val_frac: float = 0.0, split_seed: int = 0, files_per_batch: int = 16) -> dict:
    """Tokenize the files that a folder of Parquet has gained since the last call, then stop; returns the totals of all calls.

    Each micro-batch overwrites a partition of its own number, so a batch that is run again
    after a failure leaves its rows once. Progress is in the checkpoint. The arguments that decide
    what is kept are written there by the first call; a later one with others is refused. A
    batch's counters are written beside its rows, under names that readers of the folder skip, and
    their sums last, as a manifest.
    """
    encode = find_encoder(tokenizer)
    said = {"source": str(src), "tokenizer": encode.spec.as_dict(), "max_bytes": max_bytes, "max_tokens": max_tokens, "val_frac": val_frac, "split_seed": split_seed}
    settled = storage.child(checkpoint, "arguments.json")
    if not storage.exists(settled):
        storage.publish(settled, json.dumps(said, sort_keys=True).encode())
    elif json.loads(storage.read_bytes(settled)) != said:
        raise ValueError(f"{checkpoint} was begun with other arguments")
    schema = spark.read.option("recursiveFileLookup", "true").parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(src)
    key = F.col("id").cast("string") if "id" in schema.names else F.col("text")
    docs = stream.select(F.lit(0).cast("long").alias("ord"), "text", key.alias("key"))

    def write(batch: DataFrame, number: int) -> None:
        rows, _ = kept_documents(batch, encode, None, max_bytes, max_tokens, val_frac, split_seed)
        path = storage.child(out, f"_held/batch={number}")
        tokens = X.framed(F.col("ids"), encode.spec.bos, encode.spec.eos)
        rows.select("key", tokens.alias("tokens"), "n_bytes", "n_tokens", "is_val", "fate").write.mode("overwrite").parquet(path)
        held = spark.read.parquet(path)
        counters(held).write.mode("overwrite").json(storage.child(out, f"_counters/batch={number}"))
        held.where("fate = 'kept'").select("key", "tokens", "n_bytes", "is_val").write.mode("overwrite").parquet(storage.child(out, f"batch={number}"))
        storage.remove(path)

    docs.writeStream.foreachBatch(write).option("checkpointLocation", storage.child(checkpoint, "progress")).trigger(availableNow=True).start().awaitTermination()
    totals = {}
    if storage.exists(storage.child(out, "_counters")):
        kept = spark.read.json(storage.child(out, "_counters"))
        totals = kept.agg(*[F.sum(c).alias(c) for c in kept.columns if c != "batch"]).first().asDict()
    storage.replace(storage.child(out, f"_{MANIFEST}"), json.dumps({**said, "filter_stats": totals}, indent=1).encode())
    return totals


def append_metrics(log: DataFrame, out: str, checkpoint: str) -> None:
    """Append a stream of metric records to a JSON log; a resumed query appends where it stopped."""
    log.writeStream.format("json").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
