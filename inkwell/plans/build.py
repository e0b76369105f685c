"""The corpus build: filter, split, tokenize, order and write caches with manifests; and reading them.

A cache is a folder of Parquet, one row per document (ord, tokens, n_tokens, n_bytes), partitioned by
shard, and a manifest that is written last and names the folder of the rows. Tokens are cells of
16-bit numbers; ``load`` reads them as arrays. It may be on any store that Spark reads. Two builds of one
cache don't meet: each has rows of its own, and the first manifest stays.

Tokens move once at most. One pass over the source decides the split, filters, tokenizes and
numbers the kept documents of each side within a run, which is what a task reads of consecutive documents;
its table is written, and its counters are observed on the way. A number in all is then that in
the run plus what the runs before have, a table of a row a run. Places, lengths and shards are
found on numbers alone: a shard is a range of places. At last each row computes its place and shard, and
in a shuffled build goes to its place's part in one exchange; in a build in order it stays where it is.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import text as X
from inkwell.functions.splitting import is_validation
from inkwell.functions.splitting import in_share
from inkwell.functions.tokenize import encoder as find_encoder
from inkwell.functions.tokenize import packed, unpacked
from inkwell.operators.order import Bijection, hash_order, permutation
from inkwell.operators.packing import next_fit
from inkwell.operators.prefix import CHUNK, interval_of, rank_by_chunk
from inkwell.sources import storage
from inkwell.sources.flat_shards import FORMAT as FLAT
from inkwell.sources.flat_shards import register, shard_name  # noqa: F401
from inkwell.sources.documents import MANIFEST, MOST_BROADCAST, describe_source, is_cache, manifest, read_source, read_within

FORMAT = "inkwell-cache-v2"
#: A cache's copy of its tokenizer file.
TOKENIZER = "tokenizer.json"
#: Seeded orders: the exact permutation, up to its limit; that of a hash, or a keyed bijection, at any size.
SHUFFLES = ("bijection", "exact", "hash")
#: Bytes of tokens that a part of a shuffled cache has, about.
PART_BYTES = 128 << 20
#: Bytes of tokens that a worker hands over at once, about.
CELL_BYTES = 64 << 20
STORED = "ord long, tokens binary, n_tokens long, n_bytes long, shard int"


def kept_documents(docs: DataFrame, encoder, max_docs: int | None = None, max_bytes: int | None = None, max_tokens: int | None = None, val_frac: float = 0.0, split_seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(all, kept) of documents (ord, text, key).

    all has one row per document with ``fate``: over_bytes, over_tokens or kept, and n_bytes,
    n_tokens (null where the byte limit came first). Limits keep what equals them.
    """
    rows = docs if max_docs is None else docs.where(F.col("ord") < max_docs)
    rows = rows.withColumn("n_bytes", X.byte_length(F.col("text"))).withColumn("is_val", is_validation(F.col("key"), val_frac, split_seed))
    fits = F.lit(True) if max_bytes is None else F.col("n_bytes") <= max_bytes
    tokens = encoder.tokens(F.when(fits, F.col("text")).otherwise(F.lit("")))
    rows = rows.withColumn("ids", tokens).withColumn("n_tokens", F.when(fits, F.size("ids").cast("long")))
    fate = F.when(~fits, "over_bytes")
    if max_tokens is not None:
        fate = fate.when(F.col("n_tokens") > max_tokens, "over_tokens")
    rows = rows.withColumn("fate", fate.otherwise("kept"))
    spec = encoder.spec
    kept = rows.where("fate = 'kept'").select("ord", X.framed(F.col("ids"), spec.bos, spec.eos).alias("tokens"), "n_bytes", "is_val")
    return rows, kept


def counts() -> list[Column]:
    """Documents read, validation documents kept, and what was dropped. Tokens of documents over the byte limit are unknown."""
    dropped = F.col("fate") != "kept"
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("long")
    return [
        F.count(F.lit(1)).alias("read_docs"),
        F.count_if(F.col("is_val") & ~dropped).alias("val_docs"),
        F.count_if(dropped).alias("dropped_docs"),
        total(F.col("fate") == "over_tokens", F.col("n_tokens")).alias("dropped_text_tokens"),
        total(dropped, F.col("n_bytes")).alias("dropped_text_bytes"),
    ]


def counters(rows: DataFrame) -> DataFrame:
    """One row of these counts."""
    return rows.agg(*counts())


def numbered(kept: DataFrame) -> DataFrame:
    """ord anew, from 0 without gaps, in the order of ord; chunk by chunk."""
    chunked = kept.withColumn("__chunk", F.floor(F.col("ord") / CHUNK))
    return rank_by_chunk(chunked, "__chunk", "ord").withColumn("ord", F.col("rank")).drop("__chunk", "rank")


def digest(found: dict) -> str:
    """Of a manifest's content: not of its paths, names or shards."""
    named = {**found, "source": [(f["bytes"], f["sha256"]) for f in found["source"]["files"]]}
    for left_out in ("shards", "rows"):
        named.pop(left_out, None)
    return hashlib.sha256(json.dumps(named, sort_keys=True).encode()).hexdigest()


HELD = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("run", T.LongType()),
        T.StructField("own", T.LongType()),
        T.StructField("is_val", T.BooleanType()),
        T.StructField("fate", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("tokens", T.BinaryType()),
    ]
)


class _Runs:
    """Numbers kept rows of each side within runs of consecutive ord, over a task's batches."""

    def __init__(self):
        self.last, self.run, self.had = None, None, {False: 0, True: 0}

    def number(self, ords: np.ndarray, kept: np.ndarray, is_val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the run of each row: its first ord; kept rows of the row's side before it in the run)."""
        begins = np.diff(ords, prepend=ords[0] - 2 if self.last is None else self.last) != 1
        at = np.maximum.accumulate(np.where(begins, np.arange(len(ords)), -1))
        run = np.where(at >= 0, ords[at], self.run)
        own = np.zeros(len(ords), np.int64)
        for side in (False, True):
            mine = kept & (is_val == side)
            before = np.cumsum(mine) - mine
            here = before - np.where(at >= 0, before[at], -self.had[side])
            own = np.where(is_val == side, here, own)
            self.had[side] = int(here[-1] + mine[-1])
        self.last, self.run = int(ords[-1]), int(run[-1])
        return run, own


def encoded(docs: DataFrame, encoder, max_docs: int | None = None, max_bytes: int | None = None, max_tokens: int | None = None, val_frac: float = 0.0, split_seed: int = 0) -> DataFrame:
    """As kept_documents, a row per document in one pass, with ``run`` and ``own``, and framed tokens as cells (null where dropped)."""
    spec, in_val = encoder.spec, in_share(val_frac, split_seed)

    def run(batches):
        runs, bos, eos = _Runs(), np.array([spec.bos], "<u2"), np.array([spec.eos], "<u2")
        for batch in batches:
            if not batch.num_rows:
                continue
            ords = batch.column("ord").to_numpy()
            texts = batch.column("text").cast(pa.large_binary())
            sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
            is_val = in_val(batch.column("key"))
            fits = np.ones(len(sizes), bool) if max_bytes is None else sizes <= max_bytes
            at = 0
            while at < len(sizes):  # a few rows at a time where texts are long
                end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CELL_BYTES // 4, side="right")) + at)
                ids = encoder.ids([t.as_py() if ok else b"" for t, ok in zip(texts[at:end], fits[at:end])])
                n = np.fromiter((len(x) for x in ids), np.int64, len(ids))
                few = np.ones(len(ids), bool) if max_tokens is None else n <= max_tokens
                kept = fits[at:end] & few
                number, own = runs.number(ords[at:end], kept, is_val[at:end])
                fate = np.where(kept, "kept", np.where(fits[at:end], "over_tokens", "over_bytes"))
                cells = packed([np.concatenate([bos, x, eos]) if ok else x[:0] for x, ok in zip(ids, kept)])
                tokens = pc.if_else(pa.array(kept), cells, pa.scalar(None, pa.binary()))
                columns = [ords[at:end], number, own, is_val[at:end], fate, sizes[at:end]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n, mask=~fits[at:end]), tokens], names=HELD.names)
                at = end

    rows = docs if max_docs is None else docs.where(F.col("ord") < max_docs)
    return rows.select("ord", "text", "key").mapInArrow(run, HELD)


def ranked_runs(held: DataFrame, is_val: bool) -> tuple[DataFrame, int]:
    """(kept documents of a side with ``rank``, their number from 0 without gaps; how many there are). No row moves: a table of runs is joined."""
    mine = held.where((F.col("fate") == "kept") & (F.col("is_val") == is_val))
    found = mine.groupBy("run").agg((F.max("own") + 1).alias("n")).collect()
    begun, total = [], 0
    for run, n in sorted((r["run"], r["n"]) for r in found):
        begun.append((run, total))
        total += n
    bases = held.sparkSession.createDataFrame(begun, "run long, base long")
    return mine.join(F.broadcast(bases) if len(begun) <= MOST_BROADCAST else bases, "run").withColumn("rank", F.col("base") + F.col("own")), total


def placed(rows: DataFrame, n: int, shuffle: str, seed: int | None, part: int) -> DataFrame:
    """Adds ``ord``, a document's place: its rank, or the place that a seeded order of n gives it."""
    rows = rows.drop("ord")
    if seed is None:
        return rows.withColumn("ord", F.col("rank"))
    if shuffle == "bijection":
        return rows.withColumn("ord", Bijection(n, seed, part).place(F.col("rank")))
    order = permutation(rows.sparkSession, n, seed, part) if shuffle == "exact" else hash_order(rows.select(F.col("rank").alias("ord")), seed, part)
    order = order.select(F.col("ord").alias("rank"), F.col("position").alias("ord"))
    # 16 bytes a document: beyond a million, such an order is joined, which moves rows once more
    return rows.join(F.broadcast(order) if n <= MOST_BROADCAST else order, "rank")


def shard_starts(rows: DataFrame, shard_tokens: int) -> list[int]:
    """The place at which each shard begins, of rows (ord, n_tokens): next-fit over framed documents, in which one beyond the size is alone."""
    fitted = next_fit(rows.select("ord", (F.col("n_tokens") + 2).alias("n")), shard_tokens, oversized="alone")
    return [r["start"] for r in fitted.groupBy("batch").agg(F.min("ord").alias("start")).orderBy("batch").collect()]


def cut_into_shards(rows: DataFrame, starts: list[int], n: int, n_bytes: int, shuffled: bool) -> DataFrame:
    """Rows (ord, tokens, n_tokens, n_bytes) with their shard, those of a part together and in order; n of them with so many bytes of tokens."""
    sharded = rows.select("ord", "tokens", "n_tokens", "n_bytes", interval_of(F.col("ord"), starts).cast("int").alias("shard"))
    if shuffled and n:
        parts = max(-(-n_bytes // PART_BYTES), min(n, rows.sparkSession.sparkContext.defaultParallelism))
        # places are dense: a part is a range of them, and needs no sample
        sharded = sharded.repartitionById(parts, F.call_function("div", F.col("ord") * F.lit(parts), F.lit(n)).cast("int"))
    return sharded.sortWithinPartitions("shard", "ord")


def write_cache(sharded: DataFrame, out: str | Path, header: dict, tokenizer_file: bytes | None = None) -> dict:
    """Write rows (ord, tokens as cells, n_tokens, n_bytes, shard); the manifest comes last."""
    if is_cache(out):
        raise FileExistsError(f"{out} holds a cache already")
    rows = f"rows-{uuid.uuid4().hex[:12]}"
    sharded.write.partitionBy("shard").parquet(storage.child(out, rows))
    written = sharded.sparkSession.read.schema(STORED).parquet(storage.child(out, rows))
    shards = [r.asDict() for r in written.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_tokens") + 2).alias("tokens"), F.sum("n_bytes").alias("text_bytes")).orderBy("shard").collect()]
    total = lambda name: sum(s[name] for s in shards)
    found = {"format": FORMAT, **header, "rows": rows, "docs": total("docs"), "tokens": total("tokens"), "loss_tokens": total("tokens") - total("docs"), "text_bytes": total("text_bytes"), "shards": shards}
    try:
        storage.publish(storage.child(out, MANIFEST), json.dumps(found, indent=1).encode())
    except FileExistsError:  # another build was first
        storage.remove(storage.child(out, rows))
        raise
    if tokenizer_file is not None:
        storage.replace(storage.child(out, TOKENIZER), tokenizer_file)
    return found


@dataclass(frozen=True)
class Selection:
    """What a build takes from its source, and in which order."""

    max_docs: int | None = None
    max_tokens: int | None = None
    max_bytes: int | None = None
    shuffle_seed: int | None = None
    val_frac: float = 0.0
    split_seed: int = 0
    shuffle: str = "exact"

    def check(self, val_out: str | Path | None) -> None:
        """A validation side has a place of its own, and its order is drawn, as the sides of a source in order wouldn't be alike."""
        missing = [name for name, given in (("val_out", val_out), ("shuffle_seed", self.shuffle_seed)) if given is None]
        if self.val_frac and missing:
            raise ValueError(f"to split off validation documents, give {' and '.join(missing)}")
        if not 0 <= self.val_frac < 1:
            raise ValueError(f"{self.val_frac} is no share that leaves documents to train on")
        if self.shuffle not in SHUFFLES:
            raise ValueError(f"orders are {', '.join(SHUFFLES)}")


def build(spark: SparkSession, src: str | Path, out: str | Path, *, tokenizer: str = "bytes", specials: tuple[int, int, int] | None = None, shard_tokens: int = 1_000_000_000, val_out: str | Path | None = None, log: Callable[[str], None] = lambda line: None, **selection) -> dict:
    """Build the train cache, and with a split the validation cache; returns the train manifest.

    selection: the fields of ``Selection``. An empty side is an empty cache with a manifest.
    """
    chosen = Selection(**selection)
    chosen.check(val_out)
    sides = {"train": out} | ({"val": val_out} if chosen.val_frac else {})
    if full := [str(path) for path in sides.values() if is_cache(path)]:
        raise FileExistsError(f"{full[0]} holds a cache already")
    encode = find_encoder(tokenizer, specials)
    source = describe_source(spark, src)
    log(f"{src}: {len(source['files'])} files, {sum(f['bytes'] for f in source['files']):,} bytes")
    rows = encoded(read_source(spark, str(src)), encode, chosen.max_docs, chosen.max_bytes, chosen.max_tokens, chosen.val_frac, chosen.split_seed)
    held_in, spec, found, seen = storage.child(out, f"held-{uuid.uuid4().hex[:12]}"), encode.spec, {}, Observation()
    try:
        rows.observe(seen, *counts()).write.parquet(held_in)
        held, stats = spark.read.schema(HELD).parquet(held_in), seen.get
        log(f"{stats['read_docs']:,} documents read, {stats['dropped_docs']:,} dropped")
        for number, (side, path) in enumerate(sides.items()):
            ranked, n = ranked_runs(held, side == "val")
            docs = placed(ranked, n, chosen.shuffle, chosen.shuffle_seed, number)
            starts = shard_starts(docs, shard_tokens)
            n_bytes = 2 * (ranked.agg(F.coalesce(F.sum(F.col("n_tokens") + 2), F.lit(0))).first()[0])
            header = {"tokenizer": spec.as_dict(), "source": source, "selection": {**vars(chosen), "part": side}, "filter_stats": stats}
            sharded = cut_into_shards(docs, starts, n, n_bytes, chosen.shuffle_seed is not None)
            found[side] = write_cache(sharded, path, header, Path(encode.path).read_bytes() if encode.path else None)
            log(f"{side}: {found[side]['docs']:,} documents, {found[side]['tokens']:,} tokens in {len(found[side]['shards'])} shards")
    finally:
        storage.remove(held_in)
    return found["train"]


def stored(spark: SparkSession, path: str | Path) -> DataFrame:
    """(ord, tokens as cells, n_tokens, n_bytes, shard) of a cache; what it holds must match its manifest. n_tokens are those of the text."""
    said = manifest(path)
    if said["format"] != FORMAT:
        raise ValueError(f"{path} has the format {said['format']!r}")
    docs = spark.read.schema(STORED).parquet(storage.child(path, said["rows"]))
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n_tokens") + 2), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.min("n_tokens"), F.lit(0))).first()
    if tuple(row)[:3] != (said["docs"], said["tokens"], said["text_bytes"]) or row[3] < 0:
        raise ValueError(f"{path} doesn't match its manifest")
    return docs


def load(spark: SparkSession, path: str | Path) -> DataFrame:
    """(ord, shard, tokens, n_bytes) of a cache, tokens as arrays of ids."""
    return stored(spark, path).select("ord", "shard", unpacked("tokens").alias("tokens"), "n_bytes")


def open_documents(spark: SparkSession, path: str | Path, tokenizer: str = "bytes", specials: tuple[int, int, int] | None = None, budget: int | None = None) -> tuple[DataFrame, dict]:
    """Documents (ord, tokens, n_bytes) and the tokenizer they are in: that of a cache's manifest, else the one named.

    budget: loss tokens; documents until it is used up, with the one that crosses it. Of a source
    that is tokenized here into bytes, only the files that hold the budget are read.
    """
    from inkwell.operators.prefix import within_budget

    if is_cache(path):
        docs, spec = load(spark, path).select("ord", "tokens", "n_bytes"), manifest(path)["tokenizer"]
    else:
        encode = find_encoder(tokenizer, specials)
        spec = encode.spec.as_dict()
        part = read_within(spark, path, budget) if budget is not None and tokenizer == "bytes" else read_source(spark, str(path))
        docs = kept_documents(part, encode)[1].select("ord", "tokens", "n_bytes")
    if budget is None:
        return docs, spec
    return within_budget(docs.withColumn("__cost", F.size("tokens").cast("long") - 1), "__cost", budget).drop("__cost"), spec


def read_documents(spark: SparkSession, path: str | Path, tokenizer: str = "bytes", specials: tuple[int, int, int] | None = None, budget: int | None = None) -> DataFrame:
    """(ord, tokens, n_bytes) of a cache, or of JSON lines or Parquet tokenized here."""
    return open_documents(spark, path, tokenizer, specials, budget)[0]


def export_shards(spark: SparkSession, path: str | Path, out: str | Path) -> None:
    """Each shard of a cache as flat files, whole shards at once (``sources.flat_shards``). The folder must be one that all machines mount."""
    register(spark)
    shards = len(manifest(path)["shards"])
    rows = stored(spark, path).select("ord", "shard", "tokens", "n_bytes").repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", "ord")
    rows.write.format(FLAT).mode("append").save(storage.mounted(out))


def load_shards(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(ord, shard, tokens, n_bytes) of flat shards, as ``load`` gives them of a cache."""
    register(spark)
    return spark.read.format(FLAT).load(storage.mounted(folder)).select("ord", "shard", unpacked("tokens").alias("tokens"), "n_bytes")
