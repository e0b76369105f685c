"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles.
Fingerprints link at ``radius`` or fewer differing bits. Candidates come from 2^(radius+1)-2
tables: each bit position has a vector of radius+1 bits, and table v keeps the positions whose
vector has an odd product with v. At most ``radius`` differing positions span too little to
meet every v oddly, so in some table all of them are masked and the pair collides there: no
linked pair is missed. A table keeps half of the bits.

Copies share a fingerprint and are joined before any search, so all work is on distinct
fingerprints. A bucket of a table yields a spanning forest of the links inside it, never all
pairs. A bucket of over ``BLOCK`` fingerprints is dealt out as pairs of blocks, each pair a
bucket of its own. Components of the forests are found by star contraction.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and
links like any other; a very long text is read whole; a bit that half of the hashes have is 0; fewer words than a shingle make one shingle; repeated rows get a row
each; a null id is in its component but never its name, and a component of null ids alone has
a null name; an empty table gives an empty result; other columns are ignored whatever their
names.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.components import components
from inkwell.llm.shared import materialize, passing, table, trim

RADIUS = 4
WORDS = 4
SEED = 42
#: Distinct fingerprints that one block of a bucket has on average, at most.
BLOCK = 8192
#: Rows of the covering tables that one task makes.
ROWS_PER_TASK = 4_000_000
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, words_each: int = WORDS, seed: int = SEED) -> int:
    """Of a whole text, as an unsigned 64-bit number. Only A-Z are lower-cased; words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return digest(joined, seed)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = len(words) - words_each + 1
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words_each:])), "<u8", n)
    counts = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches, words_each):
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py(), words_each) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_each: int = WORDS) -> DataFrame:
    """(id, fp) of each row; fp holds the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(partial(_fingerprints, words_each=words_each), schema)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bits that each table keeps, as signed longs.

    All positions' vectors have the first bit, so that each table keeps half of the bits; the
    one table that would keep all of them finds equal fingerprints alone and is left out.
    """
    if not 0 < radius <= 6:
        raise ValueError("the radius must be from 1 to 6: beyond, 64 bits leave tables too little")
    vectors = [(1 << radius) + i % (1 << radius) for i in range(bits)]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        if mask != (1 << bits) - 1:
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints: a search that compares each reached one with those not yet reached."""
    left, edges = np.sort(fps), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                edges += [(x, y) for y in found]
                queue.extend(found)
                left = left[~near]
    return edges


def _links(batches, radius):
    """Rows sorted by bucket come in; the forests' edges go out. A bucket may go on in the next batch."""
    held_keys, held = None, []
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def out(edges):
        a = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
        fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
        edges = []
        if held_keys is not None and (held_keys != keys[0]).any():
            edges += forest(np.concatenate(held), radius)
            held = []
        for i, (a, b) in enumerate(zip(begins, ends)):
            if i == len(begins) - 1:  # may go on
                held_keys = keys[a]
                held = [*(held if i == 0 else []), fps[a:b].copy()]
            elif i == 0 and held:
                edges += forest(np.concatenate([*held, fps[a:b]]), radius)
                held = []
            elif b - a == 2:
                if int(fps[a] ^ fps[a + 1]).bit_count() <= radius:
                    edges.append((fps[a], fps[a + 1]))
            elif b - a > 2:
                edges += forest(fps[a:b], radius)
        if edges:
            yield out(edges)
    if held:
        yield out(forest(np.concatenate(held), radius))


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that join the distinct fingerprints ``fp`` of a written table as all links do; written.

    A fingerprint is a row in each table. One shuffle brings the rows of a bucket together and
    counts them; singletons, nearly all, end there. Only a bucket of over ``block`` rows is dealt anew.
    """
    spark, kept = distinct.sparkSession, covering_masks(radius)
    masks = F.array(*[F.lit(m) for m in kept])
    rows = distinct.agg(F.count(F.lit(1))).first()[0]
    spread = max(spark.sparkContext.defaultParallelism, rows * len(kept) // ROWS_PER_TASK)
    keyed = distinct.select("fp").repartition(spread).select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("tab", "key"))
    own = Window.partitionBy("tab", "key")
    shared = keyed.withColumn("n", F.count(F.lit(1)).over(own)).where("n > 1")
    shared = materialize(shared.withColumn("parts", F.ceil(F.col("n") / F.lit(block)).cast("int")).select("tab", "key", "fp", "parts"), "buckets")
    dealt = shared.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("tab", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    dealt = dealt.repartition("tab", "key", "lo", "hi").sortWithinPartitions("tab", "key", "lo", "hi")
    return materialize(dealt.mapInArrow(partial(_links, radius=radius), "u long, v long").distinct(), "links")


def classes(found: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, root) of every distinct fp of the written table ``found(id, fp)``; root is the least fp, as a signed long, that it reaches."""
    distinct = materialize(found.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    roots = components(links(distinct, radius, block)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, words_each: int = WORDS, block: int = BLOCK) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id of each row."""
    found = materialize(fingerprints(docs, id_column, text_column, words_each), "fingerprints")
    with passing(docs.sparkSession) as keep:
        labelled = materialize(classes(found, radius, block), "classes")
        names = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
        named = keep(materialize(labelled.join(names, "root").select("fp", "component_id"), "named"))
    out = found.join(named, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out.withColumnRenamed("id", id_column)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = 6, words_each: int = 5, block: int = BLOCK) -> DataFrame:
    """One row of each component with all its columns: that of the least id (nulls last), of equal ids the least by hash."""

    @F.arrow_udf(T.LongType())
    def printed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(x.as_py(), words_each) for x in texts), np.uint64, len(texts)).view(np.int64)
        trim()
        return pa.array(found, pa.int64())

    names = docs.columns
    other = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != text_column]))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_column}`").alias("id"), printed(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("fp"), F.xxhash64(text_column, other).alias("mark"))
    rows = materialize(rows, "rows").withColumns({"file": F.col("_metadata.file_name"), "at": F.col("_metadata.row_index")})
    # rows that are equal in all columns tie up to their place in the written table, which tells them apart
    order = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "file", "at")
    with passing(docs.sparkSession) as keep:
        labelled = materialize(classes(rows.select("id", "fp"), radius, block).select("fp", "root"), "classes")
        firsts = rows.groupBy("fp").agg(F.min(order).alias("first"))
        winners = firsts.join(labelled, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.at")
        winners = keep(materialize(winners, "winners"))
    # a merge at every size: winners grow with the rows
    return rows.hint("merge").join(winners, ["file", "at"], "left_semi").select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
