"""Near copies by Jaccard index of word shingles, confirmed on whole shingle sets.

A text's words (ASCII lower case, ended by ASCII white space) make five-word shingles; fewer
words make one. Two texts link if the Jaccard index of their sets of shingle hashes is at least
``LEAST``, which is worked out from all shingles of both. Candidates come from two families of
tables. SimHash: the set's fingerprint of 64 bits, by the covering masks of ``simhash``, so that texts within
``RADIUS`` bits always meet. Minimum hashes: ``BANDS`` tables, each keyed by ``ROWS`` of them; two texts of Jaccard
index j meet in none of these with a chance of (1 - j^ROWS)^BANDS, which is 0.00006 at 0.8 and less
above. That is the most of the links that may not be seen.

Texts with equal sets are joined before any search. Buckets with the same members count once. A
bucket of over ``BLOCK`` shingles is dealt out as pairs of blocks, each pair a bucket of its own;
it yields a spanning forest of its links, never all pairs. Only texts of shared buckets have their
sets sent there. Components of the forests are found by star contraction.

SimHash alone can't give this: five-word shingles at an index of 0.8 turn 10 of 64 bits, beyond what
covering masks of 64 bits reach. The README has figures.

Defined cases: null and empty texts and those of white space only have the empty set and are
copies of each other; a very long text has all its shingles, and its set is one value in a bucket;
repeated rows are copies; rows that tie in all columns are told apart by their place; a null id loses to any other; an empty table gives
an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.components import components
from inkwell.llm.shared import materialize, passing, trim
from inkwell.llm.simhash import covering_masks

LEAST = 0.8
WORDS = 5
SEED = 42
BANDS, ROWS = 32, 6
#: Bits by which fingerprints may differ that the covering masks bring together.
RADIUS = 4
_MASKS = np.array(covering_masks(RADIUS), np.int64).view(np.uint64)
#: Shingles that one block of a bucket has on average, at most.
BLOCK = 1 << 19


def _numbers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed numbers for the hash functions, the same in every process."""
    drawn = np.array([[xxhash.xxh64_intdigest(f"{k}:{i}", SEED) for i in range(BANDS * ROWS)] for k in range(3)], np.uint64)
    return drawn[0][:, None], (drawn[1] | np.uint64(1))[:, None], (drawn[2] | np.uint64(1)).reshape(BANDS, ROWS)


_FLIP, _TIMES, _MIX = _numbers()


def shingles(text: str | None, words_each: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    hashes = (digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[words_each:]))
    return np.unique(np.fromiter(hashes, np.uint64, len(words) - words_each + 1))


def signature(found: np.ndarray) -> np.ndarray:
    """Of a set: its hash, its size and the keys of all tables; the empty set has no keys."""
    head = np.array([xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED), len(found)], np.uint64)
    if not len(found):
        return head.view(np.int64)
    least, ones = np.full(BANDS * ROWS, ~np.uint64(0)), np.zeros(64, np.int64)
    for i in range(0, len(found), 2048):
        some = found[i : i + 2048]
        np.minimum(least, ((some ^ _FLIP) * _TIMES).min(1), out=least)
        ones += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    printed = np.packbits(ones * 2 > len(found), bitorder="little").view("<u8").astype(np.uint64)
    return np.concatenate([head, (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64), printed & _MASKS]).view(np.int64)


def forest(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges, as places in the list, of a spanning forest of the links among sets: a search that compares each reached one with those not yet reached."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left, edges, has = np.arange(len(sets)), [], np.zeros(len(values), bool)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            own = flat[starts[x] : starts[x] + sizes[x]]
            near = np.minimum(sizes[left], sizes[x]) >= least * np.maximum(sizes[left], sizes[x])
            has[own] = True
            for k in np.flatnonzero(near):
                y = left[k]
                both = np.count_nonzero(has[flat[starts[y] : starts[y] + sizes[y]]])
                near[k] = both >= least * (sizes[x] + sizes[y] - both)
            has[own] = False
            if near.any():
                found = left[near]
                edges += [(x, y) for y in found]
                queue.extend(found)
                left = left[~near]
    return edges


def _sets(batches, words_each):
    for batch in batches:
        found = [shingles(x.as_py(), words_each).astype("<u8").tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["fp", "hashes"])
        del found
        trim()


def _links(batches, least):
    """Rows sorted by bucket come in; the forests' edges go out. A bucket may go on in the next batch."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held_key, fps, sets = None, [], []

    def out():
        edges = forest(sets, least) if len(sets) > 1 else []
        return [(fps[i], fps[j]) for i, j in edges]

    for batch in batches:
        edges = []
        keys = zip(*[batch.column(i).to_pylist() for i in range(4)])
        for key, fp, hashes in zip(keys, batch.column(4).to_pylist(), batch.column(5)):
            if key != held_key:
                edges += out()
                held_key, fps, sets = key, [], []
            fps.append(fp)
            sets.append(np.frombuffer(hashes.as_py(), "<u8"))
        if edges:
            yield pa.RecordBatch.from_pydict({"u": [u for u, _ in edges], "v": [v for _, v in edges]}, schema=schema)
    if edges := out():
        yield pa.RecordBatch.from_pydict({"u": [u for u, _ in edges], "v": [v for _, v in edges]}, schema=schema)
    fps, sets = [], []
    trim()


def links(rows: DataFrame, distinct: DataFrame, least: float = LEAST, words_each: int = WORDS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that join the sets of ``distinct(fp, first, size, keys)`` as all links do; texts come from ``rows(file, at, text)``; written."""
    keyed = distinct.select("fp", "size", F.posexplode("keys").alias("tab", "key"))
    members = [F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor(F.xxhash64("fp")).alias("mark"), F.sum("size").alias("total")]
    buckets = keyed.groupBy("tab", "key").agg(*members).where("n > 1")
    once = buckets.groupBy("n", "lo", "hi", "mark", "total").agg(F.min(F.struct("tab", "key")).alias("at"))
    parts = F.least(F.ceil(F.col("total") / F.lit(block)), F.col("n")).cast("int").alias("parts")
    once = materialize(once.select("at.tab", "at.key", parts), "buckets")
    shared = materialize(keyed.join(once, ["tab", "key"]).select("tab", "key", "parts", "fp"), "shared")
    wanted = materialize(shared.select("fp").distinct().join(distinct.select("fp", "first.file", "first.at"), "fp"), "wanted")
    # a merge at every size: wanted texts grow with the rows
    texts = rows.hint("merge").join(wanted, ["file", "at"]).select("fp", "text")
    sets = materialize(texts.mapInArrow(partial(_sets, words_each=words_each), "fp long, hashes binary"), "sets")
    own = shared.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("tab", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp").join(sets, "fp")
    dealt = dealt.select("tab", "key", "lo", "hi", "fp", "hashes").repartition("tab", "key", "lo", "hi").sortWithinPartitions("tab", "key", "lo", "hi")
    return materialize(dealt.mapInArrow(partial(_links, least=least), "u long, v long").distinct(), "links")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST, words_each: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row of each component with all its columns: that of the least id (nulls last), of equal ids the least by hash."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def signed(texts: pa.Array) -> pa.Array:
        found = pa.array([signature(shingles(x.as_py(), words_each)) for x in texts], pa.list_(pa.int64()))
        trim()
        return found

    names = docs.columns
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    other = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != text_column]))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_column}`").alias("id"), signed(text).alias("signature"), F.xxhash64(F.col(f"`{text_column}`"), other).alias("mark"))
    rows = materialize(rows, "rows").withColumns({"file": F.col("_metadata.file_name"), "at": F.col("_metadata.row_index")})
    # rows that are equal in all columns tie up to their place in the written table, which tells them apart
    order = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "file", "at")
    by_set = rows.withColumn("fp", F.get("signature", F.lit(0))).groupBy("fp").agg(F.min(order).alias("first"), F.first("signature").alias("signature"))
    keys = F.slice("signature", 3, BANDS + len(_MASKS))
    with passing(docs.sparkSession) as keep:
        distinct = materialize(by_set.select("fp", "first", F.get("signature", F.lit(1)).alias("size"), keys.alias("keys")), "distinct")
        texts = rows.select("file", "at", F.col("row").getField(text_column).cast("string").alias("text"))
        roots = components(links(texts, distinct, least, words_each, block)).withColumnRenamed("node", "fp")
        labelled = distinct.select("fp", "first").join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
        winners = labelled.groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.at")
        winners = keep(materialize(winners, "winners"))
    # a merge at every size: winners grow with the rows
    return rows.hint("merge").join(winners, ["file", "at"], "left_semi").select("row.*")
