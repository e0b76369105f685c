"""Product codes of vectors: a codebook for each part, trained by Lloyd rounds with Yinyang bounds.

Components become integers, floor(x * ``UNIT``), and vectors are cut into equal consecutive parts.
A part position's codebook begins as the parts of the smallest ids; each round assigns every part to its
nearest entry (squared distance, ties to the lower index) and moves each entry to the floor of its
parts' mean. Everything that decides is an integer, so results don't depend on
partitions.

A codebook's entries are clustered into groups once. Every part keeps its entry and, for each group, a
lower bound on the distance to the group's entries other than its own. When entries have
moved, a group's bound falls by the group's largest move; the distance to the own entry is computed anew. A
group whose bound is still above it can't hold a nearer entry and is passed over; the others are
scanned whole, in integers. Bounds are floats that are rounded down, and one that is equal or near equal fails,
so ties are always settled by integers.

A round is one pass from one written table to the next: a row has its vector, entries and bounds; tasks
add a row with their sums, so the means come from what was committed. The table before is
removed. The driver has the codebooks and 1 number per entry and position.

Defined cases: a null vector, one with a null or non-finite component, and one whose length
isn't that of the smallest id's kept vector (or can't be cut into the parts) is left out; of fewer
vectors than entries, codebooks have as many entries as vectors. Integers beyond ``LARGEST`` are
taken as that, so that distances fit 64 bits. A null id comes last in the order of ids; equal ids are ordered by
their vectors; repeated rows are coded alike, each for itself. No vectors give an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.shared import discard, materialize, table, trim

UNIT = 4096
LARGEST = 1 << 27
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Entries that a group has, about.
GROUP_ENTRIES = 4
#: What a bound must be above a distance by, as a share: doubles of both are exact to 2^-50.
SLACK = 2.0**-40
#: Salts over which a label's sum is dealt out for the join.
SALTS = 64


@dataclass
class Codebooks:
    """entries: (parts, entries, width) integers; groups: (parts, entries) the group of each entry; drift: (parts, groups) what bounds fall by."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    @property
    def n_groups(self) -> int:
        return self.drift.shape[1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def grouped(entries: np.ndarray, group_entries: int = GROUP_ENTRIES, rounds: int = 5) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries themselves, from entries far apart."""
    parts, k, _ = entries.shape
    n = max(1, -(-k // group_entries))
    out = np.zeros((parts, k), np.int64)
    for p in range(parts):
        points = entries[p].astype(float)
        chosen = [0]
        while len(chosen) < n:
            away = np.min([((points - points[c]) ** 2).sum(1) for c in chosen], axis=0)
            chosen.append(int(away.argmax()))
        centres = points[chosen]
        for _ in range(rounds):
            nearest = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([points[nearest == g].mean(0) if (nearest == g).any() else centres[g] for g in range(n)])
        out[p] = nearest
    return out


def assign(vectors: np.ndarray, own: np.ndarray, lower: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entries, squared distances, lower bounds, scanned distances) of vectors (n, parts, width), with entries and bounds of the round before."""
    n, parts, _ = vectors.shape
    codes, errors = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    bounds, scanned = np.empty((n, parts, books.n_groups), np.float64), 0
    rows = np.arange(n)
    for p in range(parts):
        v, book, group = vectors[:, p], books.entries[p], books.groups[p]
        began = own[:, p]
        own_distance = ((v - book[began]) ** 2).sum(1)
        best, nearest = own_distance.copy(), began.copy()
        upper = np.sqrt(own_distance.astype(float)) * (1 + SLACK)
        low = np.maximum(lower[:, p] - books.drift[p], 0)
        for g in range(books.n_groups):
            members = np.flatnonzero(group == g)
            at = np.flatnonzero(low[:, g] <= upper)
            if not len(members):
                low[:, g] = np.inf
                continue
            if not len(at):
                continue
            distances = ((v[at, None] - book[members][None]) ** 2).sum(2)
            scanned += distances.size
            # the least of the group, of equal ones the first: members are in order of their indexes
            first = distances.argmin(1)
            least = distances[np.arange(len(at)), first]
            better = (least < best[at]) | ((least == best[at]) & (members[first] < nearest[at]))
            # the bound leaves out the entry that the part has for now; those that it loses later are put back below
            others = distances.astype(float)
            others[members[None, :] == began[at, None]] = np.inf
            low[at, g] = np.sqrt(others.min(1)) * (1 - SLACK)
            best[at[better]], nearest[at[better]] = least[better], members[first[better]]
        moved = np.flatnonzero(nearest != began)
        if len(moved):
            # groups of entries that parts have won: the bound may be that entry's own distance, which stays a lower bound
            lost = group[began[moved]]
            low[moved, lost] = np.minimum(low[moved, lost], np.sqrt(own_distance[moved].astype(float)) * (1 - SLACK))
        codes[:, p], errors[:, p], bounds[:, p] = nearest, best, low
    return codes, errors, bounds, scanned


def _integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * UNIT), -LARGEST, LARGEST).astype(np.int64)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(values: np.ndarray, type_: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(np.ascontiguousarray(values).ravel(), type_))


STATE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("label", T.LongType()),
        T.StructField("vector", T.ArrayType(T.IntegerType(), False)),
        T.StructField("codes", T.ArrayType(T.IntegerType(), False)),
        T.StructField("bounds", T.ArrayType(T.FloatType(), False)),
        T.StructField("error", T.LongType()),
        T.StructField("sums", T.ArrayType(T.LongType(), False)),
    ]
)


def _round(books: Codebooks, width: int) -> Callable:
    """One pass over written rows: entries, bounds and errors anew; and at a task's end a row with its sums, counts and scanned distances."""

    def run(batches):
        parts, k, w = books.entries.shape
        sums, counts, scanned, seen = np.zeros((parts, k, w), np.int64), np.zeros((parts, k), np.int64), 0, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            seen = True
            vectors = _numbers(batch.column("vector"), width).astype(np.int64).reshape(n, parts, w)
            own = _numbers(batch.column("codes"), parts).astype(np.int64)
            lower = _numbers(batch.column("bounds"), parts * books.n_groups).astype(np.float64).reshape(n, parts, books.n_groups)
            codes, errors, bounds, some = assign(vectors, own, lower, books)
            scanned += some
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=k)
                np.add.at(sums[p], codes[:, p], vectors[:, p])
            kept = bounds.astype(np.float32)
            kept = np.where(kept > bounds, np.nextafter(kept, np.float32(-np.inf)), kept)
            nulls = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("vector"), _lists(codes, pa.int32()), _lists(kept.reshape(n, -1), pa.float32()), pa.array(errors.sum(1)), nulls], names=STATE.names)
        if seen:
            flat = np.concatenate([sums.ravel(), counts.ravel(), [scanned]])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.list_(t)) for t in (pa.int32(), pa.int32(), pa.float32())), pa.nulls(1, pa.int64()), _lists(flat[None], pa.int64())], names=STATE.names)
        trim()

    return run


def _prepared(rows: DataFrame, parts: int) -> DataFrame:
    """(id, label, vector) as integers, of vectors that are whole."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                held = batch.column("vector")
                flat = _integers(held.flatten().to_numpy(zero_copy_only=False))
                vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), vectors], names=["id", "label", "vector"])

    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.where(F.col("vector").isNotNull() & F.forall("vector", finite) & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    return kept.mapInArrow(run, "id long, label long, vector array<int>")


def _totals(state: DataFrame) -> np.ndarray:
    """Sums of the tasks' rows, by place."""
    placed = state.where(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("at", "x"))
    found = placed.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = np.empty(len(found), object)
    for r in found:
        out[r["at"]] = int(Decimal(r["x"]))
    return out


def _moved(books: Codebooks, totals: np.ndarray) -> Codebooks:
    parts, k, w = books.entries.shape
    sums, counts = totals[: parts * k * w].reshape(parts, k, w), totals[parts * k * w : parts * k * (w + 1)].reshape(parts, k)
    entries = books.entries.copy()
    for p in range(parts):
        for e in range(k):
            if counts[p, e]:
                entries[p, e] = [int(s) // int(counts[p, e]) for s in sums[p, e]]
    moves = np.sqrt(((entries - books.entries) ** 2).sum(2).astype(float)) * (1 + SLACK)
    drift = np.stack([np.array([moves[p][books.groups[p] == g].max(initial=0.0) for g in range(books.n_groups)]) for p in range(parts)])
    return Codebooks(entries, books.groups, drift)


@dataclass
class Coded:
    """rows: (id, label, codes, error); books: the last entries; scanned: distances to groups that each pass computed."""

    rows: DataFrame
    books: Codebooks | None
    scanned: list[int]


def coded(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, group_entries: int = GROUP_ENTRIES) -> Coded:
    """Codebooks trained on all vectors, and every vector's codes."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    prepared = materialize(_prepared(given, parts), "vectors")
    first = prepared.orderBy(F.col("id").asc_nulls_last(), "vector", F.col("label").asc_nulls_last()).limit(1).collect()
    if not first:
        return Coded(prepared.select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")), None, [])
    width = len(first[0]["vector"])
    same = prepared.where(F.size("vector") == width)
    begun = np.array([r["vector"] for r in same.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()], np.int64)
    book = begun.reshape(len(begun), parts, width // parts).transpose(1, 0, 2).copy()
    groups = grouped(book, group_entries)
    books = Codebooks(book, groups, np.zeros((parts, int(groups.max()) + 1)))
    # nothing is known yet: bounds of 0 let every group be scanned
    zeros = lambda n, kind: F.array_repeat(F.lit(0).cast(kind), n)
    state, before, scanned = same.withColumns({"codes": zeros(parts, "int"), "bounds": zeros(parts * books.n_groups, "float")}), prepared, []
    for i in range(rounds + 1):
        passed = materialize(state.select("id", "label", "vector", "codes", "bounds").mapInArrow(_round(books, width), STATE), "coded")
        discard(before)
        totals = _totals(passed)
        scanned.append(int(totals[-1]))
        if i < rounds:
            books = _moved(books, totals)
        state, before = passed.where(F.col("sums").isNull()), passed
    return Coded(state.select("id", "label", "codes", "error"), books, scanned)


def label_errors(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds label_error, the errors of equal labels together, nulls too; a label's rows meet its sum in ``salts`` places."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    dealt = sums.select(F.struct("label").alias("__label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    salted = rows.withColumn("__key", F.struct("label")).withColumn("__own", F.pmod(F.xxhash64("id", "codes"), F.lit(salts)).cast("int"))
    joined = salted.join(dealt.hint("merge"), (F.col("__key") == F.col("__label")) & (F.col("__own") == F.col("__salt")))
    return joined.drop("__key", "__own", "__label", "__salt")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coded(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    digits = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    sha = found.books.sha256() if found.books else None
    out = label_errors(found.rows).select(F.col("id").alias("vec_id"), digits.alias("code"), "error", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(sha).cast("string"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Plain Lloyd rounds in DuckDB's SQL."""
    steps = [
        "WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS v FROM kept, (SELECT unnest(range({parts})) AS p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries})",
        "book0 AS MATERIALIZED (SELECT p, e, v AS c FROM cut JOIN first USING (vec_id))",
    ]
    for i in range(rounds + 1):
        steps.append(f"near{i} AS MATERIALIZED (SELECT vec_id, p, min(list_value(d, e)) AS de FROM (SELECT vec_id, p, e, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cut JOIN book{i} USING (p)) GROUP BY vec_id, p)")
        if i < rounds:
            steps.append(
                f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, de[2] AS e, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM "
                f"(SELECT p, de, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, list_value(0, de[2]) AS de, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM near{i} JOIN cut USING (vec_id, p)) GROUP BY p, de, j)) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"
            )
    steps.append(f"codes AS (SELECT vec_id, string_agg(lpad(lower(hex(de[2])), 2, '0'), '' ORDER BY p) AS code, CAST(sum(de[1]) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)")
    steps.append(f"sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), sha"


OP11_SQL = oracle_sql()
