"""Hashed terms of whole texts, the bounded labelled sample that a classifier is fitted on, and sparse weights.

Slots are kept by frequency alone: those that at least ``LEAST_ROWS`` rows of the sample have. A
model is fitted over all of them, with a penalty on absolute weights that leaves most at zero
(``sparse_weights``); no slot is judged by its own share among labels.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash slots.
BITS = 22
#: Labelled rows that a model is fitted on, at most; those with the smallest hashes of their ids.
SAMPLE_ROWS = 12_000
#: Rows of the sample that a kept slot is in, at least.
LEAST_ROWS = 3
#: Entries of the sample that a step over it takes at once; bounds memory, not results.
ENTRIES_AT_ONCE = 1 << 20
#: Entries of a worker's table of tokens before it is emptied; bounds memory, not results.
TABLE_ENTRIES = 200_000
_WORD = re.compile(r"[^\W_]+")
_SHAPES = ((re.compile(r"\d+"), "0"), (re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


def slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def word_terms(token: str) -> set[int]:
    """Lower-case words of a token, and the beginnings that inflected words share."""
    out = set()
    for word in _WORD.findall(token.lower()):
        out.add(slot(f"w{word}"))
        for n in (4, 5, 7):
            if len(word) > n:
                out.add(slot(f"{n}{word[:n]}"))
    return out


def style_terms(token: str) -> set[int]:
    """Lower-case words of a token, and its shape: case, digits and punctuation."""
    shape = token
    for pattern, to in _SHAPES:
        shape = pattern.sub(to, shape)
    return {slot(f"w{word}") for word in _WORD.findall(token.lower())} | {slot(f"s{shape[:40]}")}


#: Stands for a token that equals the one before it.
REPEAT = slot("=repeat")
TERMS = {"words": word_terms, "style": style_terms}
#: Kinds whose models need how many tokens have a slot; the others take 1.
COUNTED = {"style"}


class Columns(dict):
    """From token to the columns of its terms that a model keeps; each token is hashed once while it is in the table."""

    def __init__(self, kind: str, kept: np.ndarray):
        self.terms, self.at = TERMS[kind], {int(s): i for i, s in enumerate(kept)}

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > TABLE_ENTRIES:
            self.clear()
        at = self.at
        found = self[token] = tuple(at[s] for s in self.terms(token) if s in at)
        return found


_COLUMNS: dict[tuple, Columns] = {}


def columns(kind: str, kept: np.ndarray) -> Columns:
    """The worker's table for a model; it lasts from task to task."""
    key = (kind, kept.tobytes())
    if key not in _COLUMNS:
        _COLUMNS.clear()
        _COLUMNS[key] = Columns(kind, kept)
    return _COLUMNS[key]


def all_slots(text: str, kind: str) -> dict[int, int]:
    """Every slot of a text and how many of its tokens have it."""
    tokens = text.split()
    out: Counter = Counter()
    for token, n in Counter(tokens).items():
        for s in TERMS[kind](token):
            out[s] += n
    if repeats := sum(map(str.__eq__, tokens, tokens[1:])):
        out[REPEAT] += repeats
    return out


def _sample(batches, kind):
    for batch in batches:
        slots, counts, sizes = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            found = all_slots(text, kind)
            slots.append(np.fromiter(found.keys(), np.int32, len(found)))
            counts.append(np.fromiter(found.values(), np.int32, len(found)) if kind in COUNTED else [])
            sizes.append(len(text.split()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], names=["label", "slots", "counts", "n_words"])


def held_out(id_column: str) -> F.Column:
    """Whether the id's crc32, as text, leaves 2 by 4; such rows are never learned from. A null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(4)) == 2, F.lit(False))


class Sample:
    """Labels and hashed terms of the sample, as rows of a sparse matrix."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label_column: str, kind: str, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text"):
        """Rows of labels with an id and a label; where an id has several labels, their mean, rounded to even.

        Of ids with several texts the smallest text counts. The chosen labels are at
        most ``rows`` small rows, which are broadcast.
        """
        chosen = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("label")).dropna().where(~held_out("id")).groupBy("id").agg(F.bround(F.avg("label")).cast("int").alias("label"))
        chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows)
        texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
        joined = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
        schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("n_words", T.LongType()), T.StructField("id", joined.schema["id"].dataType)])
        found = joined.select("label", "text", "id").mapInArrow(partial(_sample_with_id, kind=kind), schema).toArrow().sort_by("id")
        self.labels = found.column("label").to_numpy().astype(np.int64)
        n_words = found.column("n_words").to_numpy().astype(np.float32)
        lengths = pc.list_value_length(found.column("slots")).to_numpy()
        flat = lambda name: pc.list_flatten(found.column(name)).to_numpy().copy() if found.num_rows else np.zeros(0, np.int32)
        slots = flat("slots")
        counts = flat("counts") if kind in COUNTED else None
        del found
        pa.default_memory_pool().release_unused()
        #: Slots kept by frequency, in order; columns of the matrix are their places.
        self.slots = np.flatnonzero(np.bincount(slots, minlength=1 << BITS) >= LEAST_ROWS)
        at = np.full(1 << BITS, -1, np.int32)
        at[self.slots] = np.arange(len(self.slots), dtype=np.int32)
        column = at[slots]
        del slots, at
        row = np.repeat(np.arange(len(self.labels), dtype=np.int32), lengths)
        kept = column >= 0
        values = np.ones(int(kept.sum()), np.float32) if counts is None else np.sqrt(counts[kept] / np.maximum(1, n_words[row[kept]])).astype(np.float32)
        self.matrix = Matrix(row[kept], column[kept], values, len(self.labels), len(self.slots))


    def rows(self, chosen: np.ndarray) -> Sample:
        """The sample of these rows alone, with the same slots; for cross-validation."""
        out = object.__new__(Sample)
        out.labels, out.slots = self.labels[chosen], self.slots
        at = np.full(len(self.labels), -1, np.int32)
        at[chosen] = np.arange(len(chosen), dtype=np.int32)
        m = self.matrix
        kept = at[m.row] >= 0
        out.matrix = Matrix(at[m.row[kept]], m.column[kept], m.value[kept], len(chosen), m.k)
        return out


class Matrix:
    """A sparse matrix by row: entries (row, column, value), rows in order."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, k: int):
        self.row, self.column, self.value, self.n, self.k = row, column, value, n, k

    def _blocks(self):
        for lo in range(0, len(self.row), ENTRIES_AT_ONCE):
            part = slice(lo, lo + ENTRIES_AT_ONCE)
            yield self.row[part], self.column[part], self.value[part]

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Of each row, the sum of weights times values."""
        return sum((np.bincount(r, v * weights[c], self.n) for r, c, v in self._blocks()), np.zeros(self.n))

    def onto(self, rows: np.ndarray) -> np.ndarray:
        """Of each column, the sum of its rows' numbers times values."""
        return sum((np.bincount(c, v * rows[r], self.k) for r, c, v in self._blocks()), np.zeros(self.k))

    def norms(self) -> np.ndarray:
        return np.sqrt(sum((np.bincount(c, v * v, self.k) for _, c, v in self._blocks()), np.zeros(self.k)))

    def only(self, columns: np.ndarray) -> Matrix:
        """The matrix of these columns, in their order."""
        at = np.full(self.k, -1, np.int32)
        at[columns] = np.arange(len(columns), dtype=np.int32)
        found = at[self.column]
        kept = found >= 0
        return Matrix(self.row[kept], found[kept], self.value[kept], self.n, len(columns))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def slopes(scale: np.ndarray, thresholds: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of minus the log likelihood of cumulative links: by each row's scale, and by each threshold.

    P(grade = k) = F(upper - scale) - F(lower - scale), F the sigmoid, between the
    thresholds below and above; outside them F is 0 and 1.
    """
    n, each = len(scale), np.arange(len(scale))
    f = np.column_stack([np.zeros(n), sigmoid(thresholds[None, :] - scale[:, None]), np.ones(n)])
    rise = f * (1 - f)
    p = np.maximum(f[each, grade + 1] - f[each, grade], 1e-12)
    up, low = rise[each, grade + 1] / p, rise[each, grade] / p
    by_edge = np.bincount(grade, low, len(thresholds) + 2) - np.bincount(grade + 1, up, len(thresholds) + 2)
    return up - low, by_edge[1:-1]


def null_thresholds(grade: np.ndarray, cuts: int) -> np.ndarray:
    """Those that give each grade its share where all scales are zero."""
    share = np.array([(grade <= k).mean() for k in range(cuts)])
    return np.log(share / (1 - share))


def sparse_weights(matrix: Matrix, grade: np.ndarray, cuts: int, penalty: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of a cumulative-link model (logistic with one cut) over all columns, most weights zero.

    Minus the log likelihood and a penalty on absolute weights, by accelerated proximal
    steps. A column's penalty is ``penalty`` times the standard error of its slope where all
    weights are zero, so a weight leaves zero if what the others leave unexplained asks for it.
    """
    n, thresholds = matrix.n, null_thresholds(grade, cuts)
    unit = 1 / np.maximum(matrix.norms(), 1e-9)
    cost = penalty * np.sqrt((slopes(np.zeros(n), thresholds, grade)[0] ** 2).mean())
    steepest = 0.25 if cuts == 1 else 0.5  # no row's slope changes faster with its scale
    guess, top = np.random.default_rng(0).normal(size=matrix.k), 1.0
    for _ in range(8):
        guess = unit * matrix.onto(matrix.times(unit * guess / max(np.linalg.norm(guess), 1e-9)))
        top = np.linalg.norm(guess)
    bound = max(1.1 * steepest * top, 1e-9)
    now, ahead, pace = np.zeros(matrix.k), np.zeros(matrix.k), 1.0
    for _ in range(steps):
        by_scale, by_threshold = slopes(matrix.times(unit * ahead), thresholds, grade)
        after = ahead - unit * matrix.onto(by_scale) / bound
        after = np.sign(after) * np.maximum(np.abs(after) - cost / bound, 0)
        thresholds = np.maximum.accumulate(thresholds - by_threshold / (n * steepest) + 1e-6 * np.arange(cuts))
        if ((ahead - after) * (after - now)).sum() > 0:  # past the bottom: no further momentum
            pace, ahead = 1.0, after
        else:
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead, pace = after + (pace - 1) / faster * (after - now), faster
        now = after
    return unit * now, thresholds


def _sample_with_id(batches, kind):
    for batch in batches:
        for out in _sample([batch.select([0, 1])], kind):
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], names=[*out.schema.names, "id"])
