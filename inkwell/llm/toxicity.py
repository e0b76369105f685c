"""Toxicity scores of whole texts by a factorization machine over hashed terms.

A text is the set of its hashed terms that the model keeps. Its logit is a bias, the
weights of these terms, and for each pair of them the product of their factor vectors:
pairs such as an insult beside a group count beyond the sum of the two. The machine is
fitted on a bounded sample of labelled rows (``hashed_text.SAMPLE_ROWS``) on the driver, in three
steps: sparse weights over all slots that enough rows have; of what these leave unexplained, the
pairs of slots that stand out by ``PAIR_Z`` standard errors, whatever either term does alone; and
the machine over the terms with a weight or a pair. A pair's standard error is the greater of that by its rows'
errors and that by the model. So it can stand out by no more than the root of its toxic rows on one side, and
that of its clean rows' summed odds p / (1 - p) on the other: slots below both have no
such pair, and all others are looked at, in blocks.
Scoring is one narrow stage over whole texts.

Defined cases: a null or empty text has no terms and scores the bias alone, as does a text
without any term that the model keeps; a very long text is scored whole; equal texts have equal
scores, and a score equal to the threshold is toxic; repeated rows are scored each; null ids are kept and
never learned from; without any usable label all scores are 0, and with labels of one kind
all scores are that label; an empty table gives an empty result; other columns are ignored
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.hashed_text import SAMPLE_ROWS, Matrix, Sample, columns, held_out, sigmoid, sparse_weights
from inkwell.llm.shared import table, trim

FACTORS = 8
THRESHOLD = 0.3
#: The penalty on a slot's weight, in standard errors of its slope where weights are zero. Chosen by cross-validation on rows that aren't held out.
PENALTY = 4.0
#: Standard errors by which a pair stands out that the terms alone don't explain, at least.
PAIR_Z = 8.0
#: Columns, and rows, of a block in the search for pairs; bounds memory, not results.
PAIR_COLUMNS, PAIR_ROWS = 512, 500


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    kept: np.ndarray

    def score(self, found: list[int]) -> float:
        """Of a text with these columns."""
        logit = self.bias
        if found:
            v = self.factors[found]
            logit += self.weights[found].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
        return float(sigmoid(logit))


def outstanding_pairs(matrix: Matrix, error: np.ndarray, variance: np.ndarray, least_z: float = PAIR_Z) -> np.ndarray:
    """Columns whose joint presence with another goes with the error of a model by more than ``least_z`` standard errors.

    error: a row's label less the model's probability; variance: that probability's own.
    """
    # (sum of e)^2 is at most the rows with e > 0 times the sum of e^2; and at most the sum of p (1 - p) times that of p / (1 - p), where e = -p
    most = np.where(error > 0, 1.0, -error / np.maximum(1 + error, 1e-12))
    ways = [np.bincount(matrix.column, (most * side)[matrix.row], matrix.k) for side in (error > 0, error <= 0)]
    able = np.flatnonzero(np.maximum(*ways) > least_z * least_z)
    x, n = matrix.only(able), len(able)
    bounds = np.searchsorted(x.row, np.arange(0, matrix.n + PAIR_ROWS, PAIR_ROWS))
    weights = [np.asarray(w, np.float32) for w in (error, error * error, variance)]
    out = np.zeros(n, bool)
    for lo in range(0, n, PAIR_COLUMNS):
        hi = min(n, lo + PAIR_COLUMNS)
        sums = [np.zeros((hi - lo, n - lo), np.float32) for _ in weights]  # a pair is looked at once
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            first = i * PAIR_ROWS
            there = np.zeros((min(PAIR_ROWS, matrix.n - first), n - lo), np.float32)
            after = x.column[a:b] >= lo
            there[x.row[a:b][after] - first, x.column[a:b][after] - lo] = 1
            own = there[:, : hi - lo].T
            for held, w in zip(sums, weights):
                held += (own * w[first : first + len(there)]) @ there
        z = np.abs(sums[0]) / np.sqrt(np.maximum(np.maximum(sums[1], sums[2]), 1e-6))
        z[np.arange(hi - lo), np.arange(hi - lo)] = 0
        far = z > least_z
        out[lo:hi] |= far.any(1)
        out[lo:] |= far.any(0)
    return able[out]


def fit(sample: Sample, factors: int = FACTORS, steps: int = 800, rate: float = 0.03, decay: float = 3e-4, batch: int = 512, seed: int = 7, penalty: float = PENALTY, pair_z: float = PAIR_Z) -> Machine:
    """Logistic loss: sparse over all kept slots, then by Adam over seeded batches with factors."""
    y = (sample.labels > 0).astype(float)
    n = len(y)
    if n == 0 or y.min() == y.max():
        return Machine(40.0 if n and y[0] else -40.0, np.zeros(0), np.zeros((0, factors)), np.zeros(0, np.int64))
    weights, thresholds = sparse_weights(sample.matrix, y.astype(np.int64), 1, penalty)
    p = sigmoid(sample.matrix.times(weights) - thresholds[0])
    chosen = np.union1d(np.flatnonzero(weights), outstanding_pairs(sample.matrix, y - p, p * (1 - p), pair_z))
    x = sample.matrix.only(chosen)
    row, column, kept = x.row, x.column.astype(np.int64), sample.slots[chosen]
    bounds = np.searchsorted(row, np.arange(n + 1))
    k, rng = len(kept), np.random.default_rng(seed)
    m = Machine(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(k), rng.normal(0, 0.02, (k, factors)), kept)
    flat = np.concatenate([[m.bias], m.weights, m.factors.ravel()])
    first, second, t = np.zeros_like(flat), np.zeros_like(flat), 0
    there = np.zeros((min(batch, n), k), np.float32)  # a batch as a dense matrix: its products are fast
    while t < steps:
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            picked = order[lo : lo + batch]
            lengths = bounds[picked + 1] - bounds[picked]
            at = np.repeat(bounds[picked] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            x = there[: len(picked)]
            x[:] = 0
            x[np.repeat(np.arange(len(picked)), lengths), column[at]] = 1
            v = m.factors.astype(np.float32)
            sums = x @ v
            logit = m.bias + x @ m.weights.astype(np.float32) + 0.5 * ((sums**2).sum(1) - x @ (v * v).sum(1))
            error = ((sigmoid(logit) - y[picked]) / len(picked)).astype(np.float32)
            by_term = x.T @ error
            grown = x.T @ (error[:, None] * sums) - by_term[:, None] * v  # without a term's pair with itself
            gradient = np.concatenate([[error.sum()], by_term + decay * m.weights, (grown + decay * m.factors).ravel()])
            t += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            flat -= rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            m.bias, m.weights, m.factors = float(flat[0]), flat[1 : k + 1], flat[k + 1 :].reshape(k, factors)
    return Machine(m.bias, m.weights.copy(), m.factors.copy(), kept)


def _scores(texts: pa.Array, m: Machine) -> list[float]:
    """One text at a time is a Python string."""
    at = columns("words", m.kept)
    return [m.score(sorted(set().union(*map(at.__getitem__, set((text.as_py() or "").split()))))) for text in texts]


def _score(batches, m):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_scores(batch.column(2), m), pa.float64())], names=["id", "held_out", "score"])


def learn(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Machine:
    return fit(Sample(docs, labels, label_column, "words", sample_rows, id_column, text_column))


def score(docs: DataFrame, m: Machine, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted of each row."""
    rows = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(partial(_score, m=m), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_column)


def keep_clean(docs: DataFrame, m: Machine, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        found = pa.array(_scores(texts, m), pa.float64())
        trim()
        return found

    return docs.where(scored(F.coalesce(F.col(text_column).cast("string"), F.lit(""))) < threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
