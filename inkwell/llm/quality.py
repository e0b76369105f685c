"""Quality of whole texts by ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed terms (words, and the shapes of tokens) is shared by all
grades; ordered thresholds cut its scale: P(grade > k) = sigmoid(weights . x - threshold k).
A term's value is the square root of its share of the text's words. The result has the
expected grade and the tail probability of reaching a grade, by which rows are selected.
The model is fitted on a bounded sample of rated rows (``hashed_text.SAMPLE_ROWS``) on the
driver, over all slots that enough rows have; a penalty on absolute weights, by the likelihood of
all grades at once, leaves most slots at zero, and those with a weight are fitted once more
without it. Scoring is one narrow stage over whole texts.

Defined cases: a null or empty text has no terms and gets the grades that the thresholds
alone give; a very long text is scored whole, by its terms' shares; equal texts have equal
grades, and a tail probability equal to the bound is selected; repeated rows are scored each; null ids are kept and never learned from; without
any usable rating every row has expected grade 0 and tail probability 1 (all are kept), and
with ratings of one grade every row has that grade; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.hashed_text import REPEAT, SAMPLE_ROWS, Sample, columns, held_out, sigmoid, slopes, sparse_weights
from inkwell.llm.shared import table, trim

#: Rows are selected whose probability of the tail grade or better is this at least.
SELECTED = 0.5
#: The penalty on a slot's weight, in standard errors of its slope where weights are zero. Chosen by cross-validation on rows that aren't held out.
PENALTY = 1.5


@dataclass
class Grader:
    grades: np.ndarray
    thresholds: np.ndarray
    weights: np.ndarray
    kept: np.ndarray

    def tails(self, scale: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and each k below the highest."""
        return sigmoid(np.asarray(scale)[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + (tails * np.diff(self.grades)[None, :]).sum(1) if len(self.grades) else np.zeros(len(tails))

    def reaching(self, tails: np.ndarray, at_least: float | None) -> np.ndarray:
        """P(grade >= at_least); by default of any grade but the lowest."""
        if len(self.grades) < 2:
            return np.ones(len(tails))
        k = 1 if at_least is None else int(np.searchsorted(self.grades, at_least))
        return np.ones(len(tails)) if k == 0 else np.zeros(len(tails)) if k >= len(self.grades) else tails[:, k - 1]


def fit(sample: Sample, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, penalty: float = PENALTY) -> Grader:
    """Maximum likelihood of the ratings: sparse over all kept slots, then by Adam over those with a weight."""
    grades, y = np.unique(sample.labels, return_inverse=True)
    if len(grades) < 2:
        return Grader(grades.astype(float), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
    n, cuts = len(y), len(grades) - 1
    weights, thresholds = sparse_weights(sample.matrix, y, cuts, penalty)
    chosen = np.flatnonzero(weights)
    x = sample.matrix.only(chosen)
    flat = np.concatenate([[thresholds[0]], np.log(np.maximum(np.diff(thresholds), 1e-3)), weights[chosen]])
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, steps + 1):
        thresholds, weights = np.cumsum(np.concatenate([[flat[0]], np.exp(flat[1:cuts])])), flat[cuts:]
        by_scale, by_threshold = slopes(x.times(weights), thresholds, y)
        after = np.cumsum(by_threshold[::-1])[::-1] / n
        gradient = np.concatenate([[after[0]], after[1:] * np.exp(flat[1:cuts]), x.onto(by_scale / n) + decay * weights])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        flat = flat - rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    thresholds = np.cumsum(np.concatenate([[flat[0]], np.exp(flat[1:cuts])]))
    return Grader(grades.astype(float), thresholds, flat[cuts:].copy(), sample.slots[chosen])


def _scale(texts: pa.Array, g: Grader) -> np.ndarray:
    """One text at a time is a Python string."""
    at = columns("style", g.kept)
    repeat = at.at.get(REPEAT)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        tokens = (text.as_py() or "").split()
        if not tokens:
            continue
        counts = np.zeros(len(g.kept))
        for token, n in Counter(tokens).items():
            for c in at[token]:
                counts[c] += n
        if repeat is not None:
            counts[repeat] += sum(map(str.__eq__, tokens, tokens[1:]))
        out[i] = g.weights @ np.sqrt(counts / len(tokens))
    return out


def _grade(batches, g, at_least):
    for batch in batches:
        tails = g.tails(_scale(batch.column(1), g))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g.expected(tails), pa.float64()), pa.array(g.reaching(tails, at_least), pa.float64())], names=["id", "expected_grade", "tail_probability"])


def learn(docs: DataFrame, labels: DataFrame, label_column: str = "quality", sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Grader:
    return fit(Sample(docs, labels, label_column, "style", sample_rows, id_column, text_column))


def grade(docs: DataFrame, g: Grader, id_column: str = "doc_id", text_column: str = "text", at_least: float | None = None, selected: float = SELECTED) -> DataFrame:
    """id, expected_grade, tail_probability, selected, held_out of each row."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
    graded = rows.mapInArrow(partial(_grade, g=g, at_least=at_least), schema)
    return graded.withColumn("selected", F.col("tail_probability") >= selected).withColumn("held_out", held_out("id")).withColumnRenamed("id", id_column)


def keep_selected(docs: DataFrame, g: Grader, text_column: str = "text", at_least: float | None = None, selected: float = SELECTED) -> DataFrame:
    """The rows whose tail probability is high enough, with all their columns."""

    @F.arrow_udf(T.DoubleType())
    def reaching(texts: pa.Array) -> pa.Array:
        scale = _scale(texts, g)
        trim()
        return pa.array(g.reaching(g.tails(scale), at_least), pa.float64())

    return docs.where(reaching(F.coalesce(F.col(text_column).cast("string"), F.lit(""))) >= selected)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, learn(docs, table(spark, sf_dir, "labels")))
