"""Token counts of whole texts and of all their prefixes, by prefix dynamic programming.

``count_tokens`` adds the counts as columns. With ``keep_prefixes`` a row also holds
its ``prefix_deltas``: one signed byte for each code point, whose running sum is the
exact token count at every prefix. ``bpe.prefix_counts`` and ``bpe.fitting_prefix``
(and ``truncate_to_budget`` here) answer budget questions from them; nothing is
encoded again.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a very long text is counted whole, at a
byte a code point; a code point that changes the count by more than a signed byte holds is an OverflowError; a null id stays null;
repeated rows are counted each; an empty table gives an empty result; other columns
are ignored whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm import bpe
from inkwell.llm.shared import table


def _count(batches, vocabulary_path, limit, keep_prefixes):
    vocabulary = bpe.vocabulary(vocabulary_path)
    for batch in batches:
        sizes, totals, kept = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            deltas = vocabulary.prefix_deltas(text)
            sizes.append(len(text) if text.isascii() else len(text.encode()))
            totals.append(int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64)))
            if keep_prefixes:
                kept.append(deltas)
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([x > limit for x in totals], pa.bool_())]
        names = ["id", "n_bytes", "n_tokens", "over_limit"]
        if keep_prefixes:
            columns.append(pa.array(kept, pa.binary()))
            names.append("prefix_deltas")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = 512, vocabulary_path: str | None = None, keep_prefixes: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit[, prefix_deltas] of each row. One narrow stage; nothing is shuffled."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    if keep_prefixes:
        schema = schema.add("prefix_deltas", T.BinaryType())
    counted = rows.mapInArrow(partial(_count, vocabulary_path=vocabulary_path, limit=limit, keep_prefixes=keep_prefixes), schema)
    return counted.withColumnRenamed("id", id_column)


@F.pandas_udf(T.LongType())
def _fitting(deltas, budget):
    return deltas.combine(budget, lambda d, b: bpe.fitting_prefix(bytes(d), int(b)))


def truncate_to_budget(counted: DataFrame, budget: int) -> DataFrame:
    """Adds kept_chars: the code points of the longest prefix of at most ``budget`` tokens, from the stored counts."""
    return counted.withColumn("kept_chars", _fitting("prefix_deltas", F.lit(budget)))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
