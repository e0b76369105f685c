"""Metrics of runs and corpora."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_loss(loss: str = "loss", tokens: str = "tokens") -> Column:
    """Token-weighted; the denominator is 1 at least."""
    return F.sum(loss) / F.greatest(F.lit(1), F.sum(tokens))


def bits_per_byte(loss: str = "loss", n_bytes: str = "n_bytes") -> Column:
    return F.sum(loss) / math.log(2) / F.greatest(F.lit(1), F.sum(n_bytes))


def throughput(log: DataFrame, run: str, step: str, tokens: str, seconds: str) -> DataFrame:
    """Adds tokens per second since the run's step logged before; the first has the rate since the start."""
    order = Window.partitionBy(run).orderBy(step)
    spent = F.col(seconds) - F.coalesce(F.lag(seconds).over(order), F.lit(0.0))
    gained = F.col(tokens) - F.coalesce(F.lag(tokens).over(order), F.lit(0))
    return log.withColumn("tokens_per_second", gained / F.greatest(F.lit(1e-9), spent))


def without_validation(log: DataFrame, run: str, step: str, seconds: str, validation: str) -> DataFrame:
    """Adds train_seconds: elapsed time less all validation time up to the step."""
    order = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("train_seconds", F.col(seconds) - F.sum(validation).over(order))


def agreement(rows: DataFrame, *columns: str) -> DataFrame:
    """(n, agree): how many rows, and whether all have the same values."""
    one = F.struct(*columns)
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(one) <= 1).alias("agree"))
