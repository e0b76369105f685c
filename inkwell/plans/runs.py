"""What a run leaves beside its metrics: its configuration before it, its summary after it, and its log."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.schedules import resolve_schedule, resolve_steps
from inkwell.functions.tokenize import same_tokenizer
from inkwell.operators import metrics
from inkwell.sources import storage
from inkwell.sources.documents import manifest

CONFIG, SUMMARY = "config.json", "summary.json"


def configure(spark: SparkSession, out: str | Path, train: str | Path, val: str | Path | None, batches: int, world: int, max_steps: int | None = None, **schedule) -> dict:
    """Write and return a run's configuration: caches, their one tokenizer, steps and schedule. A run has one."""
    caches = {"train": manifest(train)} | ({"val": manifest(val)} if val is not None else {})
    steps = resolve_steps(math.ceil(batches / world), max_steps)
    horizon, warmup, val_every = resolve_schedule(steps, **schedule)
    found = {"tokenizer": same_tokenizer(*(m["tokenizer"] for m in caches.values())), "world": world, "steps": steps, "horizon": horizon, "warmup": warmup, "val_every": val_every}
    found |= {side: {key: m[key] for key in ("docs", "tokens", "loss_tokens", "text_bytes")} for side, m in caches.items()}
    storage.publish(storage.child(out, CONFIG), json.dumps(found, indent=1, sort_keys=True).encode())
    return found


def summarize(log: DataFrame, out: str | Path) -> dict:
    """Write and return a run's summary of its log (step, loss, tokens, seconds): steps, tokens, the last loss, tokens per second over the second half of the steps."""
    half = log.agg((F.max("step") / 2).alias("half")).first()["half"]
    begun = F.col("step") <= (0 if half is None else half)
    at = lambda c, when: F.max(F.when(when, F.col(c)))
    row = log.agg(
        F.max("step").alias("steps"),
        F.max("tokens").alias("tokens"),
        F.max_by("loss", "step").alias("last_loss"),
        ((F.max("tokens") - F.coalesce(at("tokens", begun), F.lit(0))) / F.greatest(F.lit(1e-9), F.max("seconds") - F.coalesce(at("seconds", begun), F.lit(0.0)))).alias("tokens_per_second"),
    ).first()
    storage.replace(storage.child(out, SUMMARY), json.dumps(row.asDict(), indent=1, sort_keys=True).encode())
    return row.asDict()


def renamed(log: DataFrame, names: dict[str, str]) -> DataFrame:
    """A log under another reader's names; columns without a new name go."""
    return log.select([F.col(c).alias(names[c]) for c in log.columns if c in names])


def elapsed(log: DataFrame, run: str = "run", step: str = "step", seconds: str = "seconds", validation: str = "validation_seconds") -> DataFrame:
    return metrics.without_validation(log, run, step, seconds, validation)


def shown(number: Column) -> Column:
    """With a comma at each thousand."""
    return F.format_number(number, 0)
