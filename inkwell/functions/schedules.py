"""Learning-rate and cadence schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(step: Column, warmup: int, total: int, floor: float) -> Column:
    """Linear warmup, then a cosine from 1 to the floor."""
    done = F.least(F.lit(1.0), (step - warmup).cast("double") / max(1, total - warmup))
    falling = floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * done))
    return F.when(step < warmup, (step + 1).cast("double") / max(1, warmup)).otherwise(falling)


#: Warm-up steps, at least.
LEAST_WARMUP = 10


def _part_of(n: int, share: float, least: int) -> int:
    """A share of n steps, rounded up."""
    return max(least, math.ceil(share * n))


def resolve_schedule(steps: int, horizon: int | None = None, warmup_frac: float = 0.02, val_frac: float = 0.05, val_every: int | None = None) -> tuple[int, int, int]:
    """(horizon, warmup steps, validation interval) of a run; the first argument that makes no sense is named."""
    horizon = steps if horizon is None else horizon
    interval = _part_of(steps, val_frac, 1) if val_every is None else val_every
    wrong = {
        "steps": steps < 1,
        "horizon": horizon < steps,
        "warmup_frac": warmup_frac < 0,
        "val_frac": val_every is None and val_frac <= 0,
        "val_every": interval < 1,
    }
    if named := [name for name, bad in wrong.items() if bad]:
        raise ValueError(f"{named[0]} is out of its range")
    return horizon, _part_of(horizon, warmup_frac, LEAST_WARMUP), interval


def resolve_steps(available: int, most: int | None) -> int:
    """Steps of a run with that many batches and an optional limit."""
    steps = available if most is None else most
    if steps not in range(1, available + 1):
        raise ValueError(f"{steps} steps can't be run with {available} available")
    return steps


def width_scaled(width: int, base_width: int, layers: int, std: float, rate: float) -> dict[str, float]:
    """Of a wider model: the deviation of hidden and of residual weights at the start, and the learning rate of hidden weights.

    Hidden deviations fall with the root of the width's multiple, residual ones also with that of twice
    the layers; the rate falls with the multiple.
    """
    if min(width, base_width, layers) < 1:
        raise ValueError("widths and layers are positive")
    times = width / base_width
    hidden = std / math.sqrt(times)
    return {"hidden_std": hidden, "residual_std": hidden / math.sqrt(2 * layers), "hidden_rate": rate / times}


def names_of(listed: str) -> list[str]:
    """A comma-separated list without surrounding space or empty entries; a name may be there once."""
    found = [name for part in listed.split(",") if (name := part.strip())]
    if twice := sorted({name for name in found if found.count(name) > 1}):
        raise ValueError(f"named more than once: {', '.join(twice)}")
    return found


def is_logged(step: Column, every: int, total: int) -> Column:
    return (step == 1) | (step % every == 0) | (step == total)
