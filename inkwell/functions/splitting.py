"""Seeded selection of documents: hash split and Bernoulli sample, exact to their public algorithms."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key's place is its BLAKE2b digest of 8 bytes, read as a little-endian number; the
# salt is the split's seed in 8 signed little-endian bytes; places below the share of 2^64 validate.
PLACE_BYTES = 8
PLACES = 1 << 64
ENDIAN = "little"


def place_of(split_seed: int) -> Callable[[str], int]:
    """From key to its place among ``PLACES``."""
    empty = blake2b(digest_size=PLACE_BYTES, salt=split_seed.to_bytes(PLACE_BYTES, ENDIAN, signed=True))

    def place(key: str) -> int:
        state = empty.copy()
        state.update(key.encode())
        return int.from_bytes(state.digest(), ENDIAN)

    return place


def is_validation(key: Column, val_frac: float, split_seed: int = 0) -> Column:
    """Whether the key's place is in the validation share; a share of 0 is decided without hashing."""
    if val_frac == 0:
        return F.lit(False)
    if not 0 < val_frac < 1:
        raise ValueError(f"a validation share of {val_frac} leaves nothing to train on, or is none")
    end = int(val_frac * PLACES)

    @F.pandas_udf(T.BooleanType())
    def validates(keys: pd.Series) -> pd.Series:
        place = place_of(split_seed)
        return pd.Series(np.fromiter((place(k) < end for k in keys), bool, len(keys)))

    return validates(key)


def in_share(val_frac: float, split_seed: int = 0) -> Callable[[pa.Array], np.ndarray]:
    """As is_validation, of a batch of keys in a worker."""
    if not 0 <= val_frac < 1:
        raise ValueError(f"a validation share of {val_frac} leaves nothing to train on, or is none")
    end = int(val_frac * PLACES)

    def flags(keys: pa.Array) -> np.ndarray:
        if not end:
            return np.zeros(len(keys), bool)
        place = place_of(split_seed)
        return np.fromiter((place(k.as_py()) < end for k in keys), bool, len(keys))

    return flags


def sampled(ord_: Column, sample_frac: float, seed: int = 0) -> Column:
    """Whether draw number ``ord`` of the seeded PCG64 stream is below sample_frac, whatever the partitions.

    A run of consecutive ordinals advances the generator once.
    """

    @F.pandas_udf(T.BooleanType())
    def drawn(ords: pd.Series) -> pd.Series:
        at = ords.to_numpy(np.int64)
        out = np.empty(len(at), bool)
        cuts = np.flatnonzero(np.diff(at) != 1) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
            if b > a:
                bits = np.random.PCG64(seed)
                bits.advance(int(at[a]))
                out[a:b] = np.random.Generator(bits).random(b - a) < sample_frac
        return pd.Series(out)

    return drawn(ord_)
