"""Seeded orders: documents, batches, and the schedule of ranks."""

from __future__ import annotations

import hashlib
import random
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.prefix import rank_by_chunk
from inkwell.session import scratch

#: Documents that an exact permutation is drawn for on the driver, at 8 bytes each.
EXACT_LIMIT = 100_000_000
#: Positions that go from the driver to a written table at once.
POSITIONS_AT_ONCE = 1 << 22
#: Documents that a range of hashes has, about.
RANGE_DOCUMENTS = 1 << 16


def permutation(spark: SparkSession, n: int, shuffle_seed: int, part: int = 0) -> DataFrame:
    """(position, ord): the seeded permutation of n documents that numpy's generator of [seed, part] draws."""
    if n > EXACT_LIMIT:
        raise ValueError(f"an exact permutation is drawn for {EXACT_LIMIT} documents at most; hash_order has no limit")
    drawn = np.random.default_rng([shuffle_seed, part]).permutation(n)

    def piece(at: int) -> DataFrame:
        some = drawn[at : at + POSITIONS_AT_ONCE].astype(np.int64, copy=False)
        return spark.createDataFrame(pd.DataFrame({"position": np.arange(at, at + len(some), dtype=np.int64), "ord": some}), "position long, ord long")

    if n <= POSITIONS_AT_ONCE:
        return piece(0)
    path = scratch(spark, "permutation")
    for at in range(0, n, POSITIONS_AT_ONCE):
        piece(at).write.mode("append").parquet(path)
    return spark.read.schema("position long, ord long").parquet(path)


def hash_order(documents: DataFrame, shuffle_seed: int, part: int = 0, range_documents: int = RANGE_DOCUMENTS) -> DataFrame:
    """(position, ord) of documents (ord): a seeded order at any size, that of a hash of the number.

    The hash's high bits cut it into ranges; ranges are counted, their counts added up, and each
    range numbers its documents. Nothing but one number is on the driver.
    """
    hashed = documents.select("ord", F.xxhash64(F.lit(shuffle_seed), F.lit(part), "ord").alias("hash"))
    ranges = max(1, -(-documents.count() // range_documents))
    # the hash as a share of its range, from the least on
    share = F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), 11).cast("double") / float(1 << 53)
    hashed = hashed.withColumn("range", F.least(F.floor(share * ranges), F.lit(ranges - 1)))
    return rank_by_chunk(hashed, "range", "hash", "ord").select(F.col("rank").alias("position"), "ord")


class Bijection:
    """A keyed permutation of the numbers below n: a number's place, and the number at a place, are computed from it alone.

    A number is written as l * right + r, in a rectangle of about sqrt(n) by sqrt(n); rounds add to l
    a keyed mix of r, and to r one of l, in turn (a Feistel network of mixed radix, undone by
    subtracting). A place beyond n is permuted again until it is below: as the rectangle is permuted, that
    ends, and it exceeds n by less than its side, so the longest such walk is found beforehand
    (``walks``). Nothing is drawn, ranked or looked up.
    """

    ROUNDS = 6
    #: Mixes are modulo this prime, so products of two fit 64 bits.
    PRIME = (1 << 31) - 1

    def __init__(self, n: int, shuffle_seed: int, part: int = 0):
        if not 0 <= n < 1 << 60:
            raise ValueError(f"{n} numbers are none, or too many to be permuted by halves of 31 bits")
        self.n = n
        self.left = max(1, int(np.ceil(np.sqrt(n))))
        self.right = max(1, -(-n // self.left))
        self.keys = []
        for i in range(self.ROUNDS):
            drawn = hashlib.sha256(f"{shuffle_seed},{part},{i}".encode()).digest()
            self.keys.append(tuple(1 + int.from_bytes(drawn[k : k + 8], "little") % (self.PRIME - 1) for k in (0, 8, 16)))

    def _mixed(self, x, key):
        """Of a number or an array."""
        t = (x % self.PRIME * key[0] + key[1]) % self.PRIME
        return (t * t + key[2]) % self.PRIME

    def _step(self, at: np.ndarray) -> np.ndarray:
        l, r = at // self.right, at % self.right  # noqa: E741
        for i, key in enumerate(self.keys):
            if i % 2:
                r = (r + self._mixed(l, key)) % self.right
            else:
                l = (l + self._mixed(r, key)) % self.left  # noqa: E741
        return l * self.right + r

    @cached_property
    def walks(self) -> int:
        """Steps that the longest walk beyond n takes before it is back; cycles that lie beyond n whole are never entered."""
        begun = np.arange(self.n, self.left * self.right, dtype=np.int64)
        at, steps, longest = begun, 0, 0
        while len(at):
            at, steps = self._step(at), steps + 1
            if (at < self.n).any():
                longest = steps
            on = (at >= self.n) & (at != begun)
            at, begun = at[on], begun[on]
        return longest

    def places(self, numbers: np.ndarray) -> np.ndarray:
        out = self._step(numbers.astype(np.int64))
        while len(at := np.flatnonzero(out >= self.n)):
            out[at] = self._step(out[at])
        return out

    def _column(self, at: Column, back: bool) -> Column:
        rounds = [(i % 2, *key) for i, key in enumerate(self.keys)]
        # a literal array of the rounds: side and key
        keys = F.array(*[F.struct(F.lit(side).alias("side"), *[F.lit(k).cast("long").alias(f"k{j}") for j, k in enumerate(key)]) for side, *key in (rounds[::-1] if back else rounds)])
        sign, prime = (-1 if back else 1), F.lit(self.PRIME).cast("long")

        def mixed(x, key):
            t = F.transform(F.array((x % prime * key["k0"] + key["k1"]) % prime), lambda t: (t * t + key["k2"]) % prime)
            return F.get(t, F.lit(0))

        def turn(state, key):
            l, r = state["l"], state["r"]  # noqa: E741
            return F.struct(
                F.when(key["side"] == 0, F.pmod(l + sign * mixed(r, key), F.lit(self.left))).otherwise(l).cast("long").alias("l"),
                F.when(key["side"] == 1, F.pmod(r + sign * mixed(l, key), F.lit(self.right))).otherwise(r).cast("long").alias("r"),
            )

        def step(x):
            begun = F.struct(F.call_function("div", x, F.lit(self.right)).alias("l"), F.pmod(x, F.lit(self.right)).cast("long").alias("r"))
            return F.aggregate(keys, begun, turn, lambda s: s["l"] * self.right + s["r"])

        steps = F.array_repeat(F.lit(1), self.walks) if self.walks else F.array().cast("array<int>")
        return F.aggregate(steps, step(at), lambda x, _: F.when(x < self.n, x).otherwise(step(x)))

    def place(self, number: Column) -> Column:
        """The place of a number below n."""
        return self._column(number.cast("long"), back=False)

    def number(self, place: Column) -> Column:
        """The number whose place it is."""
        return self._column(place.cast("long"), back=True)


def bijection_order(documents: DataFrame, shuffle_seed: int, part: int = 0) -> DataFrame:
    """(position, ord) of documents (ord), numbered from 0 without gaps: a seeded order at any size, without a shuffle."""
    return documents.select(Bijection(documents.count(), shuffle_seed, part).place(F.col("ord")).alias("position"), "ord")


def reordered(documents: DataFrame, order: DataFrame) -> DataFrame:
    """Documents with their new position as ord, range-partitioned and sorted by it."""
    moved = documents.join(order, "ord").drop("ord").withColumnRenamed("position", "ord")
    return moved.repartitionByRange("ord").sortWithinPartitions("ord")


def batch_order(n_batches: int, data_seed: int | None) -> list[int]:
    """Batches in seeded order (Mersenne Twister of data_seed + 1), or as they are."""
    order = list(range(n_batches))
    if data_seed is not None:
        random.Random(data_seed + 1).shuffle(order)
    return order


def rank_schedule(spark: SparkSession, order: list[int] | int, world: int, steps: int | None = None) -> DataFrame:
    """(slot, step, rank, batch): batches dealt out to ranks in turn; fillers (-1) come after the shuffle and complete the last step.

    order: batches as they were shuffled, or how many there are where they stay in order, which needs no list.
    """
    if world <= 0:
        raise ValueError("there is a rank at least")
    n = order if isinstance(order, int) else len(order)
    slots = n + -n % world
    if isinstance(order, int):
        frame = spark.range(slots).select(F.col("id").alias("slot"), F.when(F.col("id") < n, F.col("id")).otherwise(F.lit(-1)).alias("batch"))
    else:
        rows = pd.DataFrame({"slot": np.arange(slots, dtype=np.int64), "batch": np.array(order + [-1] * (slots - n), np.int64)})
        frame = spark.createDataFrame(rows, "slot long, batch long")
    out = frame.select("slot", F.floor(F.col("slot") / world).alias("step"), (F.col("slot") % world).alias("rank"), "batch")
    return out if steps is None else out.where(F.col("step") < steps)


def step_tokens(schedule: DataFrame, plan: DataFrame) -> DataFrame:
    """(step, tokens): real tokens of all ranks; a filler has none."""
    joined = schedule.join(plan.select("batch", "real_tokens"), "batch", "left")
    return joined.groupBy("step").agg(F.sum(F.coalesce("real_tokens", F.lit(0))).alias("tokens"))
