"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by source and exact length: one aggregate.
2. Targets: each source's weighted share of the mix; none above ``most_repeats`` times its
   source's size, and the excess is shared again by weight until none is above. One number
   per source is on the driver.
3. For each source, whole passes over all its documents use up the target but for a rest.
   From the documents in order of length, the rest takes every so-manieth one, from a seeded
   start (of ``STARTS``, the one whose words come nearest): the same fraction of every length,
   rounded up or down, by one rule for sources of any size. A few of these documents, drawn by seed, are given back, and a bounded knapsack over
   all documents not taken, as bitsets of reachable sums by number of documents, meets the
   remaining budget with as many documents as were given back or nearly so: exactly where the
   lengths can, else with the sum nearest below. So the documents taken have their source's
   mean size. Where the sum isn't exact, more are given back (``GIVEN_BACK``), at last without
   heed of their number.
   The input of a source is its distinct lengths, however many documents it has.
4. Of each (source, length) the chosen number of documents with the smallest seeded hashes
   are taken once more. Documents are counted in cells by their hash, as many as the length
   has documents for; only the one cell that is taken in part is ranked, so one very common
   length is dealt out to many tasks.

The driver has one small row per source; a source is what a mix has a weight for.

Defined cases: a null or empty text has size 0 and is taken 0 times; a very long text is counted
whole; a null source is a source
of its own, after all others; repeated rows are rows of their own; where rows tie in all columns
the hash ranks them in any order; null ids are kept; an empty table gives an empty result; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.shared import materialize, passing, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2.0
SEED = 20
#: Rows that a (source, length, salt) cell has on average, at most.
CELL_ROWS = 512
#: Seeded starts of the walk along the lengths.
STARTS = 32
#: Documents of the rest that are given back for the knapsack, tried in turn, and whether their number is heeded.
GIVEN_BACK = ((4, True), (12, True), (128, False))
#: Memory of a knapsack's sums; the lengths farthest from the mean go without where it is used up.
KNAPSACK_BYTES = 128 << 20
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most_repeats: float = MOST_REPEATS) -> dict:
    """Each source's target. Sources by code point, null last, have the weights in turn."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most_repeats * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most_repeats * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def knapsack(lengths: list[int], counts: list[int], room: int, near: float = 0.0) -> dict[int, int]:
    """How many documents of each length to take for the largest sum up to room, lengths near ``near`` first.

    Lengths enter in turn, in runs of powers of two; a bit of reach stands for a sum. What
    reach was before each run lets the choice be read backwards.
    """
    reach, full, steps, held = 1, (1 << (room + 1)) - 1, [], 0
    for length, count in sorted(zip(lengths, counts), key=lambda x: (abs(x[0] - near), x[0])):
        copies, run = min(count, room // length), 1
        while copies > 0:
            use = min(run, copies)
            grown = (reach | reach << (length * use)) & full
            if grown != reach:
                steps.append((reach, length, use))
                held += room // 8
                reach = grown
            copies -= use
            run *= 2
        if reach >> room & 1 or held > KNAPSACK_BYTES:
            break
    total, found = reach.bit_length() - 1, {}
    for before, length, use in reversed(steps):
        if not before >> total & 1:
            found[length] = found.get(length, 0) + use
            total -= length * use
    return found


def knapsack_of(lengths: list[int], counts: list[int], room: int, wanted: int) -> dict[int, int]:
    """The same with up to ``wanted`` + 2 documents, lengths near the mean of what is wanted first.

    A bitset of sums for each number of documents. Of equal sums, the one whose number is
    nearest to what is wanted.
    """
    most, near = wanted + 2, room / max(1, wanted)
    reach, full, steps, held = [1] + [0] * most, (1 << (room + 1)) - 1, [], 0
    for length, count in sorted(zip(lengths, counts), key=lambda x: (abs(x[0] - near), x[0])):
        for _ in range(min(count, most, room // length)):
            grown = [1, *((reach[c] | reach[c - 1] << length) & full for c in range(1, most + 1))]
            if grown == reach:
                break
            steps.append((reach, length))
            held += most * room // 8
            reach = grown
        if reach[wanted] >> room & 1 or held > KNAPSACK_BYTES:
            break
    total, _, c = max((reach[c].bit_length() - 1, -abs(c - wanted), c) for c in range(most + 1))
    found: dict[int, int] = {}
    for before, length in reversed(steps):
        if not before[c] >> total & 1:
            found[length] = found.get(length, 0) + 1
            total, c = total - length, c - 1
    return found


def fit_rest(lengths: np.ndarray, counts: np.ndarray, rest: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each of the ascending lengths add up to rest, or as near to it as the method gets: below it up to half of the total, else above."""
    total = int((lengths * counts).sum())
    if rest <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if 2 * rest > total:  # what is left out is chosen by the same rule
        return counts - fit_rest(lengths, counts, total - rest, seed)
    rng = np.random.default_rng(seed)
    walks = [np.minimum(np.diff(np.floor(np.cumsum(counts) * (rest / total) + start).astype(np.int64), prepend=0), counts) for start in rng.random(STARTS)]
    share = min(walks, key=lambda taken: abs(rest - int((lengths * taken).sum())))
    upto, step = np.cumsum(share), int(np.gcd.reduce(lengths))
    there = int(upto[-1])
    drawn = rng.choice(there, min(GIVEN_BACK[-1][0], there), replace=False) if there else np.zeros(0, np.int64)
    best, nearest = np.zeros(len(lengths), np.int64), None
    for n, heeded in GIVEN_BACK:
        back = np.bincount(np.searchsorted(upto, drawn[:n], side="right"), minlength=len(lengths))
        take = share - back
        budget = rest - int((lengths * take).sum())
        if budget < 0:
            continue
        spare = counts - take
        usable = np.flatnonzero((spare > 0) & (lengths <= budget))
        at = {int(lengths[i]): i for i in usable}
        pool = lengths[usable].tolist(), spare[usable].tolist(), budget
        for length, k in (knapsack_of(*pool, min(n, there)) if heeded else knapsack(*pool, near=total / int(counts.sum()))).items():
            take[at[length]] += k
            budget -= length * k
        if nearest is None or budget < nearest:
            best, nearest = take, budget
        if nearest < step:
            break
    return best


def _fit(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    target, total = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    words = int(np.floor(target + 0.5))
    passes = words // total if total else 0
    pdf["passes"] = passes
    pdf["more"] = 0
    some = lengths > 0
    if total:
        pdf.loc[some, "more"] = fit_rest(lengths[some], counts[some], words - passes * total, seed)
    return pdf[["source", "size", "n", "passes", "more"]]


def _planned(rows: DataFrame, weights, share, most_repeats, seed) -> tuple[DataFrame, DataFrame]:
    """(source, size, n, passes, more) and (source, source_size, target) for a written table with source and size."""
    spark = rows.sparkSession
    counted = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sizes = {r["source"]: r["s"] for r in counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()}
    goal = targets(sizes, weights, share, most_repeats)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    goals = spark.createDataFrame([(s, sizes[s], goal[s]) for s in sizes], schema)
    wide = counted.join(goals, counted["source"].eqNullSafe(goals["source"])).select(counted["source"], "size", "n", "source_size", "target")
    planned = wide.groupBy("source").applyInPandas(lambda pdf: _fit(pdf, seed), "source string, size long, n long, passes long, more long")
    return materialize(planned, "planned"), goals


def taken(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most_repeats: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and repeats (how often the mix takes the row) to a written table with source, size and a number ``mark`` for each row."""
    planned, goals = _planned(rows, weights, share, most_repeats, seed)
    lengths = planned.withColumnsRenamed({"source": "p_source", "size": "p_size"}).withColumn("parts", F.ceil(F.col("n") / CELL_ROWS)).drop("n")
    known = rows["source"].eqNullSafe(lengths["p_source"]) & (rows["size"] == lengths["p_size"])
    hashed = rows.withColumns({"hash": F.xxhash64("mark", F.lit(seed)), "place": F.col("_metadata.row_index")}).join(lengths, known).drop("p_source", "p_size")
    # the high bits of the hash order the salts as they order the hashes
    salted = hashed.withColumn("salt", F.floor((F.shiftrightunsigned("hash", 40).cast("double") / float(1 << 24)) * F.col("parts")).cast("int"))
    counts = salted.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("in_cell"))
    before = F.sum("in_cell").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("source", "size", "salt", "in_cell", F.coalesce(before, F.lit(0)).alias("before"))
    counts = materialize(counts.withColumnsRenamed({"source": "c_source", "size": "c_size", "salt": "c_salt"}), "cells")
    joined = salted.join(counts, salted["source"].eqNullSafe(counts["c_source"]) & (salted["size"] == counts["c_size"]) & (salted["salt"] == counts["c_salt"]))
    # one cell of a length is taken in part; rows of others need no rank and are dealt out by place
    split = (F.col("before") < F.col("more")) & (F.col("more") < F.col("before") + F.col("in_cell"))
    joined = joined.withColumn("dealt", F.when(split, F.lit(-1)).otherwise(F.pmod(F.xxhash64("place"), F.lit(1 << 20)).cast("int")))
    order = Window.partitionBy("source", "size", "salt", "dealt").orderBy(F.expr("shiftrightunsigned(hash, 1)"), "hash", "mark")
    ranked = joined.withColumn("rank", F.col("before") + F.when(split, F.row_number().over(order)).otherwise(1))
    repeats = F.when(F.col("size") > 0, F.col("passes") + (F.col("rank") <= F.col("more")).cast("long")).otherwise(0)
    ranked = ranked.withColumn("repeats", repeats).drop("hash", "place", "parts", "salt", "dealt", "c_source", "c_size", "c_salt", "before", "in_cell", "passes", "more", "rank")
    named = goals.withColumnRenamed("source", "g_source")
    return ranked.join(named, ranked["source"].eqNullSafe(named["g_source"])).drop("g_source")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights=WEIGHTS, share: float = SHARE, most_repeats: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """id, source, size, source_size, target, taken, repeats of each row."""
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(id_column, text).alias("mark"))
    out = taken(materialize(rows, "sizes"), weights, share, most_repeats, seed)
    return out.select("id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats").withColumnRenamed("id", id_column)


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights=WEIGHTS, share: float = SHARE, most_repeats: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row with all its columns, as often as it is taken."""
    text = F.col(text_column).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_column).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(id_column, text).alias("mark"))
    rows = materialize(rows, "mixed").withColumns({"file": F.col("_metadata.file_name"), "at": F.col("_metadata.row_index")})
    with passing(docs.sparkSession) as keep:
        light = materialize(rows.select("file", "at", "source", "size", "mark"), "sizes")
        chosen = taken(light, weights, share, most_repeats, seed).where("repeats > 0").select("file", "at", "repeats")
        chosen = keep(materialize(chosen, "chosen"))
    # a merge at every size: chosen grows with the rows
    out = rows.select("file", "at", "row").hint("merge").join(chosen, ["file", "at"])
    return out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
