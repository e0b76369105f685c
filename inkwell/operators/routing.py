"""Mixture-of-experts routing as relations: top-k, dispatch, combination, balance; and loss rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators.prefix import CHUNK, rank_by_chunk

#: The smallest normal 32-bit float; probabilities are clamped to it in logarithms.
TINY = 2.0**-126


def bound(value: Column, body) -> Column:
    """body(value), with the value evaluated once, not once per element of a loop inside body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(values: Column) -> Column:
    """Of an array of doubles."""
    powers = bound(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    return bound(powers, lambda p: bound(total(p), lambda t: F.transform(p, lambda x: x / t)))


def probabilities(rows: DataFrame, row: str, logits: str) -> DataFrame:
    """(row, expert, p) of each row's logits."""
    return rows.select(F.col(row).alias("row"), F.posexplode(softmax(F.col(logits))).alias("expert", "p"))


def top_k(probs: DataFrame, k: int, normalized: bool = True) -> DataFrame:
    """(row, slot, expert, p, weight): the k likeliest experts, of equal ones the lower number."""
    order = Window.partitionBy("row").orderBy(F.desc("p"), "expert")
    chosen = probs.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < k)
    total = F.sum("p").over(Window.partitionBy("row"))
    return chosen.withColumn("weight", F.col("p") / total if normalized else F.col("p")).select("row", "slot", "expert", "p", "weight")


def histogram(chosen: DataFrame, experts: int) -> DataFrame:
    """(expert, n) over all experts, those without rows too."""
    every = chosen.sparkSession.range(experts).select(F.col("id").cast("int").alias("expert"))
    return every.join(chosen.groupBy("expert").agg(F.count(F.lit(1)).alias("c")), "expert", "left").select("expert", F.coalesce("c", F.lit(0)).alias("n"))


def offsets(counts: DataFrame) -> DataFrame:
    """Adds the end of each expert's rows in dispatch order. One row per expert, so the window is small."""
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("expert").rowsBetween(Window.unboundedPreceding, 0)))


def dispatch(chosen: DataFrame, counts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(row, slot, expert, place): places by expert, then by row and slot; an expert's rows are ranked chunk by chunk, so that few experts are many tasks."""
    begun = offsets(counts).select("expert", (F.col("upto") - F.col("n")).alias("__begin"))
    chunked = chosen.select("row", "slot", "expert", F.floor(F.col("row") / chunk).alias("__chunk"))
    ranked = rank_by_chunk(chunked, "__chunk", "row", "slot", within=("expert",))
    return ranked.join(begun, "expert").select("row", "slot", "expert", (F.col("__begin") + F.col("rank")).alias("place"))


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with their entries of a table that has one row per key, such as token vectors or rotary angles by position; a key without an entry fails the query."""
    found = rows.join(table.withColumn("__there", F.lit(True)), key, "left")
    there = F.coalesce("__there", F.raise_error(F.concat(F.lit(f"the table has no {key} "), F.col(key).cast("string"))))
    return found.where(there).drop("__there")


def rotary_table(spark: SparkSession, positions: int, width: int, base: float = 10000.0) -> DataFrame:
    """(position, cos, sin) of rotary embeddings for vectors of that width."""
    angles = F.transform(F.sequence(F.lit(0), F.lit(width // 2 - 1)), lambda i: F.col("id") * F.pow(F.lit(base), -(i / (width // 2))))
    return spark.range(positions).select(F.col("id").alias("position"), F.transform(angles, F.cos).alias("cos"), F.transform(angles, F.sin).alias("sin"))


def rotate_with(values: Column, cos: Column, sin: Column) -> Column:
    """Halves of an array rotated by angles that were looked up."""
    half = (F.size(values) / 2).cast("int")
    at = F.sequence(F.lit(0), half - 1)
    first = F.transform(at, lambda i: F.get(values, i) * F.get(cos, i) - F.get(values, i + half) * F.get(sin, i))
    second = F.transform(at, lambda i: F.get(values, i + half) * F.get(cos, i) + F.get(values, i) * F.get(sin, i))
    return F.concat(first, second)


def frobenius_norm(values: str) -> Column:
    """Of a matrix whose rows are arrays in a column: an aggregate."""
    return F.sqrt(F.sum(F.aggregate(F.col(values), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def combine(outputs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row, value): outputs (row, expert, value) weighted by the routing."""
    return outputs.join(chosen, ["row", "expert"]).groupBy("row").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def balance(probs: DataFrame, chosen: DataFrame, experts: int, k: int) -> DataFrame:
    """One row: aux_loss, assignment_min_frac, assignment_max_frac, assignment_cv, router_entropy, unused_experts."""
    n_rows = probs.select("row").distinct().agg(F.count(F.lit(1)).alias("rows"))
    soft = probs.groupBy("expert").agg(F.sum("p").alias("soft"), F.sum(-F.col("p") * F.log(F.greatest(F.col("p"), F.lit(TINY)))).alias("entropy"))
    joined = histogram(chosen, experts).join(soft, "expert", "left")
    one = joined.agg(
        F.sum(F.col("n") * F.coalesce("soft", F.lit(0.0))).alias("dot"),
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.stddev_pop("n").alias("spread"),
        F.avg("n").alias("mean"),
        F.sum("entropy").alias("entropy"),
        F.count_if(F.col("n") == 0).alias("unused_experts"),
    ).crossJoin(F.broadcast(n_rows))  # one row beside one row
    rows = F.greatest(F.col("rows"), F.lit(1))
    return one.select(
        F.when(F.col("rows") > 0, experts * F.col("dot") / (rows * rows)).otherwise(0.0).alias("aux_loss"),
        (F.col("low") / (rows * k)).alias("assignment_min_frac"),
        (F.col("high") / (rows * k)).alias("assignment_max_frac"),
        (F.col("spread") / F.greatest(F.col("mean"), F.lit(1e-12))).alias("assignment_cv"),
        (F.coalesce("entropy", F.lit(0.0)) / rows).alias("router_entropy"),
        F.col("unused_experts").cast("long").alias("unused_experts"),
    )


def cross_entropy(logits: Column, target: Column, ignored: int = -100) -> Column:
    """Log-sum-exp loss of one row; 0 where the target is ignored."""
    total = lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.when(target == ignored, F.lit(0.0)).otherwise(bound(F.array_max(logits), total) - F.get(logits, target))


def rms_norm(values: Column, epsilon: float = 1e-6) -> Column:
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / F.size(values)
    return bound(F.sqrt(mean + epsilon), lambda scale: F.transform(values, lambda x: x / scale))


def rotate_half(values: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary position embedding of an array of even length: halves are rotated by position * base^(-2i/n)."""
    half = F.size(values) / 2
    at = F.sequence(F.lit(0), half.cast("int") - 1)
    angle = lambda i: position * F.pow(F.lit(base), -(i / half))
    first = F.transform(at, lambda i: F.get(values, i) * F.cos(angle(i)) - F.get(values, i + half.cast("int")) * F.sin(angle(i)))
    second = F.transform(at, lambda i: F.get(values, i + half.cast("int")) * F.cos(angle(i)) + F.get(values, i) * F.sin(angle(i)))
    return F.concat(first, second)


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))
