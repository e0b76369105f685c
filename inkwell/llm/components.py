"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is an aggregate and a join on one node column; its tables are written to the
shared folder, so lineage stays short, and both sides of each join are plain scans, so that
adaptive execution can split a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.shared import discard, materialize


def _star(edges: DataFrame, label: str) -> DataFrame:
    """For each edge (u, v): v points to the least of u's neighbours and u."""
    least = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{label}-least")
    out = materialize(edges.join(least, "u").select("u", "v", "m"), label)
    return out, least


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, least = _star(both, "large")
    out = materialize(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
    discard(joined)
    discard(least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined, least = _star(down, "small")
    own = least.select("u", F.col("m").alias("v"))
    out = materialize(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v").distinct(), "small-star")
    discard(joined)
    discard(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges(u, v)`` but the roots: root is the least node that it reaches."""
    now = edges
    before = _mark(now)
    while before[0]:
        after = _small(large := _large(now))
        discard(large)
        if now is not edges:
            discard(now)
        now, mark = after, _mark(after)
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
