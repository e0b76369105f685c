"""Batches that fill as documents stream by are those that a collection per batch gives."""

import random

import pytest
from pyspark.sql import functions as F
from tests_plans import exchanges

from inkwell.functions import text as X
from inkwell.functions.tokenize import encoder, framed_ids
from inkwell.operators import batches, packing


@pytest.mark.parametrize(("seed", "window", "longest", "n"), [(0, 40, 7, 300), (1, 25, 100, 120), (2, 1000, 64, 300)])
def test_streamed_is_collected(spark, monkeypatch, seed, window, longest, n):
    monkeypatch.setattr(batches, "PART_BYTES", 150)  # many parts
    monkeypatch.setattr(batches, "EMITTED", 500)
    rng = random.Random(seed)
    texts = ["x" * rng.randint(0, 20) + "é" * rng.randint(0, 2) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").repartition(6, F.hash("ord"))
    lengths = docs.select("ord", (F.octet_length("text") + 1).alias("n"))
    placed = packing.next_fit(lengths, window, chunk=50)
    made = batches.streamed(placed, docs, framed_ids(encoder()), n, sum(len(t.encode()) for t in texts), window, longest)
    tokens = docs.select("ord", X.framed(X.byte_tokens(F.col("text"))).alias("tokens"))
    want = batches.materialize(placed, tokens, window, longest)
    assert made.orderBy("batch").collect() == want.select(made.columns).orderBy("batch").collect()
    assert max(len(r["ids"]) for r in made.collect()) == window


def test_one_exchange_and_no_collection(spark):
    docs = spark.createDataFrame([(i, "abc") for i in range(50)], "ord long, text string")
    placed = packing.next_fit(docs.select("ord", F.lit(4).alias("n")), 10)
    made = batches.streamed(placed, docs, framed_ids(encoder()), 50, 150, 10, 4)
    assert len([e for e in exchanges(made) if "text#" in e]) == 1 and "collect_list" not in made._jdf.queryExecution().toString()
    assert made.count() == 25


def test_empty(spark):
    docs = spark.createDataFrame([], "ord long, text string")
    placed = packing.next_fit(docs.select("ord", F.lit(4).alias("n")), 10)
    assert batches.streamed(placed, docs, framed_ids(encoder()), 0, 0, 10, 4).count() == 0
    with pytest.raises(ValueError):
        batches.streamed(placed, docs, framed_ids(encoder()), 0, 0, 10, 0)
