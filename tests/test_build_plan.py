"""Builds move tokens once, number documents without moving them, and place them by a bijection."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests_plans import exchanges

from inkwell.functions.tokenize import encoder, packed, unpacked
from inkwell.operators import order, prefix
from inkwell.plans import build
from inkwell.sources import documents as S


@pytest.mark.parametrize("n", [*range(12), 101, 1000, 4097])
def test_bijection_is_one(n):
    a, b = order.Bijection(n, 5, 1), order.Bijection(n, 6, 1)
    places = a.places(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert n < 100 or (places != b.places(np.arange(n))).mean() > 0.9
    if n > 1000:  # neighbours are as far apart as in a random order
        assert abs(np.abs(np.diff(places)).mean() / n - 1 / 3) < 0.02


@pytest.mark.parametrize("n", [1, 3, 7, 1000, 3_000_000_017])
def test_places_and_numbers_in_a_row(spark, n):
    a = order.Bijection(n, 9)
    rows = spark.range(max(0, n - 1000), n).select("id", a.place(F.col("id")).alias("place")).withColumn("back", a.number(F.col("place"))).orderBy("id").collect()
    assert all(r["id"] == r["back"] for r in rows)
    assert [r["place"] for r in rows] == a.places(np.arange(max(0, n - 1000), n)).tolist()
    with pytest.raises(ValueError):
        order.Bijection(-1, 0)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Five files of several row groups each."""
    path = tmp_path_factory.mktemp("parts")
    texts = [f"document {i} " + "x" * (i * 7 % 90) for i in range(1000)]
    for k in range(5):
        pd.DataFrame({"id": [str(i) for i in range(200 * k, 200 * k + 200)], "text": texts[200 * k : 200 * k + 200]}).to_parquet(path / f"{k}.parquet", row_group_size=30)
    return path, texts


def test_tokens_move_once(spark, folder, tmp_path):
    path, texts = folder
    rows = build.encoded(S.read_source(spark, str(path)), encoder(), val_frac=0.2, max_bytes=95)
    rows.write.parquet(f"{tmp_path}/held")
    held = spark.read.schema(build.HELD).parquet(f"{tmp_path}/held")
    for seed, shuffle, moves in ((None, "exact", 0), (1, "exact", 1), (1, "bijection", 1), (1, "hash", 1)):
        ranked, n = build.ranked_runs(held, False)
        docs = build.placed(ranked, n, shuffle, seed, 0)
        made = build.cut_into_shards(docs, build.shard_starts(docs, 3000), n, 10**6, seed is not None)
        assert sum("tokens#" in e for e in exchanges(made)) == moves, (shuffle, made._jdf.queryExecution().toString())
        got = made.orderBy("ord").collect()
        assert [r["ord"] for r in got] == list(range(n)) and [r["shard"] for r in got] == sorted(r["shard"] for r in got)


@pytest.mark.parametrize("split_bytes", ["2k", "128m"])
def test_ranks_over_runs(spark, folder, split_bytes):
    """However files are cut into tasks, ranks are those in order of the kept documents of a side."""
    path, texts = folder
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        rows = build.encoded(S.read_source(spark, str(path)), encoder(), max_docs=777, max_bytes=60, max_tokens=55, val_frac=0.3).cache()
        for is_val in (False, True):
            ranked, n = build.ranked_runs(rows, is_val)
            got = [r["rank"] for r in ranked.orderBy("ord").collect()]
            assert got == list(range(n)) and n > 50
        assert rows.count() == 777
        kept = build.kept_documents(S.read_source(spark, str(path)), encoder(), 777, 60, 55, 0.3)[1]
        fate = {r["ord"]: (r["tokens"], r["n_bytes"], r["is_val"]) for r in kept.collect()}
        assert {r["ord"]: (r["t"], r["n_bytes"], r["is_val"]) for r in rows.where("fate = 'kept'").withColumn("t", unpacked("tokens")).collect()} == fate
        assert build.counters(rows).first() == build.counters(build.kept_documents(S.read_source(spark, str(path)), encoder(), 777, 60, 55, 0.3)[0]).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        rows.unpersist()


def test_shards_by_bisection(spark):
    starts = [0, 1, 5, 6, 40, 99]
    got = [r[0] for r in spark.range(120).orderBy("id").select(prefix.interval_of(F.col("id"), starts)).collect()]
    assert got == (np.searchsorted(starts, np.arange(120), side="right") - 1).tolist()
    assert spark.range(3).select(prefix.interval_of(F.col("id"), [0])).distinct().collect() == spark.range(1).select(F.lit(0)).collect()


def test_cells(spark):
    import pyarrow as pa

    given = [np.array(x, "<u2") for x in ([], [1, 2, 65535], [], [7])]
    assert packed(given).to_pylist() == [x.tobytes() for x in given] and len(packed([])) == 0
    frame = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(given)] + [(4, None)], "i int, c binary")
    assert [r[0] for r in frame.orderBy("i").select(unpacked("c")).collect()] == [x.tolist() for x in given] + [[]]
    assert pa.types.is_binary(packed(given).type)


def test_a_bijective_build_with_a_split(spark, folder, tmp_path):
    path, texts = folder
    made = build.build(spark, path, tmp_path / "t", val_out=tmp_path / "v", val_frac=0.2, shuffle_seed=4, shuffle="bijection", shard_tokens=5000)
    sides = {}
    for part, name in enumerate("tv"):
        rows = build.load(spark, tmp_path / name).orderBy("ord").collect()
        sides[name] = [bytes(r["tokens"][1:-1]).decode() for r in rows]
        inside = [t for t in texts if t in set(sides[name])]
        places = order.Bijection(len(inside), 4, part).places(np.arange(len(inside)))
        assert [sides[name][p] for p in places] == inside and [r["ord"] for r in rows] == list(range(len(rows)))
    assert sorted(sides["t"] + sides["v"]) == sorted(texts) and len(made["shards"]) > 5 and made["filter_stats"]["val_docs"] == len(sides["v"])


RETRIED = """
import os, sys
sys.path.insert(0, {top!r})
from pyspark import TaskContext
from pyspark.sql import Observation, SparkSession
from inkwell.functions.tokenize import encoder
from inkwell.plans import build
from inkwell.sources import documents as S

def fails_once(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
seen, docs = Observation(), S.read_source(spark, {source!r})
build.encoded(docs, encoder(), max_bytes=60).mapInArrow(fails_once, build.HELD).observe(seen, *build.counts()).write.parquet({out!r})
assert seen.get == build.counters(build.kept_documents(docs, encoder(), max_bytes=60)[0]).first().asDict(), seen.get
print("equal", seen.get["read_docs"])
"""


def test_counters_of_tasks_that_ran_twice(folder, tmp_path):
    """A session of its own, as tests' tasks have one attempt."""
    script = RETRIED.format(top=str(Path(build.__file__).parents[2]), source=str(folder[0]), out=f"{tmp_path}/held")
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["equal", "1000"], done.stderr[-2000:]


@pytest.mark.parametrize("shuffle", [{}, {"shuffle_seed": 1, "shuffle": "bijection"}])
def test_empty_sources(spark, tmp_path, shuffle):
    """An empty source is an empty cache; observed counters are there though no row was."""
    (tmp_path / "e.jsonl").write_text("")
    made = build.build(spark, tmp_path / "e.jsonl", tmp_path / "c", **shuffle)
    assert (made["docs"], made["filter_stats"]["read_docs"], made["shards"]) == (0, 0, []) and build.load(spark, tmp_path / "c").count() == 0
