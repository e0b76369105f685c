import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import mixing


def test_targets_stop_at_twice_a_source():
    sizes = {"b": 100, "a": 1, None: 40, "c": 10}
    got = mixing.targets(sizes)
    assert got["a"] == 2 and abs(sum(got.values()) - 1.5 * 151) < 1e-9
    assert all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    open_ = [s for s in sizes if got[s] < 2 * sizes[s] - 1e-9]
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    assert len({round(got[s] / weight[s], 9) for s in open_}) == 1


def test_knapsack_against_all_choices():
    rng = random.Random(1)
    for _ in range(60):
        lengths = rng.sample(range(1, 25), 4)
        counts, room = [rng.randint(0, 3) for _ in lengths], rng.randint(0, 60)
        best = max(s for pick in product(*(range(c + 1) for c in counts)) if (s := sum(n * k for n, k in zip(lengths, pick))) <= room)
        got = mixing.knapsack(lengths, counts, room)
        assert sum(k * n for k, n in got.items()) == best
        assert all(got.get(n, 0) <= c for n, c in zip(lengths, counts))


def test_the_rest_is_met_exactly_where_lengths_allow():
    rng = np.random.default_rng(2)
    lengths, counts = np.arange(1, 900), rng.integers(1, 9, 899)
    total = int((lengths * counts).sum())
    for rest in (0, 1, 777, total // 3, total - 5, total):
        take = mixing.fit_rest(lengths, counts, rest)
        assert int((take * lengths).sum()) == rest and (take <= counts).all() and (take >= 0).all()


@pytest.mark.parametrize("share", [0.3, 0.5, 0.7])
@pytest.mark.parametrize("n", [50, 500, 5000])
def test_the_rest_has_the_mean_size_of_its_source(n, share):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        sizes = np.maximum(1, rng.lognormal(5.3, 0.8, n)).astype(np.int64)
        lengths, counts = np.unique(sizes, return_counts=True)
        rest = int(share * sizes.sum())
        take = mixing.fit_rest(lengths, counts, rest)
        words = int((take * lengths).sum())
        assert (take >= 0).all() and (take <= counts).all() and words == rest
        assert abs(words / take.sum() - sizes.mean()) <= 0.1 * sizes.mean(), (n, share, seed)


def test_knapsack_of_a_number_of_documents():
    rng = random.Random(2)
    for _ in range(60):
        lengths = rng.sample(range(1, 25), 4)
        counts, room, wanted = [rng.randint(0, 3) for _ in lengths], rng.randint(0, 60), rng.randint(1, 4)
        sums = [s for pick in product(*(range(c + 1) for c in counts)) if sum(pick) <= wanted + 2 and (s := sum(n * k for n, k in zip(lengths, pick))) <= room]
        got = mixing.knapsack_of(lengths, counts, room, wanted)
        assert sum(k * n for k, n in got.items()) == max(sums)
        assert all(got.get(n, 0) <= c for n, c in zip(lengths, counts))


def test_long_documents_are_taken_as_often_as_others():
    rng = np.random.default_rng(1)
    for n in (60, 600, 6000):
        sizes = np.sort(np.maximum(1, rng.lognormal(5.3, 1.0, n)).astype(np.int64))
        lengths, counts = np.unique(sizes, return_counts=True)
        take = mixing.fit_rest(lengths, counts, int(0.3 * sizes.sum()))
        long_ = lengths >= sizes[-n // 4]
        assert abs(take[long_].sum() / counts[long_].sum() - 0.3) < (0.2 if n < 100 else 0.05)


def test_one_very_long_document():
    lengths, counts = np.array([3, 50, 4_000_000]), np.array([10, 10, 1])
    take = mixing.fit_rest(lengths, counts, 400)
    assert (take * lengths).sum() <= 400 and take[2] == 0
    take = mixing.fit_rest(lengths, counts, 2_000_000)
    assert 0 <= (take * lengths).sum() <= 2_000_000


SCHEMA = "doc_id long, text string, source string, target string"


def documents(seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), "clash") for i in range(1500)]
    return rows + [(1, None, "s1", ""), (None, "a b", "s1", ""), (7, "x y z \t\n w", "s2", ""), (7, "x y z \t\n w", "s2", ""), (9, "", "empty", "")]


def test_mix(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken, target, size = {}, {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = mixing.targets(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1
    assert {r["size"] for r in rows if r["doc_id"] == 7 and r["source"] == "s2"} >= {2}
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_mix_itself_repeats_rows(spark):
    docs = spark.createDataFrame(documents(4), SCHEMA)
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    words = whole.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == mixing.mix(docs).agg(F.sum("taken")).first()[0]


def test_common_length_is_ranked_in_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 5)
    docs = spark.createDataFrame([(i, "a b c", "s", "") for i in range(200)] + [(i, "a b c", "t", "") for i in range(200, 230)], SCHEMA)
    rows = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 3 for r in rows)
