import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import simhash


def slow_fingerprint(text, each=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + each]) for i in range(max(1, len(words) - each + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_of_a_text():
    rng = random.Random(4)
    for n in (0, 1, 3, 4, 5, 40, 300):
        text = " \t\n".join(rng.choice(["Ab", "é", "ÉCLAIR", "x", "日本", "\x85y"]) for _ in range(n))
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    long = " ".join(rng.choice(["ab", "é", "x9"]) + str(rng.randint(0, 99)) for _ in range(30_000))
    assert simhash.fingerprint(long) == slow_fingerprint(long)
    assert simhash.fingerprint(None) == 0


def test_spark_hash_is_the_same(spark):
    got = spark.createDataFrame([("some shingle é",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("some shingle é".encode(), 42)


def test_every_close_pair_meets_in_a_table():
    rng = random.Random(5)
    for radius, tables in ((1, 2), (4, 30), (6, 126)):
        masks = [m % (1 << 64) for m in simhash.covering_masks(radius)]
        assert len(masks) == tables and {m.bit_count() for m in masks} == {32}
        for _ in range(1500):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(1, radius)):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_forest_links_as_all_pairs_do():
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(30)})
    edges = simhash.forest(np.array(fps, np.uint64), 4)
    assert all((int(a) ^ int(b)).bit_count() <= 4 for a, b in edges)
    assert len(edges) == len(fps) - len(set(slow_components(fps, 4)))


def documents(seed=7, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 200))) for _ in range(25)]
    rows = []
    for i in range(n):
        t = rng.choice(texts).split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i * 3, " ".join(t), "clash"))
    return rows + [(1, None, "a"), (2, "", "b"), (4, " \n", "c"), (5, "one two", "d"), (5, "one two", "d"), (None, "one two", "e"), (None, "alone here", "f")]


SCHEMA = "doc_id long, text string, component_id string"


def expected(rows, radius=4):
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    group = slow_components(fps, radius)
    names = {}
    for (i, _, _), g in zip(rows, group):
        names[g] = min((x for x in (names.get(g), i) if x is not None), default=None)
    return fps, group, names


def test_components_against_brute_force(spark):
    rows = documents()
    fps, group, names = expected(rows)
    want = sorted(((i, f"{f:016x}", names[g]) for (i, _, _), f, g in zip(rows, fps, group)), key=str)
    for block in (simhash.BLOCK, 3):
        got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_component_stays(spark):
    rows = documents(8)
    _, group, names = expected(rows, 6)
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), words_each=4)
    assert kept.columns == ["doc_id", "text", "component_id"]
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=str) == sorted(names.values(), key=str) and len(got) == len(set(group))
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
