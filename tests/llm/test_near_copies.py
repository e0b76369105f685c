import random
from itertools import combinations

import pytest

from inkwell.llm import near_copies, pipeline

SCHEMA = "doc_id long, text string, component_id string"


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def documents():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(30):
        text = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        rows.append((k * 10, " ".join(text), "clash"))
        for i in range(1, 5):
            copy = list(text)
            for _ in range(rng.randint(1, max(1, len(text) // 35))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k * 10 + i, " ".join(copy), "clash"))
    return rows + [(1001, None, "a"), (1002, "", "b"), (1004, " \n", "c"), (1005, "one two", "d"), (1005, "one two", "d"), (None, "One two", "e"), (None, "alone here", "f")]


def expected(rows):
    sets, root = [slow_set(t) for _, t, _ in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if like(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
            root = [root[i] if r == root[j] else r for r in root]
    ids = {}
    for (i, _, _), r in zip(rows, root):
        ids[r] = min((x for x in (ids.get(r), i) if x is not None), default=None)
    return sorted(ids.values(), key=str)


@pytest.mark.parametrize("block", [near_copies.BLOCK, 500])
def test_one_of_each_component_stays(spark, block):
    rows = documents()
    kept = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA), block=block)
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == expected(rows)


def test_pipeline_stage_links_at_four_fifths(spark):
    """Near copies between 0.8 and 0.94 go, most of which a radius of 6 bits leaves in."""
    rows = documents()
    got = dict(pipeline.STAGES)["simhash near-dedup"](spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == expected(rows)


def test_no_rows(spark):
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_close_fingerprints_always_meet():
    """Sets whose majority bits differ in up to RADIUS bits share a SimHash table, whatever their minimum hashes."""
    import numpy as np

    from inkwell.llm import near_copies

    rng = np.random.default_rng(4)
    tables = lambda s: near_copies.signature(np.sort(s))[2 + near_copies.BANDS :]
    for flips in range(near_copies.RADIUS + 1):
        for _ in range(40):
            one = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
            bits = rng.choice(64, flips, replace=False)
            other = one ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0))
            a, b = tables(one), tables(other)
            assert len(a) == len(near_copies._MASKS) and (a == b).any()
    many = rng.integers(0, 1 << 63, 5001, dtype=np.uint64)
    want = [sum(int(x) >> k & 1 for x in many) * 2 > len(many) for k in range(64)]
    whole = sum(1 << k for k in range(64) if want[k])
    assert tables(many).view(np.uint64).tolist() == [whole & int(m) for m in near_copies._MASKS]
