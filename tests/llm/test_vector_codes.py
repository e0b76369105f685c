import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from inkwell.llm import vector_codes as V

SCHEMA = "id long, vector array<float>, label long, codes string, bounds string"


def brute(rows, parts=2, entries=4, rounds=3):
    """(codes by position in rows, errors, entries) by plain Lloyd rounds over Python integers; rows are (id, vector)."""
    whole = [[math.floor(x * 4096) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, whole[i]))
    w = len(whole[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in whole]
    books = [[list(cut[i][p]) for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                if own := [c[p] for c, code in zip(cut, codes) if code[p] == e]:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = nearest()
    return codes, [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes)], books


def points(n, seed, width=6):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(centres)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "own", "own") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_codes_are_those_of_plain_rounds(spark, seed):
    rows = points(150, seed)
    if seed == 1:  # ties everywhere: few values, many equal rows
        rows = [(i, [round(x) / 4 for x in v]) for i, v in rows]
    codes, errors, books = brute(rows)
    found = V.coded(frame(spark, rows).repartition(5), "id", "vector", "label", parts=2, entries=4, rounds=3, group_entries=2)
    got = {r["id"]: (r["codes"], r["error"]) for r in found.rows.collect()}
    assert got == {i: (c, e) for (i, _), c, e in zip(rows, codes, errors)}
    assert found.books.entries.tolist() == books


def test_bounds_pass_groups_over(spark):
    rows = points(400, 9, width=8)
    found = V.coded(frame(spark, rows), "id", "vector", "label", parts=2, entries=16, rounds=6)
    whole = len(rows) * 2 * 16
    assert found.scanned[0] == whole and sum(found.scanned[1:]) < 0.6 * 6 * whole


def test_bounds_hold(spark):
    """Whatever the entries before: a part's bound is never above the distance to another entry of the group."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-50, 50, (200, 2, 3))
    book = rng.integers(-50, 50, (2, 8, 3))
    books = V.Codebooks(book, V.grouped(book, 3), np.zeros((2, 3)))
    own, low = np.zeros((200, 2), np.int64), np.zeros((200, 2, 3))
    for _ in range(5):
        own, errors, low, _ = V.assign(vectors, own, low, books)
        for p in range(2):
            distances = np.sqrt(((vectors[:, p, None] - books.entries[p][None]) ** 2).sum(2))
            assert (own[:, p] == (distances**2).round().argmin(1)).all() and (errors[:, p] == (distances**2).round().min(1)).all()
            others = np.where(np.arange(8) == own[:, p, None], np.inf, distances)
            for g in range(3):
                assert (low[:, p, g] <= others[:, books.groups[p] == g].min(1, initial=np.inf)).all()
        totals = np.concatenate([np.concatenate([[np.bincount(own[:, p], vectors[:, p, d], 8) for d in range(3)]]).T.ravel() for p in range(2)] + [np.bincount(own[:, p], minlength=8) for p in range(2)]).astype(int).astype(object)
        books = V._moved(books, totals)


def test_defined_cases(spark):
    good = points(6, 2)
    odd = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (92, [float("nan")] * 6), (93, [float("inf")] + [0.0] * 5), (94, [1.0] * 4), (95, []), (96, [1.0] * 5)]
    rows = good + [(None, good[0][1]), (3, good[1][1]), (3, good[3][1])]
    codes, errors, books = brute(rows, entries=16)
    found = V.coded(frame(spark, rows + odd), "id", "vector", "label", parts=2, entries=16, rounds=3)
    assert sorted(((r["id"] is None, r["id"] or 0), r["codes"], r["error"]) for r in found.rows.collect()) == sorted(((i is None, i or 0), c, e) for (i, _), c, e in zip(rows, codes, errors))
    assert found.books.entries.tolist() == books
    huge = V.coded(frame(spark, [(0, [3e38, -3e38]), (1, [0.0, 0.0])]), "id", "vector", "label", parts=2, entries=1, rounds=1)
    assert {r["id"]: r["error"] for r in huge.rows.collect()} == {i: 2 * (V.LARGEST // 2) ** 2 for i in (0, 1)}
    none = V.coded(frame(spark, odd[:1]), "id", "vector", "label")
    assert none.rows.count() == 0 and none.books is None


def test_label_errors_with_a_common_label(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else None, [i % 5], i) for i in range(90)] + [(1, 7, [1], 1)] * 3, "id long, label long, codes array<int>, error long")
    got = {(r["label"], r["label_error"]) for r in V.label_errors(rows, 5).collect()}
    assert got == {(7, sum(i for i in range(90) if i % 3) + 3), (None, sum(range(0, 90, 3)))} and V.label_errors(rows, 5).count() == 93


def test_query_against_brute_force(spark, small, tmp_path):
    table = pq.read_table(f"{small}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"]) for r in table]
    codes, errors, books = brute(rows, 8, 16, 6)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    by_label = {}
    for r, e in zip(table, errors):
        by_label[r["label"]] = by_label.get(r["label"], 0) + e
    want = sorted((r["vec_id"], "".join(f"{c:02x}" for c in code), e, by_label[r["label"]], sha) for r, code, e in zip(table, codes, errors))
    assert sorted(map(tuple, entry.queries()["op11_vector_codes"](spark, small).collect())) == want
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert entry.queries()["op11_vector_codes"](spark, str(tmp_path)).count() == 0
