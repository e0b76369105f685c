import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import bpe, packing, token_counts

TEXTS = [None, "", " ", "  a", "\n\nb", "a  \n b's 'll'llama '  's  've", "x<|endoftext|>y <|endoftext|>", "²½ Ⅷ 12²a\x1c\x1d b", "é 日本語 😀😀 naïve", "don't we'll", "\t\t'll x", "    ", "a　　b", "_a_b __ 1_000", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_hold_at_every_prefix(library):
    rng, vocabulary = random.Random(3), bpe.vocabulary()
    parts = ["a", "b", "'", "s", "ll", "ve", " ", "  ", "\n", "1", ".", "é", "日", "😀", "_", "<|endoftext|>", "²", "the", "ing", "\x1c", "　"]
    for _ in range(250):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        counts = bpe.prefix_counts(vocabulary.prefix_deltas(text))
        assert counts.tolist() == [len(ids(library, text[:i])) for i in range(len(text) + 1)], text


def test_budget_without_encoding_again(library):
    text = "the quick brown fox isn't 12345 " * 9
    deltas = bpe.vocabulary().prefix_deltas(text)
    for budget in (0, 1, 7, 40, 10_000):
        n = bpe.fitting_prefix(deltas, budget)
        assert len(ids(library, text[:n])) <= budget
        assert all(len(ids(library, text[:m])) > budget for m in range(n + 1, len(text) + 1))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")


def test_counts_of_rows(spark, library):
    rows = [*enumerate(TEXTS), (None, "a b"), (1, "")]
    got = Counter(map(tuple, token_counts.count_tokens(frame(spark, rows)).collect()))
    assert got == Counter((i, len((t or "").encode()), n := len(ids(library, t)), n > 512) for i, t in rows)
    kept = token_counts.truncate_to_budget(token_counts.count_tokens(frame(spark, rows), keep_prefixes=True), 5).where("doc_id = 14").first()
    assert len(ids(library, TEXTS[14][: kept["kept_chars"]])) <= 5
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(60):
        counts, room = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}, rng.randint(1, 60)
        reach = {0}
        for length, n in counts.items():
            for _ in range(n):
                reach |= {r + length for r in reach if r + length <= room}
        found = packing.fullest(counts, room)
        assert sum(k * n for k, n in found.items()) == max(reach)
        assert all(found[k] <= counts[k] for k in found)


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    counts = Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000))
    plan, used = packing.plan_bins(dict(counts)), Counter()
    for pattern, times in plan:
        assert sum(k * n for k, n in pattern.items()) <= 1024
        used.update({k: n * times for k, n in pattern.items()})
    assert used == counts
    least = -(-sum(k * n for k, n in counts.items()) // 1024)
    assert sum(t for _, t in plan) <= 1.01 * least + 1


def best_fit_decreasing(counts, capacity=1024):
    """The number of bins, one piece at a time."""
    rooms = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        i = bisect_left(rooms, length)
        room = rooms.pop(i) if i < len(rooms) else capacity
        insort(rooms, room - length)
    return len(rooms)


def test_never_more_bins_than_best_fit_decreasing():
    rng = random.Random(7)
    for n in (3, 40, 400, 4000):
        for low, high in ((1, 1024), (1, 300), (200, 700), (400, 600), (500, 513)):
            counts = Counter(rng.randint(low, high) for _ in range(n))
            used, plan = Counter(), packing.plan_bins(dict(counts))
            for pattern, times in plan:
                assert sum(k * c for k, c in pattern.items()) <= 1024
                used.update({k: c * times for k, c in pattern.items()})
            assert used == counts and sum(t for _, t in plan) <= best_fit_decreasing(counts)
    assert packing.plan_bins({}) == [] and packing.plan_bins({5: 0}) == []
    with pytest.raises(ValueError):
        packing.plan_bins({1025: 1})


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_documents_take_no_more_sequences_than_best_fit_decreasing(sf):
    vocabulary, counts = bpe.vocabulary(), Counter()
    for text in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist():
        whole, first = divmod(len(vocabulary.token_ids(text or "")) // 4, 1024)
        counts[first + 1] += 1
        counts[1024] += whole
    assert sum(t for _, t in packing.plan_bins(dict(counts))) <= best_fit_decreasing(counts)


def test_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 7)
    found = packing.pack(frame(spark, [(5, "same text")] * 100)).collect()
    places = {(r["sequence_id"], r["offset"]) for r in found}
    assert len(found) == len(places) == 100 and len({s for s, _ in places}) == -(-100 * found[0]["length"] // 1024)


def test_packed_pieces(spark, library):
    rows = [*enumerate(TEXTS), (None, "a b"), (1, "")]
    packed = packing.pack(frame(spark, rows), with_ids=True)
    found = packed.collect()
    want = Counter()
    for i, t in rows:
        whole = [*ids(library, t), 2]
        a, b, k = 0, (len(whole) - 1) % 1024 + 1, 0
        while a < len(whole):
            want[i, k, a, b - a, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())] += 1
            a, b, k = b, b + 1024, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    total = packing.sequences(packed).agg(F.sum(F.size("ids"))).first()[0]
    assert total == sum(r["length"] for r in found)
    assert packing.pack(frame(spark, [])).count() == 0


def test_very_long_texts_are_counted_whole(spark, library):
    words = " ".join(f"Größe {i} word's" for i in range(60_000))
    given = [words, "a" * 200_000, " " * 100_000 + "x", "日本" * 50_000]
    frame = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(frame).collect()}
    assert got == {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(given)}
