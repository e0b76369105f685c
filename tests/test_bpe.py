"""The engine's own byte-level BPE gives the library's ids."""

import json
import random
import sys
import tracemalloc
import unicodedata

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkwell.functions import bpe, tokenize


@pytest.fixture(scope="module")
def both():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.merges(path), tokenize._library(path), path


def test_documents(both, small):
    own, library, _ = both
    for text in pq.read_table(f"{small}/documents.parquet").column("text").to_pylist():
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_odd_characters(both):
    own, library, _ = both
    rng = random.Random(2)
    kinds = {}
    for c in range(0x110000):
        kinds.setdefault(unicodedata.category(chr(c)), []).append(chr(c))
    kinds.pop("Cs")
    common = list(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　'aA9_-") + ["'s", "'LL", "  ", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(kinds[rng.choice(sorted(kinds))]) for _ in range(rng.randint(0, 30)))
        if any(unicodedata.category(c) == "Cn" for c in text):  # unassigned here may be assigned there
            continue
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_long_pieces_and_a_small_table(both, monkeypatch):
    own, library, _ = both
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 3)
    for text in ("ab" * 40_000, "=" * 9_999, " " * 5_000 + "x", "one two three four five six one two", ""):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_merging_is_that_of_a_slow_loop():
    rng = random.Random(3)
    from inkwell.functions import text as X

    shown = [chr(code) for _, code in X.byte_alphabet()]
    for _ in range(60):
        vocabulary, merges = {c: i for i, c in enumerate(shown)}, []
        for _ in range(12):
            a, b = (rng.choice([c for c in vocabulary if set(c) <= set("abc")]) for _ in range(2))
            if a + b not in vocabulary:
                vocabulary[a + b] = len(vocabulary)
                merges.append(f"{a} {b}")
        own = bpe.Merges({"model": {"vocab": vocabulary, "merges": merges}})
        order = {tuple(m.split(" ")): r for r, m in enumerate(merges)}
        for _ in range(20):
            piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            symbols = list(piece)
            while ranked := [(order[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in order]:
                _, i = min(ranked)
                symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
            assert own.merged(piece.encode()) == [vocabulary[s] for s in symbols]


def test_files_of_other_kinds_go_to_the_library(spark, both, tmp_path):
    _, library, path = both
    file = json.load(open(path))
    assert bpe.is_plain(file)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": file["model"] | {"ignore_merges": True}}):
        assert not bpe.is_plain(file | change)
    (tmp_path / "other.json").write_text(json.dumps(file | {"normalizer": {"type": "NFC"}}))
    frame = spark.createDataFrame([("é café",), ("",), (None,)], "t string")
    for name, normal in ((path, False), (str(tmp_path / "other.json"), True)):
        encoder = tokenize.BPEEncoder(name, (50256, 50256, 50256))
        got = [r[0] for r in frame.select(encoder.tokens(F.col("t"))).collect()]
        assert got == [library.encode("\xe9 café" if normal else "é café", add_special_tokens=False).ids, [], []]


def test_a_round_trip_takes_one_worker_a_task(spark, small):
    import __spark_entry__ as entry

    plan = entry.queries()["document_bpe_roundtrip"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_batches_by_lots(both, tmp_path, monkeypatch):
    _, library, path = both
    (tmp_path / "other.json").write_text(json.dumps(json.load(open(path)) | {"normalizer": {"type": "NFC"}}))
    texts = pa.array(["cut off", "é café", None, "", "x" * 50, "<|endoftext|> a", "日本語 \n\n", "a b c d e f g", "cut off"])[1:-1]
    whole = [t or "" for t in texts.to_pylist()]
    for most in (1, 9, 1 << 20):
        monkeypatch.setattr(tokenize, "LOT", most)
        for name in (path, str(tmp_path / "other.json")):
            encoder = tokenize.BPEEncoder(name, (50256, 50256, 50256))
            ids = encoder.id_lists(texts)
            assert ids.type == pa.list_(pa.int32()) and ids.to_pylist() == [library.encode(t, add_special_tokens=False).ids for t in whole]
            assert encoder.texts(ids).to_pylist() == whole and encoder.texts(ids[2:5]).to_pylist() == whole[2:5]
            assert encoder.texts(pa.array([None, [50256]], ids.type)).to_pylist() == [None, "<|endoftext|>"]
            assert len(encoder.id_lists(texts[:0])) == len(encoder.texts(ids[:0])) == 0


def test_a_batch_holds_few_objects(both, monkeypatch):
    monkeypatch.setattr(tokenize, "LOT", 1 << 16)
    encoder = tokenize.BPEEncoder(both[2], (50256, 50256, 50256))
    texts = pa.array(["one two three four five six " * 1_000] * 200)
    encoder.texts(encoder.id_lists(texts[:1]))
    tracemalloc.start()
    ids = encoder.id_lists(texts)
    encoded = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    assert encoder.texts(ids).equals(texts)
    decoded = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert len(ids.flatten()) > 1_200_000 and encoded < 1.5 * ids.nbytes and decoded < 2 << 20  # a Python number for each id would take 48 MB


def test_a_table_is_bounded_in_bytes(both, monkeypatch):
    _, library, path = both
    own, most = bpe.Merges(json.load(open(path))), 20_000
    monkeypatch.setattr(bpe, "TABLE_BYTES", most)
    for text in ("".join(f" {c * 700}" for c in "abcdefghijklmnopqrstuvwxyz"), "z" * 30_000, " a b c a b c" * 9):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.held == sum(sys.getsizeof(x) for pair in own.items() for x in pair) <= most
