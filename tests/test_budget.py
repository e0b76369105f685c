"""Budgets are cut as a number: no text moves, and nothing after the cut is read."""

import json
import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests_plans import exchanges

from inkwell.operators import prefix
from inkwell.sources import documents as S
from inkwell.sources import pieces

TEXTS = [f"{i} " + "wörd " * (i * 13 % 40) for i in range(600)]
COSTS = np.cumsum([len(t.encode()) + 1 for t in TEXTS])


def taken(budget):
    return max(1, min(len(TEXTS), int(np.searchsorted(COSTS, budget)) + 1))


def test_the_cut_is_a_number(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "ord long, text string").repartition(5)
    for chunk in (7, 1000):
        lengths = frame.select("ord", (F.octet_length("text") + 1).alias("n"))
        for budget in (0, int(COSTS[77]), int(COSTS[77]) + 1, 10**9):
            assert prefix.budget_end(lengths, "n", budget, chunk=chunk) == taken(budget), (chunk, budget)
    cut = prefix.bytes_within(spark.createDataFrame(list(enumerate(TEXTS)), "ord long, text string"), 5000)
    assert not [e for e in exchanges(cut) if "text#" in e]
    assert sorted(r["ord"] for r in cut.collect()) == list(range(taken(5000)))
    empty = frame.where("ord < 0").select("ord", F.lit(1).alias("n"))
    assert prefix.within_budget(empty, "n", 10).count() == 0


@pytest.fixture(scope="module")
def one_file(tmp_path_factory):
    """A file of 40 row groups, and one of JSON lines with other fields, escapes and long lines."""
    folder = tmp_path_factory.mktemp("one")
    pd.DataFrame({"text": TEXTS}).to_parquet(folder / "a.parquet", row_group_size=15, compression="none", index=False)
    rng = random.Random(1)
    (folder / "a.jsonl").write_text("".join(json.dumps({"n": "z" * rng.randint(0, 90), "text": t}, ensure_ascii=rng.random() < 0.5) + "\n" for t in TEXTS))
    return folder


def damaged_after(folder, group):
    """The file with garbage from a row group on; its footer is whole."""
    data, meta = bytearray((folder / "a.parquet").read_bytes()), pq.read_metadata(folder / "a.parquet")
    column = meta.row_group(group).column(0)
    at = column.dictionary_page_offset or column.data_page_offset
    last = meta.row_group(meta.num_row_groups - 1).column(0)
    end = (last.dictionary_page_offset or last.data_page_offset) + last.total_compressed_size
    data[at:end] = b"\xff" * (end - at)
    return bytes(data)


def test_row_groups_after_the_budget_are_not_read(spark, one_file, tmp_path):
    """Bytes read of one file: those of the first 1 + 2 + 4 row groups, though the file has 40."""
    budget = int(COSTS[70])  # in the fifth group
    path = tmp_path / "damaged.parquet"
    path.write_bytes(damaged_after(one_file, 7))
    got = S.read_within(spark, path, budget)
    assert [r["text"] for r in got.orderBy("ord").collect()] == TEXTS[:71]
    path.write_bytes(damaged_after(one_file, 3))
    with pytest.raises(Exception):
        S.read_within(spark, path, budget).collect()


@pytest.mark.parametrize("name", ["a.parquet", "a.jsonl"])
def test_budgets_inside_a_file(spark, one_file, monkeypatch, name):
    monkeypatch.setattr(pieces, "LINE_BYTES", 977)
    for budget in (0, int(COSTS[299]), int(COSTS[299]) + 1, 10**9):
        got = S.read_within(spark, one_file / name, budget)
        assert [(r["ord"], r["text"]) for r in got.orderBy("ord").collect()] == list(enumerate(TEXTS[: taken(budget)])), budget


def test_lines_after_the_budget_are_not_read(spark, one_file, tmp_path, monkeypatch):
    monkeypatch.setattr(pieces, "LINE_BYTES", 2000)
    held = (one_file / "a.jsonl").read_text().splitlines(keepends=True)
    (tmp_path / "b.jsonl").write_text("".join(held[:200]) + "not JSON\n" + "".join(held[200:]))
    assert S.read_within(spark, tmp_path / "b.jsonl", int(COSTS[9])).count() == 10
    for bad in ("not JSON\n", "\n", '{"other": 1}\n', '{"text": 5}\n'):
        (tmp_path / "b.jsonl").write_text(held[0] + bad + held[1])
        with pytest.raises(Exception):
            S.read_within(spark, tmp_path / "b.jsonl", 10**6).collect()


def test_keys_and_empty_sources(spark, tmp_path):
    pd.DataFrame({"id": [7, 8, 9], "text": ["a", "b", "c"]}).to_parquet(tmp_path / "k.parquet", row_group_size=1)
    assert [tuple(r) for r in S.read_within(spark, tmp_path / "k.parquet", 3).orderBy("ord").collect()] == [(0, "a", "7"), (1, "b", "8")]
    (tmp_path / "e.jsonl").write_text("")
    assert S.read_within(spark, tmp_path / "e.jsonl", 3).count() == 0
