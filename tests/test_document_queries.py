"""Byte operators over documents; other queries of the kind are held against SQL in test_queries."""

import hashlib

import pyarrow.parquet as pq

import __spark_entry__ as entry
from inkwell.queries import catalog

PAIRS = "document_byte_tokens document_byte_roundtrip document_bpe_roundtrip document_pairs".split()


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_operators_have_a_query_over_documents():
    assert {*PAIRS, "document_batches"} <= set(entry.queries()) and set(PAIRS) <= set(entry.oracle_sql())


def test_batches_against_a_loop(spark, small):
    texts = sorted((r["doc_id"], r["text"].encode()) for r in pq.read_table(f"{small}/documents.parquet").to_pylist())
    batches = [[]]
    for _, text in texts:
        if len(text) + 1 <= catalog.WINDOW:
            if sum(len(t) + 1 for t in batches[-1]) + len(text) + 1 > catalog.WINDOW:
                batches.append([])
            batches[-1].append(text)
    want = []
    for k, batch in enumerate(batches):
        room = catalog.WINDOW - sum(len(t) + 1 for t in batch)
        filler = [min(catalog.SEGMENT, room - i) for i in range(0, room, catalog.SEGMENT)]
        ids = [x for t in batch for x in (256, *t)] + [258] * room
        targets = [x for t in batch for x in (*t, 257)] + [-100] * room
        lengths = [*(len(t) + 1 for t in batch), *filler]
        bounds = [sum(lengths[:i]) for i in range(len(lengths) + 1)]
        want.append((k, digest(ids), digest(targets), digest([i for n in lengths for i in range(n)]), digest(bounds)))
    assert sorted(map(tuple, entry.queries()["document_batches"](spark, small).collect())) == want
