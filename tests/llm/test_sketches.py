import hashlib
import random
import re
import struct

import pytest
import xxhash

from inkwell.llm import registry, sketches
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, fingerprint string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", signed(x)), seed)
    return seed


def sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if len(words) >= 5:
        shingles = [chain(hashes[i : i + 5]) for i in range(len(words) - 4)]
    else:
        shingles = [xxhash.xxh64_intdigest(" ".join(words).encode(), 42)] if words else []
    cut = -(1 << 63) + (1 << 64) // sketches.SCALE
    return chain(hashes), sorted({signed(h) for h in shingles if signed(h) < cut})


def text_of(found):
    return f"{found[0]:016x}:" + "".join(f"{x % (1 << 64):016x}" for x in found[1])


def like(a, b):
    x, y = set(a[1]), set(b[1])
    return len(x & y) / len(x | y) if x | y else float(a[0] == b[0])


def expected(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    out = []
    for k, (i, text, _) in enumerate(order):
        out.append((i, text or "", order[(k + 1) % len(order)][1] or ""))
    out += [(None, r[1] or "", r[1] or "") for r in rows if r[0] is None]
    done = []
    for i, text, following in out:
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b, c = sketch(text), sketch(edited), sketch(following)
        done.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), like(a, b), like(a, c)))
    return sorted(done, key=str)


def documents():
    rng = random.Random(9)
    words = [f"Wört{i}" for i in range(300)]
    rows = [(rng.randint(-50, 4000), " ".join(rng.choice(words) for _ in range(rng.randint(0, 90))), "clash") for _ in range(300)]
    return rows + [(7001, None, ""), (7002, "", ""), (7003, " \n", ""), (7004, "😀" * 9, ""), (7005, "same text here", ""), (7005, "same text here", ""), (None, "lost one", ""), (None, None, ""), (7006, "long " * 30_000, "")]


@pytest.mark.parametrize("per_range", [512, 7])
def test_against_brute_force(spark, tmp_path, monkeypatch, per_range):
    monkeypatch.setattr(sketches, "ROWS_PER_RANGE", per_range)
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op9_sketches"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(3, "a single text", "")], [(None, "x", "")]])
def test_few_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, registry.queries()["op9_sketches"](spark, str(tmp_path)).collect()), key=str) == expected(rows)


def test_merge_and_containment(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    large = [rng.choice(words) for _ in range(4000)]
    small = large[1000:1800]
    frame = spark.createDataFrame([(" ".join(small), " ".join(large))], "a string, b string")
    both = sketches.with_sketch(sketches.with_sketch(frame, "a", "sa", "wa"), "b", "sb", "wb")
    row = both.select(sketches.containment("sa", "sb").alias("c"), sketches.containment("sb", "sa").alias("d"), (F.size(sketches.merged("sa", "sb")) - F.size("sb")).alias("n")).first()
    assert row["c"] == 1.0 and abs(row["d"] - 0.2) < 0.05 and row["n"] == 0


def test_main_path_is_native(spark, small):
    plan = registry.queries()["op9_sketches"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingles(text):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def test_short_texts_have_their_true_likeness_at_scale_1(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 24))), "") for i in range(200)]
    near = sketches.likeness("sketch", "whole", "edited_sketch", "edited_whole").alias("near_edited")
    got = {r["doc_id"]: r for r in sketches.edited(spark.createDataFrame(rows, SCHEMA), scale=1).select("doc_id", "sketch", near).collect()}
    for i, text, _ in rows:
        q = len(text) // 4
        a, b = shingles(text), shingles(text[: len(text) - q] + rows[(i + 1) % len(rows)][1][:q])
        assert got[i]["sketch"] and got[i]["near_edited"] == len(a & b) / len(a | b)


def test_error_of_the_estimate(spark, small):
    """Over whole documents: the estimate's root mean square error against all shingles, and half of the hashes kept."""
    rows = sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in registry.queries()["op9_sketches"](spark, small).collect()}
    off, kept, every = [], 0, 0
    for k, (i, text) in enumerate(rows):
        q, following = len(text) // 4, rows[(k + 1) % len(rows)][1]
        a, b = shingles(text), shingles(text[: len(text) - q] + following[:q])
        off.append((got[i]["near_edited"] - len(a & b) / len(a | b)) ** 2)
        kept, every = kept + len(got[i]["fingerprint"]) // 16 - 1, every + len(a)
    assert (sum(off) / len(off)) ** 0.5 <= 0.06 and 0.48 < kept / every < 0.52
