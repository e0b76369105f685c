import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkwell.llm import ranking
from inkwell.llm.ranking import Key

ORDER = [Key("a", descending=True, nulls_first=True), Key("b", nulls_first=True), Key("c"), Key("d", descending=True)]
SCHEMA = "g long, h string, a long, b long, c string, d double"


def brute(rows, most=None):
    """(g, h, a, b, c, d, pos, tied) by sorting each group."""
    up = lambda x, first: (0 if first else 2, 0) if x is None else (1, x)
    down = lambda x, first: (0 if first else 2, 0) if x is None else (1, -x)
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    for held in groups.values():
        held.sort(key=lambda r: (down(r[2], True), up(r[3], True), (2, "") if r[4] is None else (1, r[4]), down(r[5], False)))
        pairs = {}
        for r in held:
            pairs[r[2:4]] = pairs.get(r[2:4], 0) + 1
        out += [(*r, i, pairs[r[2:4]]) for i, r in enumerate(held, 1) if most is None or i <= most]
    return sorted(out, key=str)


def made(n, seed):
    rng = random.Random(seed)
    few = lambda *x: rng.choice([None, *x])
    rows = [(few(1, 2), few("x", "y"), few(1, 2, 3), few(0, 7), few("k", "", "é" * 5000), few(0.5, -1.0)) for _ in range(n)]
    return rows + [(9, "hot", 1, 1, "same", 0.0)] * (n // 2)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize(("partitions", "fan", "block"), [(1, 64, 1 << 16), (13, 2, 5)])
def test_places_and_ties_are_those_of_a_sort(spark, partitions, fan, block):
    rows = made(300, partitions)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (None, 2):
            assert got(ranking.ranked(frame, ["g", "h"], ORDER, 2, most, fan, block)) == brute(rows, most)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_folding_over_batches(spark, monkeypatch):
    rows = made(60, 4)
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(ranking.ranked(frame, ["g", "h"], ORDER, 2)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_one_exchange_carries_the_rows(spark):
    frame = spark.createDataFrame(made(20, 1), SCHEMA)
    by = [F.col("g").asc_nulls_first(), *(k.order() for k in ORDER)]
    names = ["g", *(k.name for k in ORDER)]
    plan = frame.select(*names).repartitionByRange(*by).groupBy(*names).agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_a_tuple_that_most_rows_share_travels_folded(spark):
    frame = spark.range(200_000, numPartitions=2).select(F.lit(1).alias("g"), F.lit(2).alias("a"))
    runs = ranking.compressed(frame, ["g"], [Key("a")]).collect()
    assert [(r["g"], r["a"], r["__n"], r["__own"]) for r in runs] == [(1, 2, 200_000, 0)]
    assert ranking.ranked(frame, ["g"], [Key("a")], 1).agg(F.min("pos"), F.max("pos"), F.count_distinct("pos"), F.min("tied")).first()[:] == (1, 200_000, 200_000, 200_000)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(ranking.ranked(empty, ["g"], ORDER, 1)) == []
    rows = spark.createDataFrame([(1, 5, 0, 0, 0), (1, 4, 9, 9, 9)], "g long, a long, pos long, tied long, n long")
    assert got(ranking.ranked(rows, ["g"], [Key("a")], 1)) == [(1, 4, 1, 1), (1, 5, 2, 1)]
    for bad in (["g", "a"], []):
        with pytest.raises(ValueError):
            ranking.ranked(rows, bad, [Key("a")], 1)


def test_query_against_brute_force(spark, tmp_path, small):
    """The registered query over a whole table, and over one with numbers that aren't finite."""
    half = lambda x: None if x is None else int((100 * x + 0.5) // 1)
    lines, rows = pq.read_table(f"{small}/sale_lines.parquet").to_pylist(), []
    for r in lines:
        hot = r["sale_id"] is not None and zlib.crc32(str(r["sale_id"]).encode()) % 5 == 0
        part = -1 if r["item_id"] is None else r["item_id"] % 5
        month = -1 if r["shipped_at"] is None else 100 * r["shipped_at"].year + r["shipped_at"].month
        key = (-1, -1, -1) if hot else (r["vendor_id"], part, month)
        q = r["quantity"]
        rows.append((key, None if q is None else q // 10, half(r["discount"]), r["sale_id"], r["line_no"], q, half(r["amount"])))
    up = lambda x: (1, 0) if x is None else (0, x)
    groups, want = {}, []
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for key, held in groups.items():
        held.sort(key=lambda r: (r[1] is not None, -(r[1] or 0), r[2] is not None, r[2] or 0, *map(up, r[3:])))
        want += [(*key, i, i, r[3], r[4], r[5], r[2], r[6], sum(x[1:3] == r[1:3] for x in held)) for i, r in enumerate(held[:2], 1)]
    assert got(entry.queries()["op13_ranking"](spark, small)) == sorted(want, key=str)
    odd = spark.createDataFrame([(1, 1, 2, 3, 10, float("nan"), float("inf"), None), (1, 1, 2, 3, 10, 1.0, 0.1, None)], "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, shipped_at timestamp")
    odd.write.parquet(f"{tmp_path}/sale_lines.parquet")
    assert [(r["pos"], r["percent"], r["amount_cents"], r["tied"]) for r in entry.queries()["op13_ranking"](spark, str(tmp_path)).orderBy("pos").collect()] == [(1, None, None, 1), (2, 10, 100, 1)]
