"""Flat shards are written whole or not at all, and read back as the cache that they come from."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.plans import build
from inkwell.sources import flat_shards as FS

TEXTS = [f"text {i} " + "é" * (i * 11 % 50) for i in range(200)]


@pytest.fixture(scope="module")
def cache(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("flat")
    (folder / "a.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in TEXTS))
    build.build(spark, folder / "a.jsonl", folder / "c", shard_tokens=2500)
    build.export_shards(spark, folder / "c", folder / "flat")
    return folder


@pytest.mark.parametrize("range_bytes", [1 << 26, 300])
def test_export_then_read_is_the_cache(spark, cache, monkeypatch, range_bytes):
    want = build.load(spark, cache / "c").orderBy("ord").collect()
    assert build.load_shards(spark, cache / "flat").orderBy("ord").collect() == want
    reader = FS._Reader(str(cache / "flat"))
    monkeypatch.setattr(FS, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(FS, "CELL_BYTES", range_bytes)
    parts = reader.partitions()
    assert len(parts) > 50 or range_bytes > 300
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert [(r["ord"], r["shard"], np.frombuffer(r["tokens"], "<u2").tolist(), r["n_bytes"]) for r in rows] == [tuple(r) for r in want]


def test_a_failed_write_leaves_nothing(spark, cache, tmp_path):
    rows = build.stored(spark, cache / "c").select("ord", "shard", "tokens", "n_bytes")
    wrong = rows.withColumn("n_bytes", F.when(F.col("ord") == 150, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("n_bytes")))
    FS.register(spark)
    for frame in (wrong.repartitionById(9, "shard").sortWithinPartitions("ord"), rows.repartition(7).sortWithinPartitions("shard", "ord"), rows.coalesce(1).sortWithinPartitions("shard", F.desc("ord"))):
        with pytest.raises(Exception):
            frame.write.format(FS.FORMAT).mode("append").save(str(tmp_path))
        assert list(tmp_path.iterdir()) == []


def test_damaged_shards_are_refused(spark, cache, tmp_path):
    import shutil

    shutil.copytree(cache / "flat", tmp_path / "f")
    (tmp_path / "f/shard_00001.bytes.i32").write_bytes(b"")
    with pytest.raises(Exception, match="doesn't match"):
        build.load_shards(spark, tmp_path / "f").collect()
    (tmp_path / "f/shard_00001.tokens.u16").unlink()
    with pytest.raises(Exception, match="lacks"):
        build.load_shards(spark, tmp_path / "f").collect()
