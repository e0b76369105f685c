"""Batches over any cut of a stream into micro-batches are those of one run over all documents."""

import random

import pytest

from inkwell.operators import packing
from inkwell.streaming import packing as SP


def loop(lengths, room, alone):
    out, batch, used = [], 0, 0
    for n in lengths:
        if used and used + n > room:
            batch, used = batch + 1, 0
        used += n
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_any_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    room, top, alone = ((30, 9, "raise"), (12, 20, "alone"), (400, 40, "raise"))[seed]
    lengths = [rng.randint(1, top) for _ in range(120)]
    cuts = sorted({0, 120, *(rng.randint(0, 120) for _ in range(3))})
    parts = list(zip(cuts, cuts[1:]))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for number, (a, b) in enumerate([*parts, (120, 120)]):  # the last one is empty
        frame = spark.createDataFrame([(7 * i, lengths[i]) for i in range(a, b)], SP.LENGTHS)
        SP.pack_part(frame, number, out, state, room, alone)
        if number == 1:  # run again, as after a failure
            SP.pack_part(frame, number, out, state, room, alone)
    got = [tuple(r) for r in SP.read_packed(spark, out).orderBy("ord").collect()]
    assert got == [(7 * i, n, b) for i, (n, b) in enumerate(zip(lengths, loop(lengths, room, alone)))]


def test_both_chains_go_on_from_a_state(spark):
    rng = random.Random(1)
    lengths = [rng.randint(1, 9) for _ in range(80)]
    for room in (20, 300):
        for fill, number in ((0, 4), (5, 2), (room, 1)):
            frame = spark.createDataFrame(list(enumerate(lengths)), "ord long, n long")
            got = [r["batch"] for r in packing.next_fit(frame, room, chunk=4, begun=(fill, number)).orderBy("ord").collect()]
            batch, used, want = number, fill, []
            for n in lengths:
                batch, used = (batch + 1, n) if used and used + n > room else (batch, used + n)
                want.append(batch)
            assert got == want, (room, fill)


def test_a_stream_of_files(spark, tmp_path):
    src, out, state = (str(tmp_path / name) for name in ("src", "out", "state"))
    rng = random.Random(4)
    lengths = [rng.randint(1, 9) for _ in range(90)]
    for k in range(3):
        spark.createDataFrame([(i, lengths[i]) for i in range(30 * k, 30 * k + 30)], SP.LENGTHS).write.mode("append").parquet(src)
        for _ in range(2):  # a call without news changes nothing
            SP.pack_incrementally(spark, src, out, state, 25)
    assert [r["batch"] for r in SP.read_packed(spark, out).orderBy("ord").collect()] == loop(lengths, 25, False)
    with pytest.raises(ValueError, match="other arguments"):
        SP.pack_incrementally(spark, src, out, state, 26)
