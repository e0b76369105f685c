import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import audio
from inkwell.llm.shared import materialize


def song(seed, notes=60, rate=8000):
    rng = np.random.default_rng(seed)
    hz = 110 * 2 ** (rng.integers(0, 36, notes) / 12)
    return 0.5 * np.sin(np.cumsum(np.repeat(hz, 600)) * 2 * np.pi / rate)


def test_integral_image_areas():
    image = np.random.default_rng(1).random((40, 12))
    got = audio.pack(image)
    shape, y, h, w = audio.filters()[0]
    t = 3
    plus = image[t : t + w, y : y + h].sum()
    ratio = np.log((1 + plus) / (1 + image[t : t + w].sum() - plus))
    level = sum(ratio > x for x in audio.THRESHOLDS)
    assert got[t] >> 30 == level ^ level >> 1
    assert len(got) == 40 - 12 + 1


def test_wav_round_trip():
    x = song(1)
    y, rate = audio.decode_wav(audio.encode_wav(x, 8000))
    assert rate == 8000 and np.abs(x - y).max() < 1e-4


def test_excerpts_align_at_their_offset():
    whole = song(2)
    a = audio.fingerprint(whole, 8000)
    b = audio.fingerprint(whole[20 * audio.HOP :] + np.random.default_rng(0).normal(0, 0.01, len(whole) - 20 * audio.HOP), 8000)
    offset, error = audio.align(a, b)
    assert offset == 20 and error < 0.05
    other = audio.align(a, audio.fingerprint(song(3), 8000))
    assert other is None or other[1] > audio.MOST_ERROR


def test_queries_against_brute_force(spark):
    base = [song(k) for k in range(6)]
    clips = {0: base[0], 1: base[0][10 * audio.HOP :], 2: base[0], 3: base[1], 100: base[1][7 * audio.HOP :], 101: base[2], 102: base[1], 200: base[3], 201: base[4]}
    rows = [(i, audio.encode_wav(x, 8000), "clash") for i, x in clips.items()] + [(5, None, ""), (6, b"no wav", ""), (7, audio.encode_wav(np.zeros(50), 8000), ""), (None, audio.encode_wav(base[5], 8000), ""), (0, audio.encode_wav(base[0], 8000), "")]
    found = materialize(audio.fingerprints(spark.createDataFrame(rows, "vec_id long, media binary, fp string"), "vec_id", "media"), "test-audio")
    got = audio.align_queries(found, F.coalesce(F.col("id") % 100 == 0, F.lit(False))).collect()
    assert len(got) == len(rows)
    prints = {i: tuple(audio.fingerprint(*audio.decode_wav(audio.encode_wav(x, 8000)))) for i, x in clips.items()}
    name = {i: min(j for j in prints if prints[j] == p) for i, p in prints.items()}
    asked = {name[i] for i in prints if i % 100 == 0}
    for r in got:
        if r["id"] not in prints:
            assert r["n_links"] in (None, 0)
            continue
        c, links = name[r["id"]], []
        for q in asked - {c}:
            hit = audio.align(np.array(prints[q]), np.array(prints[c]))
            if hit and hit[1] <= audio.MOST_ERROR and min(len(prints[q]), len(prints[c])) - abs(hit[0]) >= audio.LEAST_FRAMES:
                links.append((round(hit[1], 9), q, hit[0]))
        best = min(links, default=(None, None, None))
        assert (r["class_id"], r["n_links"], r["best_query"], r["offset"]) == (c, len(links), best[1], best[2])
    assert {r["class_id"] for r in got if r["id"] == 2} == {0}
    none = materialize(audio.fingerprints(spark.createDataFrame([], "vec_id long, media binary"), "vec_id", "media"), "test-none")
    assert audio.align_queries(none, F.lit(True)).count() == 0


def slow_fingerprint(samples, rate):
    """Frame by frame and area by area, without integral image."""
    frames = [samples[i : i + audio.FRAME] * np.hanning(audio.FRAME) for i in range(0, len(samples) - audio.FRAME + 1, audio.HOP)]
    energy = []
    for frame in frames:
        row = np.zeros(12)
        for k, power in enumerate(np.abs(np.fft.rfft(frame)) ** 2):
            hz = k * rate / audio.FRAME
            if 55 <= hz <= min(3520, rate / 2):
                row[round(12 * np.log2(hz / 440)) % 12] += power
        energy.append(row)
    image = []
    for t in range(2, len(energy) - 2):
        row = 0.25 * energy[t - 2] + 0.75 * energy[t - 1] + energy[t] + 0.75 * energy[t + 1] + 0.25 * energy[t + 2]
        norm = np.sqrt((row**2).sum())
        image.append(row / norm if norm > 1e-6 else np.zeros(12))
    out = []
    for t in range(len(image) - 11):
        value = 0
        for shape, y, h, w in audio.filters():
            cells = {(i, j): image[t + i][j] for i in range(w) for j in range(12)}
            inside = {(i, j): v for (i, j), v in cells.items() if y <= j < y + h}
            if shape == 0:
                plus, minus = sum(inside.values()), sum(cells.values()) - sum(inside.values())
            else:
                is_plus = {
                    1: lambda i, j: j >= y + h // 2,
                    2: lambda i, j: i >= w // 2,
                    3: lambda i, j: (i >= w // 2) == (j >= y + h // 2),
                    4: lambda i, j: y + h // 3 <= j < y + h - h // 3,
                    5: lambda i, j: w // 4 <= i < w - w // 4,
                }[shape]
                plus = sum(v for k, v in inside.items() if is_plus(*k))
                minus = sum(v for k, v in inside.items() if not is_plus(*k))
            ratio = np.log((1 + plus) / (1 + minus))
            value = value << 2 | (0, 1, 3, 2)[sum(ratio > x for x in (-0.2, 0.03, 0.2))]
        out.append(value)
    return out


def slow_align(a, b):
    """Place by place."""
    quiet = audio.silence() & 0xFFFFFFFF
    votes = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x == y != quiet:
                votes[i - j] = votes.get(i - j, 0) + 1
    if not votes:
        return None
    offset = min(votes, key=lambda d: (-votes[d], abs(d), d))
    pairs = list(zip(a[max(0, offset) :], b[max(0, -offset) :]))
    return offset, sum((x ^ y).bit_count() for x, y in pairs) / (32 * len(pairs)), len(pairs)


def test_histograms_of_runs_against_places():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (np.repeat(rng.integers(0, 4, 6), rng.integers(1, 6, 6)).astype(np.uint32) for _ in range(2))
        a[:2] = np.uint32(audio.silence() & 0xFFFFFFFF)
        got, want = audio.align(a, b), slow_align(a.tolist(), b.tolist())
        assert (got is None) == (want is None) and (got is None or (got[0] == want[0] and abs(got[1] - want[1]) < 1e-12))


def test_registered_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=40).tolist() for i in (0, 1, 2, 100, 101, 300)}
    vectors |= {3: vectors[0], 200: vectors[1], 4: [0.0] * 40, 5: [2.0] * 40, 6: [1.0] * 30, 7: [], 8: vectors[100][10:] + vectors[101][:10]}
    rows = [(i, v, "clash") for i, v in vectors.items()] + [(None, vectors[0], ""), (9, None, ""), (2, vectors[2], "")]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, begin string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = audio.op8_chroma(spark, str(tmp_path)).collect()

    def played(v, begin=0):
        values = np.array(v, float)
        keys = np.floor((np.clip(values / np.sqrt((values**2).mean()) if values.any() else values, -3, 2.999) + 3) * 6)
        phase = np.cumsum(np.repeat(110.0 * 2 ** (keys / 12), 500)) * 2 * np.pi / 8000
        return audio.decode_wav(audio.encode_wav((0.5 * np.sin(phase) + 0.2 * np.sin(2 * phase))[begin * 512 :], 8000))

    prints = {i: slow_fingerprint(*played(v)) for i, v in vectors.items()}
    prints |= {-1 - i: slow_fingerprint(*played(v, 5 + i // 100 % 16)) for i, v in vectors.items() if i % 100 == 0}
    name = {i: min(j for j in prints if prints[j] == p) for i, p in prints.items()}
    assert len(got) == len(rows) + 4
    for r in got:
        if r["vec_id"] not in prints:
            continue
        c, links = name[r["vec_id"]], []
        for q in {name[i] for i in prints if i >= 0 and i % 100 == 0} - {c}:
            hit = slow_align(prints[q], prints[c])
            if hit and hit[2] >= audio.LEAST_FRAMES and hit[1] <= audio.MOST_ERROR:
                links.append((round(hit[1], 9), q, hit[0]))
        best = min(links, default=(None, None, None))
        assert (r["class_id"], r["n_links"], r["best_query"], r["offset"]) == (c, len(links), best[1], best[2]), r
    linked = {r["vec_id"]: r["offset"] for r in got if r["n_links"]}
    assert linked[-1] == 5 and linked[-101] == 6 and linked[-201] == 7 and linked[-301] == 8


def test_query_links_its_excerpts(spark):
    rows = audio.op8_chroma(spark, "/root/testdata/sf0.01").collect()
    assert all(r["n_links"] >= 1 for r in rows if r["vec_id"] < 0) and sum(r["vec_id"] < 0 for r in rows) == 5


def test_odd_recordings(spark):
    tone = 0.4 * np.sin(np.arange(3600 * 2000) * 2 * np.pi * 440 / 2000)
    odd = {0: audio.encode_wav(tone, 2000), 100: audio.encode_wav(tone[: len(tone) // 2], 2000), 1: audio.encode_wav(np.zeros(60_000), 8000), 200: audio.encode_wav(np.zeros(90_000), 8000)}
    odd |= {2: audio.encode_wav(song(1), 0), 3: b"RIFF", 4: audio.encode_wav(song(1), 8000)[:40], 5: b"", 6: audio.encode_wav(song(1), 8000)[:-20_001], 300: audio.encode_wav(song(1), 8000)}
    frame = spark.createDataFrame([(i, x) for i, x in odd.items()], "vec_id long, media binary")
    found = materialize(audio.fingerprints(frame, "vec_id", "media"), "test-odd")
    got = {r["id"]: r for r in audio.align_queries(found, F.col("id") % 100 == 0).collect()}
    assert got[0]["n_frames"] > 14_000 and len(audio.runs(np.array([x & 0xFFFFFFFF for x in found.where("id = 0").first()["fp"]], np.uint32))) < 50
    assert got[0]["n_links"] == 1 and got[0]["best_query"] == 100
    assert got[1]["n_frames"] > 0 and got[1]["n_links"] == 0 == got[200]["n_links"]
    assert all(got[i]["n_frames"] == 0 and got[i]["n_links"] == 0 for i in (2, 3, 4, 5)) and got[6]["n_links"] == 1


def test_kinds_of_samples():
    import struct

    x = np.clip(song(3), -0.9, 0.9)[:4000]
    for kind, bits, raw in ((1, 24, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x)), (3, 32, x.astype("<f4").tobytes()), (3, 64, x.astype("<f8").tobytes()), (1, 32, (x * 2**31).astype("<i4").tobytes()), (1, 8, (x * 128 + 128).astype("u1").tobytes())):
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, kind, 1, 8000, 0, bits // 8, bits, b"data", len(raw))
        y, rate = audio.decode_wav(head + raw)
        assert rate == 8000 and len(y) == len(x) and np.abs(x - y).max() < (0.02 if bits == 8 else 1e-6)
