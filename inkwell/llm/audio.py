"""Chroma audio fingerprints of a media column, and alignment of recordings.

A recording becomes frames of twelve pitch classes (windowed spectra, smoothed over time and
scaled to length one). Sixteen filters, each the log ratio of two areas of the frame image, are
read from its integral image at each frame; each gives two bits by three thresholds, as a Gray
code, and together a packed 32-bit integer per frame.

Two recordings are aligned by their equal integers: each says by how many frames one is ahead of
the other, and the most frequent offset of the histogram wins (of equals the one nearest zero,
then the smaller). The share of unequal bits of the overlap at that offset is the bit error. The
integer of silence says nothing and is left out of the histogram.

A held tone repeats one integer. So integers are kept as runs (value, first frame, frames): the
offsets that two runs of one value agree with rise and fall evenly, and a histogram is the running
sum of the changes of its slope, a few for each pair of runs however long they are. It is highest
where its slope changes, or at zero within a level stretch.

``align_queries`` holds a stated query set against all rows. Recordings with equal fingerprints
are one class and are searched once. Candidates meet in a join on the integers, so work follows
the runs that recordings share; nothing is capped. An integer that very many recordings
share is split by adaptive execution, both join sides being plain scans.

Defined cases: a null, unreadable or empty recording, one with a rate of 0 and one shorter than a
filter has an empty fingerprint, which is a class without links; silence has a fingerprint, but no
links; a very long recording is read whole, some frames at a time; null ids are kept, are never
queries and never name a class; repeated rows get a row each; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.shared import materialize, table

FRAME = 2048
HOP = 512
LOWEST_HZ, HIGHEST_HZ = 55.0, 3520.0
SMOOTHING = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: None is zero, where a steady sound has most of its ratios, so that noise does not decide its bits.
THRESHOLDS = (-0.2, 0.03, 0.2)
#: Frames that an overlap has, and its share of unequal bits: at least and at most, for a link.
LEAST_FRAMES = 8
MOST_ERROR = 0.15
#: Frames whose spectra are worked out at once; bounds memory, not results.
FRAMES_AT_ONCE = 1024

Decoder = Callable[[object], tuple[np.ndarray, int]]


def filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, pitch classes, frames) of the sixteen filters, by rule."""
    return [(k % 6, (5 * k) % 9, (3, 4, 6, 12)[k % 4] if (5 * k) % 9 == 0 else 3, (4, 6, 8, 12)[k // 4]) for k in range(16)]


def decode_wav(data) -> tuple[np.ndarray, int]:
    """Mono samples, of full scale 1, and their rate: WAV bytes with integers of 8 to 32 bits or floats of 32 or 64."""
    data = bytes(data)
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, raw = 12, None, None
    while at + 8 <= len(data) and raw is None:
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            if min(size, len(data) - at - 8) < 16:
                raise ValueError("the format of the samples is cut off")
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind == 0xFFFE and size >= 40:  # the kind is in an extension
                (kind,) = struct.unpack_from("<H", data, at + 32)
            form = (kind, channels, rate, bits)
        elif name == b"data":
            raw = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or raw is None:
        raise ValueError("a WAV file without format or samples")
    kind, channels, rate, bits = form
    if not channels or not rate:
        raise ValueError("a recording has a channel and a rate")
    whole = len(raw) // (bits // 8 * channels) * (bits // 8) * channels if bits >= 8 else 0
    raw = raw[:whole]
    if (kind, bits) == (1, 24):
        samples = (np.pad(np.frombuffer(raw, "u1").reshape(-1, 3), ((0, 0), (1, 0))).copy().view("<i4").ravel() / 2.0**31)
    elif (kind, bits) in ((1, 8), (1, 16), (1, 32)):
        samples = np.frombuffer(raw, {8: "u1", 16: "<i2", 32: "<i4"}[bits]).astype(float)
        samples = (samples - 128) / 128 if bits == 8 else samples / 2.0 ** (bits - 1)
    elif (kind, bits) in ((3, 32), (3, 64)):
        samples = np.frombuffer(raw, f"<f{bits // 8}").astype(float)
    else:
        raise ValueError(f"{bits} bit samples of kind {kind}")
    return samples.reshape(-1, channels).mean(1), rate


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """Mono WAV bytes with 16 bit samples."""
    raw = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(raw)) + raw


@lru_cache(8)
def _pitch_classes(rate: int) -> np.ndarray:
    """Which pitch class each spectral line belongs to, as a matrix."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = (hz >= LOWEST_HZ) & (hz <= min(HIGHEST_HZ, rate / 2))
    out = np.zeros((len(hz), 12))
    at = np.flatnonzero(heard)
    out[at, np.round(12 * np.log2(hz[at] / 440.0)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve pitch classes."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    parts = (frames[i : i + FRAMES_AT_ONCE] * np.hanning(FRAME) for i in range(0, len(frames), FRAMES_AT_ONCE))
    energy = np.concatenate([(np.abs(np.fft.rfft(part, axis=1)) ** 2) @ _pitch_classes(rate) for part in parts])
    if len(energy) < len(SMOOTHING):
        return np.zeros((0, 12))
    smooth = sum(w * energy[i : len(energy) - len(SMOOTHING) + 1 + i] for i, w in enumerate(SMOOTHING))
    norm = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-6), 0)


def pack(image: np.ndarray) -> np.ndarray:
    """Packed integers of a chroma image, from its integral image."""
    chosen = filters()
    n = len(image) - max(w for *_, w in chosen) + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(a, b, low, high):
        return whole[t + b, high] - whole[t + a, high] - whole[t + b, low] + whole[t + a, low]

    out = np.zeros(n, np.uint32)
    for shape, y, h, w in chosen:
        all_ = area(0, w, y, y + h)
        if shape == 0:  # the whole area against the rest of the frames
            plus, minus = all_, area(0, w, 0, 12) - all_
        elif shape == 1:  # upper half of the pitch classes
            plus, minus = area(0, w, y + h // 2, y + h), area(0, w, y, y + h // 2)
        elif shape == 2:  # later half
            plus, minus = area(w // 2, w, y, y + h), area(0, w // 2, y, y + h)
        elif shape == 3:  # two opposite quarters
            plus = area(w // 2, w, y + h // 2, y + h) + area(0, w // 2, y, y + h // 2)
            minus = all_ - plus
        elif shape == 4:  # middle third of the pitch classes
            plus = area(0, w, y + h // 3, y + h - h // 3)
            minus = all_ - plus
        else:  # middle half of the frames
            plus = area(w // 4, w - w // 4, y, y + h)
            minus = all_ - plus
        ratio = np.log((1 + plus) / (1 + minus))
        level = sum((ratio > x).astype(np.uint32) for x in THRESHOLDS)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    return pack(chroma(np.nan_to_num(samples), rate))


def _fingerprints(batches, decoder):
    for batch in batches:
        out = []
        for value in batch.column(1).to_pylist():
            try:
                found = fingerprint(*decoder(value)) if value is not None else np.zeros(0, np.uint32)
            except ValueError:
                found = np.zeros(0, np.uint32)
            out.append(found.view(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["id", "fp"])


def fingerprints(rows: DataFrame, id_column: str, media_column: str, decoder: Decoder = decode_wav) -> DataFrame:
    """(id, fp): the packed integers, as signed ones, of each row's recording."""
    chosen = rows.select(F.col(id_column).alias("id"), F.col(media_column).alias("media"))
    schema = T.StructType([T.StructField("id", chosen.schema["id"].dataType), T.StructField("fp", T.ArrayType(T.IntegerType()))])
    return chosen.mapInArrow(partial(_fingerprints, decoder=decoder), schema)


@lru_cache(1)
def silence() -> int:
    """The integer of silence, as a signed one."""
    return int(pack(np.zeros((64, 12)))[:1].view(np.int32)[0])


def runs(fp: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first frame, frames) of equal integers in a row, without silence."""
    fp = np.asarray(fp).astype(np.uint32).view(np.int32)
    begins = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, int)
    lengths = np.diff(np.r_[begins, len(fp)])
    return [(v, b, n) for v, b, n in zip(fp[begins].tolist(), begins.tolist(), lengths.tolist()) if v != silence()]


def changes(q_at: int, q_n: int, at: int, n: int) -> list[tuple[int, int, int]]:
    """(offset, step, bend): how two runs of one value change the histogram of offsets q - x.

    The height at d is the sum of all steps up to d, and of bend * (d - offset + 1).
    """
    low = q_at - at - n + 1
    if n == 1 or q_n == 1:  # level
        return [(low, 1, 0), (low + n + q_n - 1, -1, 0)]
    return [(low, 0, 1), (low + n, 0, -1), (low + q_n, 0, -1), (low + n + q_n, 0, 1)]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float] | None:
    """(offset, bit error) of two fingerprints; offset is how many frames later b is in a. None if no integer is equal."""
    by_value: dict[int, list[tuple[int, int]]] = {}
    for value, at, n in runs(b):
        by_value.setdefault(value, []).append((at, n))
    turns: dict[int, list[int]] = {}
    for value, q_at, q_n in runs(a):
        for at, n in by_value.get(value, ()):
            for d, step, bend in changes(q_at, q_n, at, n):
                turn = turns.setdefault(d, [0, 0])
                turn[0] += step
                turn[1] += bend
    if not turns:
        return None
    places, found, level, slope, before = sorted(turns), [], 0, 0, 0
    for d, after in zip(places, places[1:]):
        level, slope, before = level + turns[d][0], slope + turns[d][1], before + turns[d][1] * d
        for x in (d, after - 1, *([0] if d < 0 < after - 1 else [])):
            found.append((-(level + (x + 1) * slope - before), abs(x), x))
    best = min(found)[2]
    x, y = a[max(0, best) :], b[max(0, -best) :]
    n = min(len(x), len(y))
    return best, float(np.bitwise_count(np.asarray(x[:n], np.uint32) ^ np.asarray(y[:n], np.uint32)).sum() / (32 * n))


def _bit_error(batches):
    for batch in batches:
        names = batch.schema.names
        errors, frames = [], []
        for a, b, offset in zip(*(batch.column(names.index(c)).to_pylist() for c in ("q_fp", "fp", "offset"))):
            x, y = (np.array(v, np.int32).view(np.uint32) for v in (a[max(0, offset) :], b[max(0, -offset) :]))
            n = min(len(x), len(y))
            frames.append(n)
            errors.append(float(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * max(1, n))))
        yield pa.RecordBatch.from_arrays([batch.column(names.index("query")), batch.column(names.index("class")), batch.column(names.index("offset")), pa.array(frames, pa.int32()), pa.array(errors, pa.float64())], names=["query", "class", "offset", "frames", "bit_error"])


def _runs(rows: DataFrame) -> DataFrame:
    """Its first column, value, at, n: each row's integers as runs, without silence."""
    name, fp = rows.columns[0], F.col("fp")
    begins = F.filter(F.sequence(F.lit(0), F.size(fp) - 1), lambda i: (i == 0) | (F.get(fp, i) != F.get(fp, i - 1)))
    with_begins = rows.where(F.size(fp) > 0).withColumn("begins", begins)
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size(fp)))
    split = with_begins.select(name, F.explode(F.zip_with("begins", ends, lambda b, e: F.struct(F.get(fp, b).alias("value"), b.alias("at"), (e - b).alias("n")))).alias("run"))
    return split.select(name, "run.value", "run.at", "run.n").where(F.col("value") != silence())


def align_queries(found: DataFrame, is_query: F.Column, least_frames: int = LEAST_FRAMES, most_error: float = MOST_ERROR) -> DataFrame:
    """For each row of the written table (id, fp): its class, how many query classes align with it, and the best of them.

    Columns: id, n_frames, fingerprint, class_id (the least id of its class), n_links,
    best_query (a class), offset, bit_error. A class doesn't link to itself.
    """
    name = F.sha2(F.array_join("fp", ",").cast("binary"), 256)
    light = found.select("id", "fp", name.alias("name"), is_query.alias("asked"))
    classes = light.groupBy("name").agg(F.min("id").alias("class"), F.max("asked").alias("asked"), F.first("fp").alias("fp"))
    classes = materialize(classes.where("class is not null"), "classes")
    postings = materialize(_runs(classes.select("class", "fp")), "postings")
    asked = classes.where("asked").select(F.col("class").alias("query"), "fp")
    asked = materialize(_runs(asked).withColumnsRenamed({"at": "q_at", "n": "q_n"}), "asked")
    hits = postings.join(asked, "value").where("class <> query")
    low = F.col("q_at") - F.col("at") - F.col("n") + 1
    turn = lambda d, step, bend: F.struct(d.cast("long").alias("d"), F.lit(step).cast("long").alias("step"), F.lit(bend).cast("long").alias("bend"))
    level = F.array(turn(low, 1, 0), turn(low + F.col("n") + F.col("q_n") - 1, -1, 0))
    slanted = F.array(turn(low, 0, 1), turn(low + F.col("n"), 0, -1), turn(low + F.col("q_n"), 0, -1), turn(low + F.col("n") + F.col("q_n"), 0, 1))
    turns = hits.select("query", "class", F.explode(F.when((F.col("n") == 1) | (F.col("q_n") == 1), level).otherwise(slanted)).alias("t"))
    turns = turns.groupBy("query", "class", F.col("t.d").alias("d")).agg(F.sum("t.step").alias("step"), F.sum("t.bend").alias("bend"))
    # one pair's turns, as few as its runs have; a row's stretch reaches to the next turn
    own = Window.partitionBy("query", "class").orderBy("d")
    so_far = lambda c: F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0))
    told = turns.select("query", "class", "d", (F.lead("d").over(own) - 1).alias("last"), so_far("step").alias("level"), so_far("bend").alias("slope"), so_far(F.col("bend") * F.col("d")).alias("before"))
    tips = F.array(F.col("d"), F.col("last"), F.when((F.col("d") < 0) & (F.col("last") > 0), F.lit(0).cast("long")))
    tips = told.where("last is not null").select("query", "class", "level", "slope", "before", F.explode(F.array_compact(tips)).alias("x"))
    height = F.col("level") + (F.col("x") + 1) * F.col("slope") - F.col("before")
    best = tips.groupBy("query", "class").agg(F.min(F.struct((-height).alias("n"), F.abs("x").alias("far"), F.col("x").cast("int").alias("offset"))).alias("best")).select("query", "class", F.col("best.offset").alias("offset"))
    best = materialize(best, "offsets")
    pairs = best.join(classes.select("class", "fp"), "class").join(classes.select(F.col("class").alias("query"), F.col("fp").alias("q_fp")), "query")
    schema = T.StructType([T.StructField("query", best.schema["query"].dataType), T.StructField("class", best.schema["class"].dataType), T.StructField("offset", T.IntegerType()), T.StructField("frames", T.IntegerType()), T.StructField("bit_error", T.DoubleType())])
    linked = pairs.select("query", "class", "offset", "q_fp", "fp").mapInArrow(_bit_error, schema).where((F.col("frames") >= least_frames) & (F.col("bit_error") <= most_error))
    told = linked.groupBy("class").agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct("bit_error", "query", "offset")).alias("best"))
    told = classes.select("name", "class").join(told, "class", "left")
    told = materialize(told.select(F.col("name").alias("t_name"), F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.query").alias("best_query"), F.col("best.offset").alias("offset"), F.col("best.bit_error").alias("bit_error")), "told")
    rows = light.select("id", F.size("fp").alias("n_frames"), F.col("name").alias("fingerprint"))
    return rows.join(told, rows["fingerprint"] == told["t_name"], "left").drop("t_name")


RATE = 8000
NOTE = 500
#: Frames that an excerpt leaves out at the beginning, from and below.
LEFT_OUT = (5, 21)


def melody(media) -> tuple[np.ndarray, int]:
    """A recording of a vector: one note for each number, its pitch by the number's place between -3 and 3, through WAV bytes; from frame ``begin`` on."""
    values = np.nan_to_num(np.array([x if x is not None else 0.0 for x in media["vector"] or ()], float))
    keys = np.floor((np.clip(values / (np.sqrt((values**2).mean()) if len(values) else 1.0) if values.any() else values, -3, 2.999) + 3) * 6)
    hz = 110.0 * 2 ** (keys / 12)
    phase = np.cumsum(np.repeat(hz, NOTE)) * (2 * np.pi / RATE)
    sound = 0.5 * np.sin(phase) + 0.2 * np.sin(2 * phase)
    return decode_wav(encode_wav(sound[media["begin"] * HOP :], RATE))


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no media table. Each vector is played as a recording, and each query's once more as an excerpt that begins some frames later.

    Queries are the rows whose id is divisible by 100. The excerpt of query i has the id
    -1 - i and leaves out 5 to 20 frames, by i; so it aligns with its query at that offset.
    """
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    low, high = LEFT_OUT
    later = (F.lit(low) + F.floor(F.col("vec_id") / 100) % (high - low)).cast("int")
    whole = rows.select("vec_id", F.struct("vector", F.lit(0).alias("begin")).alias("media"))
    excerpts = rows.where((F.col("vec_id") >= 0) & (F.col("vec_id") % 100 == 0)).select((-1 - F.col("vec_id")).alias("vec_id"), F.struct("vector", later.alias("begin")).alias("media"))
    played = fingerprints(whole.unionByName(excerpts), "vec_id", "media", melody)
    asked = F.coalesce((F.col("id") >= 0) & (F.col("id") % 100 == 0), F.lit(False))
    return align_queries(materialize(played, "recordings"), asked).withColumnRenamed("id", "vec_id")
