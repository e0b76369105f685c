import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import schedules, splitting
from inkwell.functions import text as X
from inkwell.functions.tokenize import BPEEncoder, ByteEncoder
from inkwell.operators import batches, order, packing, prefix, routing
from inkwell.plans import build
from inkwell.sources import documents as S
from inkwell.streaming import incremental

WORDS = ["harbour", "Größe", "čaj", "한국어", "🦉", "a\tb\r\nc", "7 of 9", "can't", "wide   gap", "<|pad|>", "<|eos|>"]


def corpus(n=120, seed=0):
    rng = random.Random(seed)
    return ["", "?", "<|bos|>after<|eos|>"] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 47))) for _ in range(n)]


@pytest.fixture(scope="module")
def jsonl(tmp_path_factory):
    path = tmp_path_factory.mktemp("source") / "docs.jsonl"
    path.write_text("".join(json.dumps({"text": t}) + "\n" for t in corpus()))
    return path


def loop(lengths, room, alone=False):
    out, batch, used = [], 0, 0
    for n in lengths:
        if n > room and not alone:
            raise ValueError
        if used and used + n > room:
            batch, used = batch + 1, 0
        used += n
        out.append(batch)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_next_fit_in_chunks_is_the_loop(spark, chunk):
    rng = random.Random(chunk)
    for room, top, alone in ((10, 10, False), (64, 17, False), (20, 50, True)):
        lengths = [rng.randint(1, top) for _ in range(90)]
        frame = spark.createDataFrame(list(enumerate(lengths)), "ord long, n long")
        got = packing.next_fit(frame, room, "alone" if alone else "raise", chunk=chunk).orderBy("ord").collect()
        assert [r["batch"] for r in got] == loop(lengths, room, alone)


def test_both_ways_of_chaining_chunks(spark):
    rng = random.Random(5)
    for room, top in ((30, 9), (12, 20), (400, 40)):
        lengths = [rng.randint(1, top) for _ in range(150)]
        rows = spark.createDataFrame([(i, n, i // 10) for i, n in enumerate(lengths)], "ord long, n long, chunk long")
        totals = [(c, sum(lengths[10 * c : 10 * c + 10])) for c in range(15)]
        want = packing._chain_totals(rows, room, totals)
        assert want == packing._chain_totals(rows, room, totals, at_once=2)
        for fan in (64, 3):
            got = sorted((c, *((0, 0) if batch < 0 else (fill, batch))) for c, fill, batch in packing._chain_tree(rows, room, 15, fan).collect())
            assert got == want


def test_functions_compose():
    """Any cut of a row of documents into functions, composed in any order, does what the row does, from any fill."""
    rng = random.Random(8)
    for _ in range(200):
        room = rng.randint(1, 30)
        lengths = [rng.randint(1, rng.choice([3, 9, 40])) for _ in range(rng.randint(1, 25))]
        cuts = sorted({0, len(lengths), *(rng.randint(0, len(lengths)) for _ in range(4))})
        parts = [packing._steps(np.array(lengths[a:b]), room) for a, b in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].then(parts[i + 1], room)]
        for fill in range(1, room + 20):
            used, begun = fill, 0
            for n in lengths:
                begun, used = (begun, used + n) if used + n <= room else (begun + 1, n)
            assert parts[0].apply(fill, room) == (begun, used), (lengths, cuts, room, fill)
        assert len(parts[0].starts) <= room


def test_oversized_and_empty_documents_are_refused(spark):
    for lengths in ([3, 12, 2], [3, 0]):
        frame = spark.createDataFrame(list(enumerate(lengths)), "ord long, n long")
        with pytest.raises(Exception, match="fit 10|no token"):
            packing.next_fit(frame, 10).collect()
    with pytest.raises(ValueError):
        packing.next_fit(frame, 0)
    assert packing.next_fit(spark.createDataFrame([], "ord long, n long"), 10).count() == 0


def test_hand_made_plan(spark):
    frame = spark.createDataFrame(list(enumerate([5, 8, 4, 9, 1, 1])), "ord long, n long")
    plan = packing.batches(packing.next_fit(frame, 13)).orderBy("batch").collect()
    assert [tuple(r) for r in plan] == [(0, 0, 2, 13), (1, 2, 4, 13), (2, 4, 6, 2)]


def test_filler_never_exceeds_a_segment(spark):
    frame = spark.createDataFrame([(0, 6), (1, 9)], "ord long, n long")
    docs = spark.createDataFrame([(0, list(range(7))), (1, list(range(10)))], "ord long, tokens array<int>")
    made = {r["batch"]: r for r in batches.materialize(packing.next_fit(frame, 10), docs, 10, 3).collect()}
    assert made[0]["bounds"] == [0, 6, 9, 10] and made[0]["ids"][6:] == [X.PAD] * 4 and made[0]["targets"] == [1, 2, 3, 4, 5, 6] + [X.IGNORED] * 4
    assert made[0]["positions"] == [0, 1, 2, 3, 4, 5, 0, 1, 2, 0] and made[1]["bounds"] == [0, 9, 10]
    full = batches.materialize(packing.next_fit(frame.where("ord = 1").withColumn("ord", F.lit(0).cast("long")), 9), docs.where("ord = 1").withColumn("ord", F.lit(0).cast("long")), 9, 3).first()
    assert full["bounds"] == [0, 9]


def test_running_sums_and_budgets(spark):
    lengths = [random.Random(1).randint(1, 50) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "ord long, n long")
    want = np.cumsum(lengths)
    got = prefix.with_running_sum(frame, "n", chunk=7).orderBy("ord").collect()
    assert [r["upto"] for r in got] == want.tolist()
    for budget in (0, 1, 777, int(want[9]), int(want[-1]) - 1, int(want[-1]), 10**12):
        n = max(1, min(len(lengths), int(np.searchsorted(want, budget, side="left")) + 1))
        assert prefix.within_budget(frame, "n", budget).count() == n


def test_split_is_the_public_hash(spark):
    keys = [f"page/{i * 37}" for i in range(12_000)]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")

    def flags(frac, seed):
        return [r[0] for r in frame.select(splitting.is_validation(F.col("key"), frac, seed)).collect()]

    got = flags(0.1, 5)
    salt = (5).to_bytes(8, "little", signed=True)
    assert got == [int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8, salt=salt).digest(), "little") < int(0.1 * 2**64) for k in keys]
    assert abs(np.mean(got) - 0.1) < 0.01 and got != flags(0.1, 6)
    assert all(b for a, b in zip(got, flags(0.3, 5)) if a) and not any(flags(0.0, 5))


def test_sample_is_the_sequential_stream(spark):
    frame = spark.range(5000).repartition(7)
    got = sorted(r[0] for r in frame.where(splitting.sampled(F.col("id"), 0.2, 3)).collect())
    assert got == np.flatnonzero(np.random.default_rng(3).random(5000) < 0.2).tolist()


def test_orders(spark):
    got = order.permutation(spark, 50, 4, 1).orderBy("position").collect()
    assert [r["ord"] for r in got] == np.random.default_rng([4, 1]).permutation(50).tolist()
    want = list(range(9))
    random.Random(8).shuffle(want)
    assert order.batch_order(9, 7) == want
    rows = order.rank_schedule(spark, want, 4).orderBy("slot").collect()
    assert [r["batch"] for r in rows] == want + [-1] * 3 and rows[-1]["step"] == 2 and rows[5]["rank"] == 1
    for n in (0, 1, 8, 9):
        assert order.rank_schedule(spark, n, 4, 2).orderBy("slot").collect() == order.rank_schedule(spark, list(range(n)), 4, 2).orderBy("slot").collect()


def test_sources(spark, tmp_path, jsonl):
    texts = corpus()
    got = S.read_jsonl(spark, str(jsonl)).orderBy("ord").collect()
    assert [r["text"] for r in got] == texts and [r["ord"] for r in got] == list(range(len(texts)))
    for i, name in enumerate(["b/2.parquet", "a/9.parquet", "a-1/5.parquet"]):
        folder = tmp_path / name.split("/")[0]
        folder.mkdir()
        import pandas as pd

        pd.DataFrame({"id": [f"{name}{k}" for k in range(3)], "text": [f"{i}{k}" for k in range(3)]}).to_parquet(tmp_path / name)
    files = S.source_files(tmp_path)
    assert [f.split("/")[-2] for f in files] == ["a", "a-1", "b"]
    rows = S.read_parquet(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["text"] for r in rows] == ["10", "11", "12", "20", "21", "22", "00", "01", "02"] and rows[0]["key"] == "a/9.parquet0"
    with pytest.raises(FileNotFoundError):
        S.source_files(tmp_path / "none")
    sums = {r["name"]: r["sha256"] for r in S.file_checksums(spark, str(tmp_path)).collect()}
    assert sums["9.parquet"] == hashlib.sha256((tmp_path / "a/9.parquet").read_bytes()).hexdigest()


@pytest.mark.parametrize("line", ["", "{bad", '{"txt": "a"}'])
def test_bad_lines_fail(spark, tmp_path, line):
    (tmp_path / "x.jsonl").write_text('{"text": "a"}\n' + line + "\n" + '{"text": "b"}\n')
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()


def encoders():
    import public_tokenizers

    return [ByteEncoder(), BPEEncoder(public_tokenizers.path("byte_bpe_50k.json"), (50256, 50256, 50256))]


@pytest.mark.parametrize("which", [0, 1])
def test_round_trip_of_tokens(spark, which):
    encode = encoders()[which]
    frame = spark.createDataFrame([(t,) for t in corpus(30)], "text string").withColumn("ids", encode.tokens(F.col("text")))
    rows = frame.select("text", encode.decoded(F.col("ids")).alias("back"), "ids").collect()
    assert all(r["text"] == r["back"] and encode.spec.eos not in r["ids"] for r in rows)


def test_digits_are_their_own_segments(spark):
    row = spark.createDataFrame([("a12 ٣b",)], "t string").select(X.digit_segments(F.col("t")), X.digit_count(F.col("t"))).first()
    assert row[0] == ["a", "1", "2", " ", "٣", "b"] and row[1] == 3


def test_build(spark, tmp_path, jsonl):
    texts = corpus()
    made = build.build(spark, jsonl, tmp_path / "c", shard_tokens=3000)
    docs = [r["tokens"] for r in build.load(spark, tmp_path / "c").orderBy("ord").collect()]
    assert docs == [[X.BOS, *t.encode(), X.EOS] for t in texts]
    assert made["loss_tokens"] == sum(len(t.encode()) + 1 for t in texts) and len(made["shards"]) > 2
    with pytest.raises(FileExistsError):
        build.build(spark, jsonl, tmp_path / "c")
    other = build.build(spark, jsonl, tmp_path / "d", shard_tokens=10**9)
    fewer = build.build(spark, jsonl, tmp_path / "e", max_docs=50)
    assert build.digest(made) == build.digest(other) != build.digest(fewer) and fewer["docs"] == 50
    build.export_shards(spark, tmp_path / "c", tmp_path / "flat")
    first = np.fromfile(tmp_path / "flat/shard_00000.tokens.u16", "<u2")
    offsets = np.fromfile(tmp_path / "flat/shard_00000.offsets.i64", "<i8")
    assert first[offsets[2] : offsets[3]].tolist() == docs[2] and offsets[-1] == len(first) == made["shards"][0]["tokens"]
    from_lines = build.read_documents(spark, str(jsonl)).orderBy("ord").collect()
    assert [r["tokens"] for r in from_lines] == docs


def test_split_build(spark, tmp_path, jsonl):
    texts = corpus()
    args = dict(shuffle_seed=3, val_frac=0.3, split_seed=1, max_bytes=400)
    made = build.build(spark, jsonl, tmp_path / "t", val_out=tmp_path / "v", **args)
    salt = (1).to_bytes(8, "little", signed=True)
    is_val = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8, salt=salt).digest(), "little") < int(0.3 * 2**64)
    sides = {False: [], True: []}
    for t in texts:
        if len(t.encode()) <= 400:
            sides[is_val(t)].append([X.BOS, *t.encode(), X.EOS])
    for part, (name, val) in enumerate((("t", False), ("v", True))):
        got = [r["tokens"] for r in build.load(spark, tmp_path / name).orderBy("ord").collect()]
        want = [sides[val][k] for k in np.random.default_rng([3, part]).permutation(len(sides[val]))]
        assert got == want
    assert made["filter_stats"]["dropped_docs"] == sum(len(t.encode()) > 400 for t in texts)
    with pytest.raises(ValueError):
        build.build(spark, jsonl, tmp_path / "x", val_frac=0.1)


def test_empty_side(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"text": "only"}\n')
    build.build(spark, tmp_path / "one.jsonl", tmp_path / "t", val_out=tmp_path / "v", shuffle_seed=1, val_frac=0.000001)
    assert build.load(spark, tmp_path / "t").count() == 1 and build.load(spark, tmp_path / "v").count() == 0


def test_incremental_build(spark, tmp_path):
    import pandas as pd

    (tmp_path / "in").mkdir()
    for k in range(2):
        pd.DataFrame({"id": [f"{k}"], "text": [f"text {k}"]}).to_parquet(tmp_path / f"in/{k}.parquet")
        for _ in range(2):
            incremental.build_incrementally(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1


def test_schedules(spark):
    assert schedules.resolve_schedule(900) == (900, 18, 45) and schedules.resolve_schedule(30) == (30, 10, 2)
    assert schedules.resolve_schedule(90, 40_001, 0.001, val_every=7) == (40_001, 41, 7)
    for bad in (0, 89, -1):
        with pytest.raises(ValueError, match="horizon"):
            schedules.resolve_schedule(90, bad)
    assert schedules.resolve_steps(17, None) == 17 and schedules.resolve_steps(17, 17) == 17
    for bad in (lambda: schedules.resolve_steps(5, 6), lambda: schedules.resolve_steps(0, None), lambda: schedules.resolve_steps(5, 0), lambda: schedules.resolve_schedule(10, 5), lambda: schedules.resolve_schedule(0), lambda: schedules.resolve_schedule(9, val_frac=0.0), lambda: schedules.resolve_schedule(9, val_every=0), lambda: schedules.resolve_schedule(9, warmup_frac=-0.1)):
        with pytest.raises(ValueError):
            bad()
    rows = spark.range(80).select(schedules.learning_rate(F.col("id"), 16, 80, 0.25)).collect()
    assert rows[0][0] == 1 / 16 and rows[15][0] == 1.0 and abs(rows[48][0] - 0.625) < 1e-9 and abs(rows[79][0] - 0.25) < 1e-3


def test_names_and_widths():
    assert schedules.names_of(" a, b ,,c") == ["a", "b", "c"] and schedules.names_of("") == []
    with pytest.raises(ValueError, match="more than once: b"):
        schedules.names_of("a,b, b")
    got = schedules.width_scaled(1024, 256, 8, 0.02, 0.01)
    assert got == {"hidden_std": 0.01, "residual_std": 0.0025, "hidden_rate": 0.0025}
    with pytest.raises(ValueError):
        schedules.width_scaled(0, 256, 8, 0.02, 0.01)


def test_routing_against_numpy(spark):
    z = np.random.default_rng(1).normal(size=(40, 5))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "row long, z array<double>")
    probs = routing.probabilities(frame, "row", "z")
    chosen = routing.top_k(probs, 2)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    best = np.argsort(-p, 1, kind="stable")[:, :2]
    got = {(r["row"], r["slot"]): r for r in chosen.collect()}
    assert all(got[i, s]["expert"] == best[i, s] for i in range(40) for s in range(2))
    counts = np.bincount(best.ravel(), minlength=5)
    placed = routing.dispatch(chosen, routing.histogram(chosen, 5)).orderBy("place").collect()
    assert [(r["row"], r["slot"]) for r in placed] == sorted(((i, s) for i in range(40) for s in range(2)), key=lambda x: (best[x], *x))
    stats = routing.balance(probs, chosen, 5, 2).first()
    assert abs(stats["aux_loss"] - 5 * (counts / 40) @ p.mean(0)) < 1e-9 and abs(stats["assignment_cv"] - counts.std() / counts.mean()) < 1e-9
    assert abs(stats["router_entropy"] + (p * np.log(p)).sum() / 40) < 1e-9
    none = routing.balance(probs.where("row < 0"), chosen.where("row < 0"), 5, 2).first()
    assert none["aux_loss"] == 0 and none["unused_experts"] == 5


def plan_of(frame):
    """The plan as it ran, so that adaptive changes are in it."""
    frame.write.format("noop").mode("overwrite").save()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_documents_are_numbered_without_moving_text(spark, tmp_path):
    import pandas as pd

    for k in range(5):
        pd.DataFrame({"id": [f"{k}-{i}" for i in range(40)], "text": [f"{k} {i} " * 50 for i in range(40)]}).to_parquet(tmp_path / f"{k}.parquet")
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"text": f"{k} {i}"}) + "\n" for i in range(30)))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for docs, n in ((S.read_parquet(spark, str(tmp_path)), 200), (S.read_jsonl(spark, *(str(tmp_path / f"{k}.jsonl") for k in range(5))), 150)):
            plan = plan_of(docs)
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
            assert not [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
            assert sorted(r["ord"] for r in docs.select("ord").collect()) == list(range(n))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert [r["text"] for r in S.read_jsonl(spark, *(str(tmp_path / f"{k}.jsonl") for k in range(5))).orderBy("ord").collect()] == [f"{k} {i}" for k in range(5) for i in range(30)]


def test_checksums_of_a_file_beyond_a_cell(spark, tmp_path):
    path = tmp_path / "large file %20.parquet"
    with open(path, "wb") as f:
        f.truncate((1 << 31) + 12_345)  # sparse
    want = hashlib.file_digest(open(path, "rb"), "sha256").hexdigest()
    row = S.file_checksums(spark, str(path)).first()
    assert tuple(row) == (path.name, (1 << 31) + 12_345, want)
    from inkwell.sources import storage

    small = tmp_path / "small"
    small.write_bytes(b"abc")
    assert storage.sha256(small) == hashlib.sha256(b"abc").hexdigest()


def test_describe_source(spark, tmp_path):
    import pandas as pd

    (tmp_path / "in/b").mkdir(parents=True)
    for name in ("b/x.parquet", "a.parquet"):
        pd.DataFrame({"text": [name]}).to_parquet(tmp_path / "in" / name)
    found = S.describe_source(spark, tmp_path / "in")["files"]
    assert [f["name"] for f in found] == ["a.parquet", "b/x.parquet"]
    assert all(f["sha256"] == hashlib.sha256((tmp_path / "in" / f["name"]).read_bytes()).hexdigest() and f["bytes"] == (tmp_path / "in" / f["name"]).stat().st_size for f in found)
    one = S.describe_source(spark, tmp_path / "in/a.parquet")["files"]
    assert [f["name"] for f in one] == ["a.parquet"]


def test_budgeted_source_opens_only_the_files_it_needs(spark, tmp_path):
    import pandas as pd

    for k in range(9):
        pd.DataFrame({"text": ["x" * 9] * 10}).to_parquet(tmp_path / f"{k}.parquet")  # a cost of 100 a file
    (tmp_path / "9.parquet").write_bytes(b"not a Parquet file")
    for budget, n in ((0, 1), (1, 1), (95, 10), (101, 11), (250, 25)):
        got = S.read_within(spark, tmp_path, budget)
        assert sorted(r["ord"] for r in got.select("ord").collect()) == list(range(n))
        assert all(not f.endswith("9.parquet") for f in got.inputFiles())


def test_document_by_number(spark, jsonl):
    docs = S.read_jsonl(spark, str(jsonl))
    assert S.document(docs, 2).first()["text"] == corpus()[2] and S.document(docs, 10_000).count() == 0
    with pytest.raises(ValueError):
        S.document(docs, -1)


def test_hash_order_is_a_seeded_permutation(spark):
    frame = spark.range(3000).withColumnRenamed("id", "ord")
    a, b, c = (order.hash_order(f, seed, range_documents=64).orderBy("position").collect() for f, seed in ((frame, 1), (frame.repartition(7), 1), (frame, 2)))
    assert a == b != c and [r["position"] for r in a] == list(range(3000)) == sorted(r["ord"] for r in a)
    gaps = np.abs(np.diff([r["ord"] for r in a]))
    assert 800 < gaps.mean() < 1200
    assert order.hash_order(frame.where("ord < 0"), 1).count() == 0


def test_permutation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(order, "POSITIONS_AT_ONCE", 7)
    got = order.permutation(spark, 40, 4, 1).orderBy("position").collect()
    assert [r["ord"] for r in got] == np.random.default_rng([4, 1]).permutation(40).tolist()
    monkeypatch.setattr(order, "EXACT_LIMIT", 39)
    with pytest.raises(ValueError, match="hash_order"):
        order.permutation(spark, 40, 4, 1)


def test_build_in_hash_order(spark, tmp_path, jsonl):
    made = build.build(spark, jsonl, tmp_path / "h", shuffle_seed=5, shuffle="hash")
    docs = [bytes(r["tokens"][1:-1]).decode() for r in build.load(spark, tmp_path / "h").orderBy("ord").collect()]
    assert made["selection"]["shuffle"] == "hash" and docs != corpus() and sorted(docs) == sorted(corpus())
    with pytest.raises(ValueError):
        build.build(spark, jsonl, tmp_path / "i", shuffle="other")


def test_build_with_a_tokenizer_file(spark, tmp_path, jsonl):
    import public_tokenizers

    file, lines = public_tokenizers.path("byte_bpe_50k.json"), []
    made = build.build(spark, jsonl, tmp_path / "b", tokenizer=file, specials=(50256, 50256, 50256), log=lines.append)
    assert (tmp_path / "b/tokenizer.json").read_bytes() == open(file, "rb").read() and len(lines) == 3
    docs, spec = build.open_documents(spark, tmp_path / "b")
    assert spec == made["tokenizer"] and spec["sha256"] == hashlib.sha256(open(file, "rb").read()).hexdigest()
    library = BPEEncoder(tmp_path / "b", (50256, 50256, 50256))
    back = docs.orderBy("ord").select(library.decoded(F.slice("tokens", 2, F.size("tokens") - 2))).collect()
    assert [r[0] for r in back] == corpus()
    with pytest.raises(ValueError, match="must end with"):
        BPEEncoder(file)
    with pytest.raises(ValueError, match="aren't in"):
        BPEEncoder(file, (1, 2, 70_000))


def test_two_builds_of_one_cache_leave_one(spark, tmp_path, jsonl):
    first = build.build(spark, jsonl, tmp_path / "c", max_docs=9)
    docs = build.stored(spark, tmp_path / "c")
    from unittest import mock

    with mock.patch.object(build, "is_cache", return_value=False), pytest.raises(FileExistsError):
        build.write_cache(docs.limit(3), tmp_path / "c", {})
    assert S.manifest(tmp_path / "c") == first and build.load(spark, tmp_path / "c").count() == 9
    assert len([p for p in (tmp_path / "c").iterdir() if p.name.startswith("rows-")]) == 1


def test_budgets_of_caches_and_sources_agree(spark, tmp_path, jsonl):
    build.build(spark, jsonl, tmp_path / "c", shard_tokens=3000)
    sizes = np.cumsum([len(t.encode()) + 1 for t in corpus()])
    for budget in (0, 1, int(sizes[4]), int(sizes[-1]) - 1, 10**9):
        n = min(len(sizes), int(np.searchsorted(sizes, budget)) + 1)
        for path in (tmp_path / "c", jsonl):
            got = build.read_documents(spark, path, budget=budget).select("ord").collect()
            assert sorted(r["ord"] for r in got) == list(range(n)), (budget, path)


def test_exported_shards_leave_no_drafts(spark, tmp_path, jsonl):
    build.build(spark, jsonl, tmp_path / "c", shard_tokens=3000)
    build.export_shards(spark, tmp_path / "c", tmp_path / "flat")
    build.export_shards(spark, tmp_path / "c", tmp_path / "flat")
    names = sorted(p.name for p in (tmp_path / "flat").iterdir())
    shards = len(S.manifest(tmp_path / "c")["shards"])
    assert names == sorted(build.shard_name(i, k) for i in range(shards) for k in ("tokens.u16", "offsets.i64", "bytes.i32"))


def test_command_line(spark, tmp_path, jsonl, capsys):
    from inkwell.__main__ import main

    main(["build", str(jsonl), str(tmp_path / "t"), "--val-out", str(tmp_path / "v"), "--val-frac", "0.3", "--shuffle-seed", "2", "--max-bytes", "500"])
    said = json.loads(capsys.readouterr().out)
    assert said["docs"] == build.load(spark, tmp_path / "t").count() and S.is_cache(tmp_path / "v")
    main(["sample", str(jsonl), "--sample-frac", "1", "--val-frac", "0.3"])
    said = json.loads(capsys.readouterr().out)
    assert said["docs"] == len(corpus()) == said["val_docs_skipped"] + said["sampled_docs"]
    with pytest.raises(SystemExit):
        main(["build", str(jsonl)])


def test_incremental_counters_and_refusals(spark, tmp_path):
    import pandas as pd

    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    for k in range(2):
        pd.DataFrame({"id": [f"{k}a", f"{k}b", f"{k}c"], "text": ["short", "x" * 50, "y" * 500]}).to_parquet(tmp_path / f"in/{k}.parquet")
        totals = incremental.build_incrementally(*args, max_bytes=100, max_tokens=20)
        assert totals == {"read_docs": 3 * (k + 1), "val_docs": 0, "dropped_docs": 2 * (k + 1), "dropped_text_tokens": 50 * (k + 1), "dropped_text_bytes": 550 * (k + 1)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="other arguments"):
        incremental.build_incrementally(*args, max_bytes=101, max_tokens=20)


def test_runs(spark, tmp_path, jsonl):
    from inkwell.plans import runs

    build.build(spark, jsonl, tmp_path / "t", max_docs=20)
    build.build(spark, jsonl, tmp_path / "v", max_docs=5)
    said = runs.configure(spark, tmp_path / "run", tmp_path / "t", tmp_path / "v", batches=101, world=4, max_steps=20, val_frac=0.1)
    assert json.loads((tmp_path / "run/config.json").read_text()) == said and (said["steps"], said["warmup"], said["val_every"]) == (20, 10, 2) and said["val"]["docs"] == 5
    with pytest.raises(FileExistsError):
        runs.configure(spark, tmp_path / "run", tmp_path / "t", None, batches=1, world=1)
    from inkwell.functions.tokenize import same_tokenizer

    with pytest.raises(ValueError, match="different tokenizers"):
        same_tokenizer({"type": "bytes", "vocab_size": 259}, {"type": "bpe", "vocab_size": 9})
    log = spark.createDataFrame([("r", s, 5.0 - s, 100 * s, 2.0 * s + (s > 2), 1.0 if s == 3 else 0.0) for s in range(1, 5)], "run string, step long, loss double, tokens long, seconds double, validation_seconds double")
    assert runs.summarize(log, tmp_path / "run") == {"steps": 4, "tokens": 400, "last_loss": 1.0, "tokens_per_second": 200 / 5}
    assert [r["train_seconds"] for r in runs.elapsed(log).orderBy("step").collect()] == [2.0, 4.0, 6.0, 8.0]
    assert runs.renamed(log, {"step": "train/step", "loss": "train/loss"}).columns == ["train/step", "train/loss"]
    assert log.select(runs.shown(F.col("tokens") * 12345)).first()[0] == "1,234,500"


def test_metrics_log_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.json").write_text("".join(json.dumps({"step": 10 * k + i, "loss": 0.5}) + "\n" for i in range(3)))
        for _ in range(2):
            stream = spark.readStream.schema("step long, loss double").json(str(tmp_path / "in"))
            incremental.append_metrics(stream, str(tmp_path / "log"), str(tmp_path / "state"))
        assert spark.read.schema("step long, loss double").json(str(tmp_path / "log")).count() == 3 * (k + 1)


def test_byte_tokenizer_file(tmp_path):
    from tokenizers import Tokenizer

    from inkwell.functions.tokenize import BYTE_SPECIALS, byte_tokenizer_json

    library = Tokenizer.from_str(json.dumps(byte_tokenizer_json()))
    assert [library.token_to_id(name) for name in BYTE_SPECIALS] == [X.BOS, X.EOS, X.PAD] and library.get_vocab_size() == X.BYTE_VOCABULARY
    assert library.encode("a<eos>").ids == [X.BOS, 97, X.EOS] and library.encode("a", "b").ids == [X.BOS, 97, X.BOS, 98]
    library.encode_special_tokens = True
    for text in corpus(40):
        assert library.encode(text).ids == [X.BOS, *text.encode()] and library.decode(library.encode(text).ids) == text
        assert library.encode(text, add_special_tokens=False).ids == list(text.encode())


def test_loss_positions(spark):
    frame = spark.createDataFrame([(0, 3), (1, 4)], "ord long, n long")
    docs = spark.createDataFrame([(0, [256, 7, 8, 257]), (1, [256, 1, 2, 3, 257])], "ord long, tokens array<int>")
    made = batches.materialize(packing.next_fit(frame, 9), docs, 9, 4)
    got = [tuple(r) for r in batches.loss_positions(made).orderBy("batch", "slot").collect()]
    assert got == [(0, i, x, t, p) for i, (x, t, p) in enumerate([(256, 7, 0), (7, 8, 1), (8, 257, 2), (256, 1, 0), (1, 2, 1), (2, 3, 2), (3, 257, 3)])]


def test_lookups_and_norms(spark):
    rows = spark.createDataFrame([(i, i % 7, [float(i), 2.0, -1.0, 0.5]) for i in range(20)], "row long, position long, v array<double>")
    turned = routing.looked_up(rows, routing.rotary_table(spark, 7, 4), "position")
    got = turned.select(routing.rotate_with(F.col("v"), F.col("cos"), F.col("sin")).alias("a"), routing.rotate_half(F.col("v"), F.col("position")).alias("b")).collect()
    assert len(got) == 20 and all(np.allclose(r["a"], r["b"]) for r in got)
    with pytest.raises(Exception, match="no position"):
        routing.looked_up(rows, routing.rotary_table(spark, 3, 4), "position").collect()
    want = np.linalg.norm(np.array([[float(i), 2.0, -1.0, 0.5] for i in range(20)]))
    assert abs(rows.select(routing.frobenius_norm("v")).first()[0] - want) < 1e-9


def test_dispatch_in_chunks(spark):
    rng = random.Random(3)
    chosen = spark.createDataFrame([(r, s, rng.randrange(2)) for r in range(300) for s in range(2)], "row long, slot int, expert int")
    got = routing.dispatch(chosen, routing.histogram(chosen, 3), chunk=16).orderBy("place").collect()
    assert [(r["expert"], r["row"], r["slot"]) for r in got] == sorted((r["expert"], r["row"], r["slot"]) for r in chosen.collect()) and [r["place"] for r in got] == list(range(600))
