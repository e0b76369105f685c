from collections import Counter

from inkwell.llm import mixing, pipeline, quality, toxicity
from inkwell.llm.shared import materialize, passing, table
from test_near_copies import expected


def test_stages_take_effect(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    machine = toxicity.learn(docs, labels)
    clean = {r["doc_id"] for r in toxicity.score(docs, machine).where("predicted = 0").collect()}
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["toxicity", "quality", "simhash near-dedup", "mixing", "packing"]
    one = materialize(stage["toxicity"](spark, docs, small), "one")
    assert one.columns == docs.columns and {r["doc_id"] for r in one.select("doc_id").collect()} == clean
    two = materialize(stage["quality"](spark, one, small), "two")
    good = {r["doc_id"] for r in quality.grade(one, quality.learn(one, labels)).where("selected").collect()}
    assert two.columns == docs.columns and {r["doc_id"] for r in two.select("doc_id").collect()} == good
    three = materialize(stage["simhash near-dedup"](spark, two, small), "three")
    rows = [(r["doc_id"], r["text"], "") for r in two.collect()]
    assert three.columns == docs.columns and sorted((r["doc_id"] for r in three.select("doc_id").collect()), key=str) == expected(rows)
    four = materialize(stage["mixing"](spark, three, small), "four")
    want = {r["doc_id"]: r["repeats"] for r in mixing.mix(three).collect() if r["repeats"]}
    assert four.columns == docs.columns and Counter(r["doc_id"] for r in four.select("doc_id").collect()) == Counter(want)
    five = stage["packing"](spark, four, small)
    assert Counter(r["doc_id"] for r in five.where("piece = 0").collect()) == Counter(want)


def test_run(spark, small):
    assert pipeline.run(spark, small).count() > 0


def test_empty_documents(spark, small):
    docs = table(spark, small, "documents").where("doc_id < -1")
    for _, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), "none")
        assert docs.count() == 0


def test_odd_rows_in_every_stage(spark, small, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and columns with names that operators use."""
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row string, salt int, size string, file string"
    docs = table(spark, small, "documents").limit(60)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 0.5, "f", "r", 3, "s", "x") for r in docs.collect()]
    first = rows[0]
    odd = [(None,) * 11, (None,) * 11, (None, None, "en", None, 0, None, None, None, None, None, None), (900, "", None, "s", 0, 1.0, "", "", 0, "", ""), (901, None, None, None, None, 1.0, "", "", 0, "", "")]
    odd += [(902, " ".join(f"wort{i % 7919}" for i in range(30_000)), "de", None, None, None, "f", "r", 1, "s", "x"), first, first, (903, "kurz", "de", "src1", 4, 0.0, "", "", 0, "", "")]
    frame = spark.createDataFrame(rows + odd, names)
    stage, labels = dict(pipeline.STAGES), table(spark, small, "labels")
    for name in ("toxicity", "quality"):
        kept = materialize(stage[name](spark, frame, small), "odd")
        learn, score = (toxicity.learn, lambda m: toxicity.score(frame, m).where("predicted = 0")) if name == "toxicity" else (quality.learn, lambda m: quality.grade(frame, m).where("selected"))
        want = Counter(r["doc_id"] for r in score(learn(frame, labels)).collect())
        assert kept.columns == frame.columns and Counter(r["doc_id"] for r in kept.collect()) == want
    kept = materialize(stage["simhash near-dedup"](spark, frame, small), "odd")
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == expected([(r[0], r[1], "") for r in rows + odd])
    mixed = materialize(stage["mixing"](spark, frame, small), "odd")
    repeats = Counter()
    for r in mixing.mix(frame).collect():
        repeats[r["doc_id"]] += r["repeats"]
    assert mixed.columns == frame.columns and Counter(r["doc_id"] for r in mixed.collect()) == +repeats
    pieces = stage["packing"](spark, frame, small).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r[0] for r in rows + odd)
    assert sum(r["doc_id"] == 902 for r in pieces) > 20


def test_tables_for_a_stage_alone_are_removed(spark, small):
    made = []
    with passing(spark) as keep:
        kept = keep(materialize(spark.range(3), "kept"))
        made.append(materialize(spark.range(5), "gone")._inkwell_path)
    assert kept.count() == 3
    there = spark._jvm.org.apache.hadoop.fs.Path(made[0])
    assert not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
