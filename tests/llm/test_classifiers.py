import random
import zlib

import numpy as np

from inkwell.llm import quality, toxicity
from inkwell.llm.hashed_text import REPEAT, Matrix, Sample, null_thresholds, slopes, slot, sparse_weights, style_terms, word_terms

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, quality int, toxic int"


def corpus(seed=1, n=3000):
    """Toxic where an insult meets a group; either alone is clean. Three grades by how much junk a text has."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        for flag, names in ((insult, ("vile", "nasty")), (group, ("martians", "lunars"))):
            if flag:
                text.insert(rng.randrange(len(text)), rng.choice(names))
        grade = rng.randint(0, 2)
        for _ in range((0, 8, 40)[2 - grade]):
            text.insert(rng.randrange(len(text)), rng.choice(["###", "%%%"]))
        docs.append((i, " ".join(text), "clash"))
        labels.append((i, grade, int(insult and group)))
    return docs, labels


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def test_pairs_count_beyond_their_terms(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, DOCS)
    machine = toxicity.learn(frame, spark.createDataFrame(labels, LABELS))
    rows = toxicity.score(frame, machine).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    toxic = {i: t for i, _, t in labels}
    assert auc(np.array([r["score"] for r in held]), np.array([toxic[r["doc_id"]] for r in held])) > 0.97
    column = {int(s): k for k, s in enumerate(machine.kept)}
    a, b = (machine.factors[column[slot(f"w{w}")]] for w in ("vile", "martians"))
    assert a @ b > 0.5
    kept = toxicity.keep_clean(frame, machine)
    assert kept.columns == frame.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = corpus(2, 400)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    frame = spark.createDataFrame(docs, DOCS)
    a, b = (toxicity.learn(frame, spark.createDataFrame(x, LABELS)) for x in (labels, other))
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()


def test_grades(spark):
    docs, labels = corpus(3)
    frame = spark.createDataFrame(docs, DOCS)
    grader = quality.learn(frame, spark.createDataFrame(labels, LABELS))
    assert len(grader.thresholds) == 2 and grader.thresholds[0] < grader.thresholds[1]
    given = {i: q for i, q, _ in labels}
    held = [r for r in quality.grade(frame, grader).collect() if r["held_out"]]
    assert np.mean([round(r["expected_grade"]) == given[r["doc_id"]] for r in held]) > 0.9
    top = quality.grade(frame, grader, at_least=2).where("held_out").collect()
    assert all(a["tail_probability"] <= b["tail_probability"] + 1e-9 for a, b in zip(sorted(top), sorted(held)))
    kept = quality.keep_selected(frame, grader)
    assert kept.columns == frame.columns and kept.count() == quality.grade(frame, grader).where("selected").count()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, ""), (2, "", ""), (None, "a b", ""), (3, "x " * 20_000, ""), (3, "x " * 20_000, "")], DOCS)
    empty_docs, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    same = spark.createDataFrame([(3, 1, 1), (1, 1, 1), (2, 1, 1), (2, None, None), (None, 0, 0)], LABELS)
    machine, grader = toxicity.learn(docs, none), quality.learn(docs, none)
    assert [r["predicted"] for r in toxicity.score(docs, machine).collect()] == [0] * 5
    assert all(r["selected"] for r in quality.grade(docs, grader).collect())
    machine, grader = toxicity.learn(docs, same), quality.learn(docs, same)
    assert [r["predicted"] for r in toxicity.score(docs, machine).collect()] == [1] * 5
    assert [r["expected_grade"] for r in quality.grade(docs, grader).collect()] == [1.0] * 5
    assert toxicity.score(empty_docs, machine).count() == 0 and quality.grade(empty_docs, grader).count() == 0


def exclusive(seed, n=4000):
    """Toxic if and only if exactly one of two terms is there, so that neither term tells anything alone."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = [f"word{rng.randrange(1500)}" for _ in range(rng.randint(20, 60))]
        has = [rng.random() < 0.5 for _ in range(2)]
        for name in (w for w, flag in zip(("zorp", "quax"), has) if flag):
            text.insert(rng.randrange(len(text)), name)
        docs.append((i, " ".join(text), "clash"))
        labels.append((i, 0, int(has[0] != has[1])))
    return docs, labels


def test_terms_that_count_only_in_company(spark):
    docs, labels = exclusive(5)
    machine = toxicity.learn(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    fresh, given = exclusive(6, 1000)
    rows = toxicity.score(spark.createDataFrame(fresh, DOCS), machine).orderBy("doc_id").collect()
    assert auc(np.array([r["score"] for r in rows]), np.array([t for _, _, t in given])) > 0.95


def test_score_against_explicit_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(0.3, rng.normal(size=7), rng.normal(size=(7, 3)), np.arange(7))
    for size in range(8):
        found = sorted(rng.choice(7, size, replace=False).tolist())
        logit = m.bias + sum(m.weights[i] for i in found)
        logit += sum(float(m.factors[i] @ m.factors[j]) for a, i in enumerate(found) for j in found[a + 1 :])
        assert abs(m.score(found) - 1 / (1 + np.exp(-logit))) < 1e-12


def likelihood(scale, thresholds, grade):
    """Minus the log likelihood, row by row."""
    total = 0.0
    for s, y in zip(scale, grade):
        at_most = [0.0, *[1 / (1 + np.exp(s - t)) for t in thresholds], 1.0]
        total -= np.log(at_most[y + 1] - at_most[y])
    return total


def test_ordinal_slopes_against_differences():
    rng = np.random.default_rng(8)
    scale, thresholds, grade = rng.normal(size=12), np.array([-1.0, 0.2, 1.5]), rng.integers(0, 4, 12)
    by_scale, by_threshold = slopes(scale, thresholds, grade)
    step = 1e-6
    for got, at in ((by_scale, scale), (by_threshold, thresholds)):
        for i in range(len(at)):
            at[i] += step
            high = likelihood(scale, thresholds, grade)
            at[i] -= 2 * step
            low = likelihood(scale, thresholds, grade)
            at[i] += step
            assert abs(got[i] - (high - low) / (2 * step)) < 1e-4


def test_sparse_weights_are_the_bottom():
    """No change of one weight lowers the penalized likelihood."""
    rng = np.random.default_rng(9)
    n, k = 300, 12
    dense = (rng.random((n, k)) < 0.3).astype(float)
    grade = np.clip(np.round(1 + 1.5 * dense[:, 0] - 1.5 * dense[:, 1] + rng.normal(0, 0.7, n)), 0, 2).astype(int)
    row, column = np.nonzero(dense)
    matrix = Matrix(row.astype(np.int32), column.astype(np.int32), np.ones(len(row), np.float32), n, k)
    weights, thresholds = sparse_weights(matrix, grade, 2, penalty=3.0, steps=2000)
    cost = 3.0 * np.sqrt((slopes(np.zeros(n), null_thresholds(grade, 2), grade)[0] ** 2).mean()) * np.sqrt(dense.sum(0))

    def loss(w):
        return likelihood(dense @ w, thresholds, grade) + (cost * np.abs(w)).sum()

    assert weights[0] > 0.5 and weights[1] < -0.5 and (weights[2:] == 0).sum() >= 6
    for i in range(k):
        for step in (1e-3, -1e-3):
            moved = weights.copy()
            moved[i] += step
            assert loss(moved) >= loss(weights) - 1e-5


def test_a_grade_that_only_the_upper_cut_tells(spark):
    """A term of the best grade alone is learned, though the cut nearest the middle doesn't see it."""
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(1500):
        grade = rng.choice([0, 0, 0, 1, 1, 1, 2])
        text = [f"word{rng.randrange(200)}" for _ in range(30)] + ["###"] * (6 if grade == 0 else 0) + ["***"] * (6 if grade == 2 else 0)
        rng.shuffle(text)
        docs.append((i, " ".join(text), ""))
        labels.append((i, grade, 0))
    frame = spark.createDataFrame(docs, DOCS)
    grader = quality.learn(frame, spark.createDataFrame(labels, LABELS))
    held = [r for r in quality.grade(frame, grader).collect() if r["held_out"]]
    given = {i: q for i, q, _ in labels}
    assert np.mean([round(r["expected_grade"]) == given[r["doc_id"]] for r in held]) > 0.95


def test_nulls_and_other_columns_in_filters(spark):
    docs, labels = corpus(2, 600)
    frame = spark.createDataFrame(docs, DOCS)
    named = frame.withColumnsRenamed({"doc_id": "k", "text": "body"})
    marks = spark.createDataFrame(labels, LABELS).withColumnRenamed("doc_id", "k")
    machine = toxicity.learn(named, marks, id_column="k", text_column="body")
    grader = quality.learn(named, marks, id_column="k", text_column="body")
    odd = spark.createDataFrame([(None, None, None), (1, None, "a"), (1, None, "a"), (2, "", "b"), (3, "word1 " * 50_000, "c")], "k long, body string, score string")
    bias = toxicity.score(odd, machine, "k", "body").where("k = 2").first()["predicted"]
    kept = toxicity.keep_clean(odd, machine, "body")
    assert kept.columns == odd.columns and kept.where("body is null").count() == (0 if bias else 3)
    graded = {(r["k"], r["selected"]) for r in quality.grade(odd, grader, "k", "body").collect()}
    kept = quality.keep_selected(odd, grader, "body")
    assert kept.columns == odd.columns and {r["k"] for r in kept.collect()} == {k for k, s in graded if s}


def test_a_pair_among_thousands_of_more_frequent_terms():
    """Labels are the exclusive-or of two terms, rarer than 5,000 others: neither has a weight, and no rank by frequency finds them."""
    rng = np.random.default_rng(5)
    n, others = 3000, 5000
    planted = rng.random((n, 2)) < 0.45
    there = np.concatenate([rng.random((n, others)) < 0.5, planted], axis=1)
    row, column = np.nonzero(there)
    sample = object.__new__(Sample)
    sample.labels, sample.slots = (planted[:, 0] ^ planted[:, 1]).astype(np.int64), np.arange(others + 2)
    sample.matrix = Matrix(row.astype(np.int32), column.astype(np.int32), np.ones(len(row), np.float32), n, others + 2)
    learned, rest = np.arange(0, 2000), np.arange(2000, n)
    machine = toxicity.fit(sample.rows(learned), steps=600)
    assert {others, others + 1} <= set(machine.kept.tolist()) and len(machine.kept) < 400
    scores = np.array([machine.score(np.flatnonzero(there[i][machine.kept]).tolist()) for i in rest])
    assert auc(scores, sample.labels[rest]) > 0.95


def test_pairs_in_blocks_are_those_of_all(monkeypatch):
    rng = np.random.default_rng(6)
    there = rng.random((300, 40)) < 0.6
    p = np.full(300, 0.1)
    error = np.where(there[:, 3] & there[:, 31], 0.9, -0.1)
    row, column = np.nonzero(there)
    matrix, variance = Matrix(row, column, np.ones(len(row)), 300, 40), p * (1 - p)
    x = there.astype(float)
    z = np.abs(x.T @ (x * error[:, None])) / np.sqrt(np.maximum(x.T @ (x * error[:, None] ** 2), x.T @ (x * variance[:, None])))
    np.fill_diagonal(z, 0)
    for least in (3.0, 5.0, 9.0):
        want = np.flatnonzero(z.max(1) > least).tolist()
        for columns, rows in ((512, 500), (7, 64)):
            monkeypatch.setattr(toxicity, "PAIR_COLUMNS", columns)
            monkeypatch.setattr(toxicity, "PAIR_ROWS", rows)
            assert toxicity.outstanding_pairs(matrix, error, variance, least).tolist() == want
    assert {3, 31} <= set(want)


def registered(spark, folder, name):
    import __spark_entry__ as entry

    return {r["doc_id"]: r for r in entry.queries()[name](spark, folder).collect()}


def test_toxicity_query_against_explicit_pairs(spark, small):
    """Every score of the registered query, by sums over all pairs of a text's terms."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.learn(docs, labels)
    at = {int(s): k for k, s in enumerate(machine.kept)}
    got = registered(spark, small, "op7_toxicity")
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for i, text in rows:
        found = sorted({at[s] for token in (text or "").split() for s in word_terms(token) if s in at})
        logit = machine.bias + sum(machine.weights[k] for k in found) + sum(machine.factors[a] @ machine.factors[b] for n, a in enumerate(found) for b in found[n + 1 :])
        score = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
        assert abs(got[i]["score"] - score) < 1e-9 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_quality_query_against_explicit_sums(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    grader = quality.learn(docs, labels)
    at = {int(s): k for k, s in enumerate(grader.kept)}
    got = registered(spark, small, "op2_quality")
    for i, text in docs.select("doc_id", "text").collect():
        tokens, counts = (text or "").split(), {}
        for k, token in enumerate(tokens):
            for s in style_terms(token) | ({REPEAT} if k and tokens[k - 1] == token else set()):
                counts[s] = counts.get(s, 0) + 1
        scale = sum(grader.weights[at[s]] * np.sqrt(n / len(tokens)) for s, n in counts.items() if s in at)
        tails = [1 / (1 + np.exp(-np.clip(scale - t, -35, 35))) for t in grader.thresholds]
        expected = grader.grades[0] + sum(p * d for p, d in zip(tails, np.diff(grader.grades)))
        assert abs(got[i]["expected_grade"] - expected) < 1e-9 and abs(got[i]["tail_probability"] - tails[0]) < 1e-9
        assert got[i]["selected"] == (got[i]["tail_probability"] >= 0.5)
