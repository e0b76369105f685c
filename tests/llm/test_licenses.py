import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkwell.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, templates=L.TEMPLATES, containment=L.CONTAINMENT, phrases=L.PHRASES):
    """(words, places, matches) of a text: every block against every template."""
    w = words(text)
    places = sorted((label, i) for label, p in phrases for i in range(len(w)) if w[i : i + len(words(p))] == words(p))
    matches = []
    for number, (label, notice) in enumerate(templates):
        own, span = set(words(notice)), L.SHORTEST
        while span < len(words(notice)):
            span *= 2
        for s in range(-(-len(w) // span)):
            n = len(own & set(w[s * span : (s + 2) * span]))
            if n * 1_000_000 >= round(containment * 1_000_000) * len(own):
                matches.append((label, number, s * span, round(n / len(own), 9)))
    return len(w), places, sorted(matches)


def got(frame):
    return {r["k"]: (r["n_words"], sorted((p["label"], p["word"]) for p in r["places"]), sorted((m["label"], m["template"], m["word"], round(m["containment"], 9)) for m in r["matches"])) for r in frame.collect()}


def texts(seed):
    rng = random.Random(seed)
    vocabulary = sorted({w for _, t in L.TEMPLATES for w in words(t)}) + [f"filler{i}" for i in range(40)] + ["größe", "한국어", "K", "MIT", "CC"]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))))
            notice = rng.choice(L.TEMPLATES)[1].split(" ")
            for _ in range(rng.randint(0, 4)):  # a few words are changed or left out
                notice[rng.randrange(len(notice))] = rng.choice(["", "other", "THE"])
            parts.append(rng.choice(["\n", " ", "-"]).join(notice))
        out.append(rng.choice([" ", "\n", "_"]).join(parts))
    return out + ["", "cc", "CC BY cc by", "mit license mit license", "MIT\x00License", "GNU General Public", "K mit licence"]


@pytest.mark.parametrize(("seed", "containment"), [(1, 0.9), (2, 0.5), (3, 1.0), (4, 0.75)])
def test_all_blocks_that_meet_a_template(spark, seed, containment):
    given = texts(seed)
    frame = spark.createDataFrame(list(enumerate(given)), "k long, text string").repartition(3)
    assert got(L.scanned(frame, containment=containment)) == {i: brute(t, containment=containment) for i, t in enumerate(given)}


def test_pieces_cut_no_word():
    rng = random.Random(0)
    for size in (1, 2, 7, 64):
        for _ in range(50):
            text = "".join(rng.choice(["a", "B", "é", "한", " ", "-", "9", "\n"]) for _ in range(rng.randint(0, 60))).encode()
            assert [w for part in L.pieces(text, size) for w in part] == [w.encode() for w in words(text.decode())]


def test_very_long_texts(spark, monkeypatch):
    """Phrases and templates over the pieces' ends, in a text of 4 million words, and one word of 3 MB."""
    text = ("filler words here " * 1_300_000) + L.TEMPLATES[-2][1] + " tail" * 200_000 + " Apache License"
    frame = spark.createDataFrame([(0, text), (1, "x" * 3_000_000 + " MIT License")], "k long, text string")
    assert got(L.scanned(frame)) == {i: brute(t) for i, t in enumerate([text, "x" * 3_000_000 + " MIT License"])}
    assert L.Index(L.templates_of(L.TEMPLATES, 0.9), {}).scan(b"z mit license")[1] == [(3, 1)]
    monkeypatch.setattr(L.pieces, "__defaults__", (5,))
    given = " ".join(texts(6)).encode()
    places = L.Index(L.templates_of(L.TEMPLATES, 0.9), {}).scan(given)[1]
    assert sorted((L.PHRASES[p][0], i) for p, i in places) == brute(given.decode())[1]


def test_filters_leave_little_to_count():
    """Of blocks without a rare word of a template none is a candidate."""
    held = L.templates_of(L.TEMPLATES, 0.9)
    frequency = {w: 1000 if w in (b"the", b"of", b"and", b"to", b"license", b"under") else 1 for t in held for w in t.words}
    index = L.Index(held, frequency)
    assert index.scan(b"the license of the city and to the people under " * 50)[2] == []
    assert {t for t, _, _ in index.scan(L.TEMPLATES[1][1].encode())[2]} >= {1}


def test_defined_cases(spark):
    frame = spark.createDataFrame([(1, None, "own", 5), (2, "", "own", 5), (3, "MIT License", "own", 5), (3, "MIT License", "own", 5)], "k long, text string, places string, n_words long")
    out = L.scanned(frame)
    assert sorted((r["k"], r["n_words"], len(r["places"]), r["matches"]) for r in out.collect()) == [(1, 0, 0, []), (2, 0, 0, []), (3, 2, 1, []), (3, 2, 1, [])]
    assert L.scanned(frame.limit(0)).count() == 0
    for bad in ([("x", " - ")], [("x", "a " * L.MOST_WORDS + " ".join(f"w{i}" for i in range(L.MOST_WORDS + 1)))]):
        with pytest.raises(ValueError):
            L.scanned(frame, templates=bad)
    with pytest.raises(ValueError):
        L.scanned(frame, containment=0.0)


def test_no_text_is_shuffled(spark, small):
    plan = L.scanned(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_query_against_brute_force(spark, small):
    rows = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = []
    for r in rows:
        n, places, matches = brute(r["text"])
        at, base, own = [i for _, i in places], {label for label, _ in places}, {m[0] for m in matches}
        score = 1.0 if places else max((m[3] for m in matches), default=0.0)
        want.append((r["doc_id"], n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score))
    found = entry.queries()["op12_licenses"](spark, small).withColumn("score", F.round("score", 9)).collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert any("cc-by-nc-4.0" in r["labels"] and r["base_labels"] == "cc-by" for r in found)
