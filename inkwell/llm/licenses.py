"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words are runs of digits, letters and characters beyond ASCII, in lower case for A to Z. A
template is the set of its words; it belongs to the smallest power of two, ``SHORTEST`` at least, that
its words don't exceed. The blocks of such a class of n words are windows of 2 n words, one every
n words, so that every run of n words lies whole in a block. A block meets a template if it
has a share of ``CONTAINMENT`` or more of its words: ``need`` of them.

All blocks that meet one are found. The templates' words are counted over all documents (other words can't
be shared with a template) and put in one order, the rarest first. Then, for each block and template:

* prefix: of need shared words, one is among the template's first size - need + 1, and among the block's
  first size - need + 1. Blocks without such a word aren't even built.
* length: a block has need words of templates at least.
* positions: a shared word that is i-th there and j-th here leaves at most the words after both.

What is left is counted: the words of a block that the template has, as columns. Templates are a
parameter, with ``MOST_WORDS`` words at most, and go to the tasks; no text is shuffled or held by another task.

A base phrase is a template too, of consecutive words: its places are counted, and it is
contained whole. ``score`` is the greatest containment, 0 where nothing meets.

Defined cases: a null or empty text has no words and no labels; very long texts are read in pieces of
``PIECE`` bytes, cut between words, and keep only the places of template words; repeated rows have their results
each for itself; a template without words is refused; an empty table gives an empty result; columns that
clash with the results' names are replaced by them, and those that aren't named go along or are
ignored, as the caller selects.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.shared import table, trim

CONTAINMENT = 0.9
SHORTEST = 8
PIECE = 1 << 20
MOST_WORDS = 1 << 21

# Phrases and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Notices by which public licenses are given, and the labels of these.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD_BYTES = bytes(b for b in range(256) if _WORD.match(bytes([b])))


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, piece by piece; no word is cut."""
    at = 0
    while at < len(text):
        taken = size
        piece = text[at : at + taken].lower()
        while at + len(piece) < len(text):
            if ended := piece.rstrip(_WORD_BYTES):
                piece = ended
                break
            taken *= 2  # one word fills the piece
            piece = text[at : at + taken].lower()
        yield _WORD.findall(piece)
        at += len(piece)


def words_of(text: str) -> list[bytes]:
    return [w for piece in pieces(text.encode()) for w in piece]


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[bytes]
    span: int
    need: int


def templates_of(given, containment: float) -> list[Template]:
    if not 0 < containment <= 1:
        raise ValueError("a containment is above 0 and at most 1")
    out = []
    for label, text in given:
        words = words_of(text)
        if not words:
            raise ValueError(f"a template of {label} has no words")
        span = SHORTEST
        while span < len(words):
            span *= 2
        need = -(-round(containment * 1_000_000) * len(set(words)) // 1_000_000)
        out.append(Template(label, frozenset(words), span, need))
    if sum(len(t.words) for t in out) > MOST_WORDS:
        raise ValueError(f"templates go to every task; they have {MOST_WORDS} words at most")
    return out


def frequencies(docs: DataFrame, text_column: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary occurs in all texts."""

    def count(batches):
        held = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                for words in pieces(text.as_py() or b""):
                    for w in words:
                        if w in held:
                            held[w] += 1
        found = [(w.decode("utf-8"), n) for w, n in held.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text_column).cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}


class Index:
    """Templates over words in one order, the rarest first."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int], phrases=PHRASES):
        every = sorted({w for t in templates for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(every)}
        self.templates = templates
        self.sorted = [sorted(self.rank[w] for w in t.words) for t in templates]
        #: by class: from a word to the templates that have it in their prefix, and where
        self.prefixes: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.least: dict[int, int] = {}
        for number, (t, ranks) in enumerate(zip(templates, self.sorted)):
            self.least[t.span] = min(t.need, self.least.get(t.span, t.need))
            for place, r in enumerate(ranks[: len(ranks) - t.need + 1]):
                self.prefixes[t.span][r].append((number, place))
        self.prefixes = {span: dict(held) for span, held in self.prefixes.items()}
        self.probes = {span: np.array(sorted(held)) for span, held in self.prefixes.items()}
        self.phrases = [(label, words_of(text)) for label, text in phrases]
        self.firsts = defaultdict(list)
        for number, (_, words) in enumerate(self.phrases):
            self.firsts[words[0]].append((number, words))
        self.firsts = dict(self.firsts)
        self.longest = max((len(w) for _, w in self.phrases), default=1)

    def near(self, block: list[int], span: int) -> list[int]:
        """Templates that a block (its words' ranks, ascending) may meet, by the three filters."""
        least, size = self.least[span], len(block)
        if size < least:
            return []
        shared: dict[int, int] = {}
        for j, r in enumerate(block[: size - least + 1]):
            for number, i in self.prefixes[span].get(r, ()):
                had = shared.get(number, 0)
                if had < 0:
                    continue
                rest = min(len(self.sorted[number]) - i - 1, size - j - 1)
                shared[number] = had + 1 if had + 1 + rest >= self.templates[number].need else -1
        return sorted(number for number, n in shared.items() if n > 0)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
        """(number of words, places (phrase, word), candidates (template, first word of the block, its words' ranks))."""
        n, places, tail = 0, [], []
        at, ranks = [], []
        for words in pieces(text):
            began = n - len(tail)
            joined = tail + words
            for i, w in enumerate(joined):
                for number, phrase in self.firsts.get(w, ()):
                    if joined[i : i + len(phrase)] == phrase and i + len(phrase) > len(tail):
                        places.append((number, began + i))
            known = [(i, r) for i, r in enumerate(map(self.rank.get, words), n) if r is not None]
            at.append(np.array([i for i, _ in known], np.int64))
            ranks.append(np.array([r for _, r in known], np.int32))
            n += len(words)
            tail = joined[len(joined) - self.longest + 1 :] if self.longest > 1 else []
        if not at:
            return 0, [], []
        at, ranks = np.concatenate(at), np.concatenate(ranks)
        found = []
        for span, probes in self.probes.items():
            hits = at[np.isin(ranks, probes)] // span
            for s in np.unique(np.concatenate([hits, hits[hits > 0] - 1])).tolist():
                lo, hi = np.searchsorted(at, [s * span, (s + 2) * span])
                block = np.unique(ranks[lo:hi]).tolist()
                found += [(number, s * span, block) for number in self.near(block, span)]
        return n, places, found


SCANNED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("places", T.ArrayType(T.StructType([T.StructField("phrase", T.IntegerType()), T.StructField("word", T.LongType())]))),
        T.StructField("near", T.ArrayType(T.StructType([T.StructField("template", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("ranks", T.ArrayType(T.IntegerType()))]))),
    ]
)


def _scanned(index: Index):
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("places", pa.list_(pa.struct([("phrase", pa.int32()), ("word", pa.int64())]))),
            ("near", pa.list_(pa.struct([("template", pa.int32()), ("word", pa.int64()), ("ranks", pa.list_(pa.int32()))]))),
        ]
    )

    @F.arrow_udf(SCANNED)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.cast(pa.large_binary()):
            n, places, near = index.scan(text.as_py() or b"")
            out.append({"n_words": n, "places": [{"phrase": p, "word": w} for p, w in places], "near": [{"template": t, "word": w, "ranks": r} for t, w, r in near]})
        made = pa.array(out, kind)
        trim()
        return made

    return run


def scanned(docs: DataFrame, text_column: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT, phrases=PHRASES) -> DataFrame:
    """Adds n_words, places (label, word) of phrases, and matches (label, template, word, n_words, containment) of blocks that meet a template."""
    held = templates_of(templates, containment)
    index = Index(held, frequencies(docs, text_column, frozenset(w for t in held for w in t.words)), phrases)
    literal = lambda values, kind: F.expr(f"cast(array({', '.join(values)}) as array<{kind}>)")
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    sets = literal([f"array({', '.join(map(str, ranks))})" for ranks in index.sorted], "array<int>")
    labels, needs, spans = literal([text(t.label) for t in held], "string"), literal([str(t.need) for t in held], "int"), literal([str(2 * t.span) for t in held], "long")
    named = literal([text(label) for label, _ in phrases], "string")
    of = lambda column, at: F.get(column, at)
    out = docs.drop("n_words", "places", "matches", "__scan", "__shared").withColumn("__scan", _scanned(index)(F.coalesce(F.col(text_column).cast("string"), F.lit(""))))
    # the join's last step: words that both have, counted
    both = F.transform("__scan.near", lambda c: F.struct(c["template"].alias("template"), c["word"].alias("word"), F.size(F.array_intersect(c["ranks"], of(sets, c["template"]))).alias("n")))
    out = out.withColumn("__shared", F.filter(both, lambda c: c["n"] >= of(needs, c["template"])))
    match = lambda c: F.struct(of(labels, c["template"]).alias("label"), c["template"].alias("template"), c["word"].alias("word"), of(spans, c["template"]).alias("n_words"), (c["n"] / F.size(of(sets, c["template"]))).alias("containment"))
    place = lambda p: F.struct(of(named, p["phrase"]).alias("label"), p["word"].alias("word"))
    return out.withColumns({"n_words": F.col("__scan.n_words"), "places": F.transform("__scan.places", place), "matches": F.transform("__shared", match)}).drop("__scan", "__shared")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words, base = F.col("places.word"), F.col("places.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, F.col("matches.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("matches.containment")), F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates=TEMPLATES, containment: float = CONTAINMENT, phrases=PHRASES) -> str:
    """All blocks against all templates of their class, without filters, in DuckDB's SQL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    words = lambda some: f"[{', '.join(text(w.decode()) for w in some)}]"
    held = templates_of(templates, containment)
    return f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(label, phrase) AS (VALUES {', '.join(f"({text(label)}, {words(words_of(phrase))})" for label, phrase in phrases)}),
places AS (SELECT r, label, i FROM w, p, LATERAL (SELECT unnest(range(len(w))) AS i) WHERE w[i + 1] = phrase[1] AND list_slice(w, i + 1, i + len(phrase)) = phrase),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
t(label, span, need, words) AS (VALUES {', '.join(f"({text(t.label)}, {t.span}, {t.need}, {words(sorted(t.words))})" for t in held)}),
spans AS (SELECT DISTINCT span FROM t),
blocks AS (SELECT r, span, list_slice(w, s * span + 1, (s + 2) * span) AS block FROM w, spans, LATERAL (SELECT unnest(range((len(w) + span - 1) // span)) AS s)),
met AS (SELECT r, label, len(list_intersect(words, block)) AS n, need, len(words) AS size FROM blocks JOIN t USING (span)),
own AS (SELECT r, list(DISTINCT label) AS labels, max(n / size) AS score FROM met WHERE n >= need GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(own.score, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN own USING (r)"""


OP12_SQL = oracle_sql()
