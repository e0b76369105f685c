"""Document fingerprints by threshold-scaled sketches, with DataFrame functions alone.

A text's words (lower case, ended by ASCII white space) make five-word shingles; fewer words
make one. The sketch is every distinct shingle hash below a fixed fraction of the hash range,
so its size follows the text's and nothing depends on other texts. Here the fraction is one half
(``SCALE`` 2): likeness estimates the Jaccard index of all shingles, off by 0.04 in the mean square's root over
documents, more on texts of few words; 1 would keep every hash. Sketches of parts merge by union into the sketch of
the whole, and as one threshold holds for all, the share of a sketch found in another is
containment (or estimates it) even between very unequal documents.

The fingerprint is a hash of the whole word sequence, a colon, and the sketch's hashes in
order, 16 hexadecimal digits each. Likeness is the Jaccard index of two sketches; where both
are empty (no words, or with a smaller fraction short texts whose few hashes all lie above the
threshold) it is 1 if the word sequences have equal hashes, else 0.

For a document's neighbour, ids are cut into ranges at ids that occur (approximate quantiles,
at most ``MOST_RANGES``). A row that starts a range also visits the range before it, and the
very first row the last range, so that each range finds its rows' successors alone, in one
shuffle of the texts.

Beyond 8.4 million rows ranges have more than ``ROWS_PER_RANGE`` rows each; sorting one spills.

Defined cases: a null text is empty; a very long text is sketched whole; a null id has no place in the order, and such a row is its
own next document, as is a single row; repeated ids follow each other by text; an empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.shared import table

WORDS = 5
#: One in so many hashes is kept; 1 keeps all.
SCALE = 2
ROWS_PER_RANGE = 512
MOST_RANGES = 1 << 14


def with_sketch(df: DataFrame, text_column: str, sketch: str, whole: str, words_each: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Adds the sketch (sorted hashes) and the hash of the whole word sequence. The steps are columns of their own, so that none is evaluated within another's loop."""
    split = F.filter(F.split(F.lower(F.col(text_column)), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    out = df.withColumn("__words", split)
    out = out.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    window = lambda x, i: F.xxhash64(x, *[F.get("__hashes", i + k) for k in range(1, words_each)])
    long = F.transform(F.slice("__hashes", F.lit(1), F.greatest(F.size("__hashes") - (words_each - 1), F.lit(0))), window)
    short = F.filter(F.array(F.xxhash64(F.concat_ws(" ", "__words"))), lambda _: F.size("__words") > 0)
    out = out.withColumn("__shingles", F.when(F.size("__hashes") >= words_each, long).otherwise(short))
    below = F.col("__shingles") if scale == 1 else F.filter("__shingles", lambda x: x < F.lit(-(1 << 63) + (1 << 64) // scale))
    kept = F.array_sort(F.array_distinct(below))
    return out.withColumn(sketch, kept).withColumn(whole, F.xxhash64("__hashes")).drop("__words", "__hashes", "__shingles")


def digits(number) -> F.Column:
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def as_text(sketch: str, whole: str) -> F.Column:
    """The fingerprint string."""
    return F.concat(digits(F.col(whole)), F.lit(":"), F.array_join(F.transform(sketch, lambda x: digits(x)), ""))


def likeness(a: str, a_whole: str, b: str, b_whole: str) -> F.Column:
    """Jaccard index of two sketches."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise((F.col(a_whole) == F.col(b_whole)).cast("double"))


def containment(a: str, b: str) -> F.Column:
    """The share of a's shingles that b has, an estimate unless sketches keep all; null where a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: str, b: str) -> F.Column:
    """The sketch of two parts together."""
    return F.array_sort(F.array_union(a, b))


def _cuts(rows: DataFrame) -> list[int]:
    """Ids at which the ranges begin, the least id first; all occur in the table."""
    n, least = rows.agg(F.count("id"), F.min("id")).first()
    if not n:
        return []
    ranges = min(MOST_RANGES, -(-n // ROWS_PER_RANGE))
    if ranges == 1:
        return [least]
    shares = [k / ranges for k in range(1, ranges)]
    found = rows.agg(F.percentile_approx("id", shares, 10 * ranges)).first()[0]
    return sorted({least, *found})


def _range_of(id_: F.Column, cuts: list[int]) -> tuple[F.Column, F.Column]:
    """How many cuts are at or below the id, found in two steps of about the square root of their number; and whether the last of these is the id."""
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    numbers = lambda some: f"array({', '.join(f'{c}L' for c in some)})"
    heads, inner = F.expr(numbers([b[0] for b in blocks])), F.expr(f"array({', '.join(map(numbers, blocks))})")
    block = F.size(F.filter(heads, lambda c: c <= id_))
    own = F.get(inner, block - 1)
    inside = F.size(F.filter(own, lambda c: c <= id_))
    return F.when(block > 0, (block - 1) * step + inside).otherwise(0), F.coalesce(F.get(own, inside - 1) == id_, F.lit(False))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of (id, text) by range, with ``range`` and ``visits``; rows of a range are together."""
    cuts = _cuts(rows)
    number, first = _range_of(F.col("id"), cuts) if cuts else (F.lit(0), F.lit(False))
    lone = -1 - F.pmod(F.xxhash64("text"), F.lit(1024)).cast("int")
    ranged = rows.withColumns({"own": F.when(F.col("id").isNull(), lone).otherwise(number), "first": first})
    before = F.when(F.col("own") > 1, F.col("own") - 1).otherwise(F.lit(len(cuts)))
    place = lambda range_, visits: F.struct(range_.alias("range"), F.lit(visits).alias("visits"))
    places = F.when(F.col("first"), F.array(place(F.col("own"), False), place(before, True))).otherwise(F.array(place(F.col("own"), False)))
    placed = ranged.select("id", "text", F.explode(places).alias("place"))
    return placed.select("id", "text", "place.range", "place.visits").repartition("range")


def edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scale: int = SCALE) -> DataFrame:
    """Each row's text, its edited text (the last quarter replaced by the next document's beginning) and both sketches."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    placed = with_sketch(dealt(rows), "text", "sketch", "whole", scale=scale)
    order = Window.partitionBy("range").orderBy("visits", "id", "text")
    lone = F.col("id").isNull()
    follow = lambda c: F.when(lone, F.col(c)).otherwise(F.lead(c).over(order))
    led = placed.withColumns({"next_text": follow("text"), "next_sketch": follow("sketch"), "next_whole": follow("whole")}).where("not visits")
    n = F.char_length("text")
    sized = led.withColumn("n_chars", n.cast("long")).withColumn("moved", F.floor(n / 4).cast("int"))
    head = F.substr("text", F.lit(1), F.col("n_chars").cast("int") - F.col("moved"))
    whole = sized.withColumn("edited_text", F.concat(head, F.substr("next_text", F.lit(1), F.col("moved"))))
    return with_sketch(whole, "edited_text", "edited_sketch", "edited_whole", scale=scale).withColumnRenamed("id", id_column)


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        as_text("sketch", "whole").alias("fingerprint"),
        as_text("edited_sketch", "edited_whole").alias("edited_fingerprint"),
        likeness("sketch", "whole", "edited_sketch", "edited_whole").alias("near_edited"),
        likeness("sketch", "whole", "next_sketch", "next_whole").alias("near_next"),
    )
