"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive prefixes
of a conversation are rendered and consecutive outputs compared: where the longer output
begins with the shorter, what it adds is the new turn's span. Where it doesn't, the template
rewrites history; all turns at which that was seen are listed, and each turn's text is located
in the final output alone, by probes. Inside a turn, a rendering with a one-character
probe in place of the text shows how much scaffold stands before and after it; the loss mask
is what lies between, for the roles that are learned from.

The built-in template marks each turn with control strings and escapes these inside roles and
texts, so that the output can be read back (``turns_of``).

A conversation is one result row, so its turns meet in one task, but a partition streams
through its conversations and holds one at a time. As every prefix is rendered, the cost
of one conversation grows with the square of its turns, and its texts are in memory at once. A
conversation that holds a third of all rows is one task: a prefix can't be rendered in parts.

Defined cases: a null role or text is empty; turns are in order of turn (nulls first), then role
and text; repeated rows are turns of their own; rows with a null conversation id are one
conversation; very long texts are kept whole; an empty table gives an empty result; other columns are ignored whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.shared import table

Turn = tuple[str, str]
PROBE = "\ue000"
#: Control strings of the built-in template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
#: Characters of texts and escapes that a worker keeps, at most.
KEPT_CHARS = 1 << 22
_ESCAPED = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_TURN = re.compile(r"<s>(.*?)\[INST\] (.*?) \[/INST\]</s>", re.DOTALL)


class Escapes(dict):
    """Texts and their escapes, as every prefix of a conversation renders them anew; emptied when they are ``KEPT_CHARS`` long."""

    held = 0

    def __missing__(self, text: str) -> str:
        found = _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)
        self.held += len(text) + len(found)
        if self.held > KEPT_CHARS:
            self.clear()
            self.held = 0
        else:
            self[text] = found
        return found


_ESCAPES = Escapes()


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of a control string."""
    return _ESCAPES[text]


def unescape(text: str) -> str:
    return re.sub(r"\\(\\)?", lambda m: m[1] or "", text)


def render(turns: list[Turn]) -> str:
    """The built-in template."""
    return "".join([f"<s>{escape(role)}[INST] {escape(text)} [/INST]</s>" for role, text in turns])


def turns_of(formatted: str) -> list[Turn]:
    """Reads the built-in template's output back."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("the output isn't a sequence of turns")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("the output isn't a sequence of turns")
    return found


@dataclass
class Formatted:
    text: str
    #: What each turn adds to the output; empty if history was rewritten, where turns need not be in one piece.
    spans: list[tuple[int, int]]
    #: Where each turn's text is in the final output, learned from or not; None if the template doesn't show it once.
    located: list[tuple[int, int] | None]
    #: Where each turn's text is that is learned from, in order.
    mask: list[tuple[int, int]]
    #: The first turn whose output doesn't begin with the one before; -1 if none.
    rewritten_at: int
    #: All such turns, in order.
    rewritten: list[int]


def _around(template: Callable[[list[Turn]], str], turns: list[Turn], i: int) -> tuple[int, int] | None:
    """Scaffold before and after turn i's text in the output of turns; None if the template doesn't show the text once."""
    probed = template([*turns[:i], (turns[i][0], PROBE), *turns[i + 1 :]])
    if probed.count(PROBE) - sum(text.count(PROBE) + role.count(PROBE) for role, text in (*turns[:i], *turns[i + 1 :])) != 1:
        return None
    shown = template([*turns[:i], (turns[i][0], ""), *turns[i + 1 :]])
    before = next((k for k in range(len(shown) + 1) if probed[k : k + 1] == PROBE and shown[k:] == probed[k + 1 :]), None) if PROBE in shown else probed.index(PROBE)
    return None if before is None else (before, len(probed) - before - 1)


def format_turns(turns: list[Turn], template: Callable[[list[Turn]], str] = render, learned: tuple[str, ...] = ("assistant",)) -> Formatted:
    before, spans, located, rewritten = template([]), [], [], []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(before):
            rewritten.append(k - 1)
        elif not rewritten:
            spans.append((len(before), len(now)))
            around = _around(template, turns[:k], k - 1)
            located.append((around[0], len(now) - around[1]) if around else None)
        before = now
    if rewritten:
        arounds = [_around(template, turns, i) for i in range(len(turns))]
        spans, located = [], [(around[0], len(before) - around[1]) if around else None for around in arounds]
    mask = [place for place, (role, _) in zip(located, turns) if place and role in learned]
    return Formatted(before, spans, located, mask, rewritten[0] if rewritten else -1, rewritten)


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _rows(found: list[tuple], id_type) -> pa.RecordBatch:
    pairs = lambda spans: [x and {"begin": x[0], "end": x[1]} for x in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in found], id_type), pa.array([f.text for _, f in found], pa.string()), pa.array([pairs(f.spans) for _, f in found], _SPANS), pa.array([pairs(f.mask) for _, f in found], _SPANS), pa.array([f.rewritten_at for _, f in found], pa.int32()), pa.array([pairs(f.located) for _, f in found], _SPANS), pa.array([f.rewritten for _, f in found], pa.list_(pa.int32()))],
        names=["id", "formatted", "spans", "mask", "rewritten_at", "located", "rewritten"],
    )


def _format(batches, template, learned):
    """Rows sorted by conversation come in; a conversation may go on in the next batch."""
    started, held_id, held, out, size, id_type = False, None, [], [], 0, None
    for batch in batches:
        id_type = batch.schema.field(0).type
        for id_, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if started and id_ != held_id:
                out.append((held_id, format_turns(held, template, learned)))
                size += len(out[-1][1].text)
                held = []
                if size > 4_000_000:
                    yield _rows(out, id_type)
                    out, size = [], 0
            started, held_id = True, id_
            held.append((role or "", text or ""))
    if started:
        out.append((held_id, format_turns(held, template, learned)))
        yield _rows(out, id_type)


def format_conversations(turns: DataFrame, template: Callable[[list[Turn]], str] = render, learned: tuple[str, ...] = ("assistant",), id_column: str = "conv_id") -> DataFrame:
    """id, formatted, spans, mask, rewritten_at, located, rewritten of each conversation; places are code points of formatted."""
    rows = turns.select(F.col(id_column).alias("id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "turn")
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    place = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("formatted", T.StringType()), T.StructField("spans", place), T.StructField("mask", place), T.StructField("rewritten_at", T.IntegerType()), T.StructField("located", place), T.StructField("rewritten", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(partial(_format, template=template, learned=learned), schema).withColumnRenamed("id", id_column)


def _digest(batches):
    """What the built-in template's output says of itself."""
    for batch in batches:
        out = []
        for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns = turns_of(text)
            loss = "".join(unescape(text[x["begin"] : x["end"]]) for x in mask)
            told = "".join(f"{role}\n{said}\n" for role, said in turns)
            out.append((len(turns), hashlib.sha256(told.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], kinds[i]) for i in range(5))], names=["conv_id", *names])


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    done = format_conversations(turns.unionByName(more))
    return done.select("conv_id", "formatted", "mask").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM t
), x AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g') AS role_x,
    regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS text_x FROM e
)
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(SUM(length(role_x) + length(text_x) + 22) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""
