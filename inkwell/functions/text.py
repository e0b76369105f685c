"""Text functions: byte tokens, lengths, digits and framing."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the byte-level vocabulary; 0 to 255 are UTF-8 bytes.
BOS, EOS, PAD = 256, 257, 258
BYTE_VOCABULARY = 259
#: Target of a position that bears no loss.
IGNORED = -100
DIGIT = "\\p{Nd}"


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes as ids 0-255, without Python."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.transform(pairs, lambda pair: F.conv(pair, 16, 10).cast("int"))


def decode_bytes(tokens: Column) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(tokens, lambda t: F.lpad(F.hex(t), 2, "0")), "")), "UTF-8")


def framed(tokens: Column, bos: int = BOS, eos: int = EOS) -> Column:
    """BOS, tokens, EOS."""
    return F.concat(F.array(F.lit(bos)), tokens, F.array(F.lit(eos)))


def inputs(document: Column) -> Column:
    return F.slice(document, F.lit(1), F.size(document) - 1)


def targets(document: Column) -> Column:
    return F.slice(document, F.lit(2), F.size(document) - 1)


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DIGIT)).cast("long")


def digit_segments(text: Column) -> Column:
    """The text's parts, each decimal digit one of its own, in order; no part is empty."""
    return F.regexp_extract_all(text, F.lit(f"{DIGIT}|[^{DIGIT}]+"), F.lit(0))


@lru_cache(1)
def byte_alphabet() -> tuple[tuple[int, int], ...]:
    """(byte, code point of its printable stand-in): printable bytes stand for themselves, the others for 256 and on in turn."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return tuple((b, b if b in shown else next(other)) for b in range(256))
