"""Byte-level BPE over a public vocabulary: token ids of whole texts, and token counts at every prefix.

The vocabulary file (``*.tiktoken`` ranks) is the same as that of ``byte_bpe_50k.json``.
A text is split into pieces by the pattern of that tokenizer. A piece's tokens depend
on nothing outside the piece, so each worker keeps a bounded table from piece to result
and pays for a piece once.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex
import tiktoken

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: Entries of a table in a worker before it is emptied; bounds memory, not results.
TABLE_ENTRIES = 500_000

# The tokenizer's contractions and the code points with the White_Space property.
CONTRACTION = r"'(?:s|t|re|ve|m|ll|d)"
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _patterns(engine, letter: str, digit: str, space: str, other: str):
    """The pattern that yields pieces, and the one that yields units: a run of white space goes with the word after it."""
    word = f"{letter}+|{digit}+|{other}+"
    start = f" ?{letter}+|{CONTRACTION}| ?{digit}+| ?{other}+"
    piece = engine.compile(rf"{start}|{space}+(?!{other}|{letter}|{digit})|{space}+")
    unit = engine.compile(rf"{start}|{space}{{2,}}(?:(?<= )(?:{word})|(?<! )(?:{CONTRACTION}|{word}))?|{space}")
    return piece, unit


#: Python's own classes; right unless has_odd() finds a character in the text.
PLAIN = _patterns(re, r"[^\W\d_]", r"\d", r"\s", r"(?:[^\s\w]|_)")
EXACT = _patterns(regex, r"\p{L}", r"\p{N}", rf"[{WHITE}]", rf"[^{WHITE}\p{{L}}\p{{N}}]")


@lru_cache(1)
def odd_characters() -> np.ndarray:
    """For each code point, whether Python's classes and the tokenizer's put it in different classes."""
    odd = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        odd[c] = 0x1C <= c <= 0x1F or kind in ("No", "Nl") or (kind[0] not in "LN" and chr(c).isalnum())
    return odd


_SEPARATORS = re.compile("[\x1c-\x1f]")


def has_odd(text: str) -> bool:
    if text.isascii():
        return _SEPARATORS.search(text) is not None
    return bool(odd_characters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


class Vocabulary:
    """One vocabulary in one worker, with its bounded tables."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.longest = max(map(len, self.ranks))
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.whole = {t: r for t, r in self.ranks.items() if self.core.encode_single_piece(t) == [r]}
        self.ids: dict[str, bytes] = {}
        self.deltas: dict[str, bytes] = {}
        self.prefixes: dict[bytes, tuple[int, int, int, bytes]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # Token ids

    def _plain_ids(self, text: str) -> bytes:
        pieces = _chosen(text)[0].findall(text)
        table = self.ids
        try:
            return b"".join(map(table.__getitem__, pieces))
        except KeyError:
            pass
        if len(table) > TABLE_ENTRIES:
            table.clear()
        encode = self.core.encode_single_piece
        for p in [p for p in set(pieces) if p not in table]:
            table[p] = array("I", encode(p.encode())).tobytes()
        return b"".join(map(table.__getitem__, pieces))

    def token_ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; the special string inside a text is its own id, as the library has it."""
        if SPECIAL not in text:
            return self._plain_ids(text)
        return np.array([SPECIAL_ID], "<u4").tobytes().join(self._plain_ids(x) for x in text.split(SPECIAL))

    # Counts at prefixes

    def piece_deltas(self, piece: str) -> bytes:
        """By how much the token count of each prefix of a piece differs from the prefix before it, by code point.

        Prefix dynamic programming: the last token of a prefix is the one vocabulary
        entry that ends there, encodes to itself, and stands next to the last token
        of the prefix before it in the encoding of the two. The count is one more
        than that shorter prefix's. Words share their beginnings, so a bounded table
        has (last token, count, count at the last whole code point, deltas) of prefixes.
        """
        data = piece.encode()
        n = len(data)
        if n > 64:
            return self._long_deltas(data)
        known, whole, pairs = self.prefixes, self.whole, self.pairs
        done = n
        while done and data[:done] not in known:
            done -= 1
        _, count, settled, deltas = known[data[:done]] if done else (0, 0, 0, b"")
        for end in range(done + 1, n + 1):
            for begin in range(end):
                token = whole.get(data[begin:end])
                if token is None:
                    continue
                if not begin:
                    count = 1
                    break
                before = known[data[:begin]]
                key = (before[0], token)
                fits = pairs.get(key)
                if fits is None:
                    fits = self._adjacent(key)
                if fits:
                    count = before[1] + 1
                    break
            if end == n or data[end] & 0xC0 != 0x80:
                deltas += STEP[count - settled]
                settled = count
            known[data[:end]] = (token, count, settled, deltas)
        return deltas

    def _long_deltas(self, data: bytes) -> bytes:
        """The same without the table, for a piece whose prefixes would be long keys."""
        n, whole, longest = len(data), self.whole, self.longest
        last, count, out = [-1] * (n + 1), [0] * (n + 1), []
        for end in range(1, n + 1):
            for begin in range(max(0, end - longest), end):
                token = whole.get(data[begin:end])
                if token is not None and (not begin or self.pairs.get((last[begin], token)) or self._adjacent((last[begin], token))):
                    last[end], count[end] = token, count[begin] + 1
                    break
            if end == n or data[end] & 0xC0 != 0x80:
                out.append(count[end])
        return _steps(out)

    def _adjacent(self, key: tuple[int, int]) -> bool:
        if len(self.pairs) > 2 * TABLE_ENTRIES:
            self.pairs.clear()
        a, b = key
        fits = self.core.encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        self.pairs[key] = fits
        return fits

    def unit_deltas(self, unit: str) -> bytes:
        """piece_deltas for a unit, where each prefix is split into pieces afresh."""
        if len(unit) == 1 or unit[0] != "'" and not unit[:2].isspace():
            return self.piece_deltas(unit)
        return _steps(self._unit_counts(unit))

    def _piece_counts(self, piece: str) -> list[int]:
        return np.cumsum(np.frombuffer(self.piece_deltas(piece), np.int8), dtype=np.int64).tolist()

    def _unit_counts(self, unit: str) -> list[int]:
        if len(unit) > 1 and unit[0] == "'" and unit[1].isalpha():  # a contraction; its prefixes are an apostrophe and letters
            letters = self._piece_counts(unit[1:-1]) if len(unit) > 2 else []
            return [1, *(1 + x for x in letters), self._piece_counts(unit)[-1]]
        if len(unit) > 1 and unit[0].isspace() and unit[1].isspace():
            run = len(unit) - len(unit.lstrip())
            counts = self._piece_counts(unit[:run])
            if run == len(unit):
                return counts
            before = counts[-2]
            if unit[run - 1] == " ":
                return counts + [before + x for x in self._piece_counts(unit[run - 1 :])[1:]]
            before += self._piece_counts(unit[run - 1])[-1]
            return counts + [before + x for x in self._unit_counts(unit[run:])]
        return self._piece_counts(unit)

    def _plain_deltas(self, text: str) -> bytes:
        units = _chosen(text)[1].findall(text)
        table = self.deltas
        try:
            return b"".join(map(table.__getitem__, units))
        except KeyError:
            pass
        if len(table) > TABLE_ENTRIES:
            table.clear()
        if len(self.prefixes) > TABLE_ENTRIES:
            self.prefixes.clear()
        for u in [u for u in set(units) if u not in table]:
            table[u] = self.unit_deltas(u)
        return b"".join(map(table.__getitem__, units))

    def prefix_deltas(self, text: str) -> bytes:
        """A signed byte for each code point: by how much the token count of the prefix that ends there differs from that before it.

        The running sum has the exact count at every prefix; the sum of all is the count of the text.
        """
        if SPECIAL not in text:
            return self._plain_deltas(text)
        parts, out = text.split(SPECIAL), []
        for i, part in enumerate(parts):
            if i == len(parts) - 1:
                out.append(self._plain_deltas(part))
                continue
            begun = np.frombuffer(self._plain_deltas(part + SPECIAL[:-1]), np.int8).astype(np.int64)
            ended = int(np.frombuffer(self._plain_deltas(part), np.int8).sum(dtype=np.int64)) + 1
            out.append(_bytes(np.append(begun, ended - begun.sum())))
        return b"".join(out)


#: Signed bytes by their value; a negative one is found from the end.
STEP = [bytes([x % 256]) for x in (*range(128), *range(-128, 0))]


def _steps(counts: list[int]) -> bytes:
    return _bytes(np.diff(np.array(counts, np.int64), prepend=0))


def _bytes(steps: np.ndarray) -> bytes:
    if len(steps) and (steps.max() > 127 or steps.min() < -128):
        raise OverflowError("a code point changes the count by more than a signed byte holds")
    return steps.astype(np.int8).tobytes()


def _chosen(text: str):
    return EXACT if has_odd(text) else PLAIN


@lru_cache(2)
def vocabulary(path: str | None = None) -> Vocabulary:
    """The worker's vocabulary; path: a rank file, by default that of the public byte-level BPE of 50k entries."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return Vocabulary(path)


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Token counts of all prefixes, by code points from 0 to the text's length."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)])


def fitting_prefix(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most budget tokens."""
    return int(np.flatnonzero(prefix_counts(deltas) <= budget)[-1]) if budget >= 0 else 0
