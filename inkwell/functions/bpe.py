"""Byte-level BPE by ranks of merges: whole batches of texts to ids, piece by piece.

A text is cut into pieces by the tokenizer's pattern, and a piece's ids depend on nothing
outside it. So a worker merges each distinct piece once while it is in its bounded table, and the
rest of a text is look-ups. Merging takes the pair of the lowest rank, of equal ones the first, until no
pair has a rank; pairs wait in a heap, so a piece of n bytes takes n log n steps.
"""

from __future__ import annotations

import heapq
import json
from array import array
from functools import lru_cache
from sys import getsizeof

import numpy as np
import regex

from inkwell.functions import text as X

#: Entries of a worker's table before it is emptied, and bytes of its pieces and ids; they bound memory, not results.
TABLE_ENTRIES = 500_000
TABLE_BYTES = 48 << 20

# Code points of the Unicode property White_Space, the contractions that are pieces, and the pattern's kinds of pieces.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = "s t re ve m ll d".split()
LETTER, NUMBER, OTHER = r"\p{L}", r"\p{N}", rf"[^{WHITE}\p{{L}}\p{{N}}]"


@lru_cache(1)
def pattern():
    """Contractions; runs of letters, of numbers and of other characters, each with a space before it; white space, without its last character where something follows."""
    runs = [f" ?{kind}+" for kind in (LETTER, NUMBER, OTHER)]
    return regex.compile("|".join([f"'(?:{'|'.join(CONTRACTIONS)})", *runs, rf"[{WHITE}]+(?![^{WHITE}])", rf"[{WHITE}]+"]))


def is_plain(file: dict) -> bool:
    """Whether a tokenizer file is of this kind: byte-level BPE under the pattern above, and nothing else."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    off = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    shown = {chr(code) for _, code in X.byte_alphabet()}
    return model.get("type") == "BPE" and not any(map(model.get, off)) and not file.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and shown <= set(model["vocab"])


class Merges(dict):
    """From a piece (a string) to its ids as 16-bit numbers."""

    def __init__(self, file: dict):
        super().__init__()
        self.held = 0
        ids = file["model"]["vocab"]
        self.of_byte = [ids[chr(code)] for _, code in X.byte_alphabet()]
        parts = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(parts)}

    def merged(self, data: bytes) -> list[int]:
        ids, pairs = [self.of_byte[b] for b in data], self.pairs
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:  # one of the two has been merged since
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((made, ids[k])):
                    heapq.heappush(heap, (*found, i, made, ids[k]))
            if (h := before[i]) >= 0 and (found := pairs.get((ids[h], made))):
                heapq.heappush(heap, (*found, h, ids[h], made))
        return [x for x in ids if x >= 0]

    def __missing__(self, piece: str) -> bytes:
        found = array("H", self.merged(piece.encode())).tobytes()
        size = getsizeof(piece) + getsizeof(found)
        if len(self) > TABLE_ENTRIES or self.held + size > TABLE_BYTES:
            self.clear()
            self.held = 0
        if size <= TABLE_BYTES:
            self[piece] = found
            self.held += size
        return found

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, pattern().findall(text))), "<u2")


@lru_cache(2)
def merges(path: str) -> Merges | None:
    """A worker's merges of a tokenizer file, or None where it is of another kind."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    return Merges(file) if is_plain(file) else None
