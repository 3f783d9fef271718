"""Byte-pair vocabularies: splitting texts into words, and merging words.

A text is cut before every space that a non-space follows. The byte-level splitting
pattern always ends a word there, so the pieces ("parts") can be tokenised one by one and
cached; most parts of running text repeat.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable

import regex

#: Fixed value: the splitting pattern of byte-level vocabularies.
WORD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_LOOSE_SPACE = regex.compile(r" (?=\s|\Z)")
_CUT = regex.compile(r"(?<!\A)(?= \S)")
#: A cache of parts is emptied beyond this many entries.
CACHE = 1_200_000
#: Vocabulary files are sent to tasks; larger ones are refused.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: vocabulary larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


class MergeTable:
    """Merge ranks of a byte-level vocabulary; symbol 256 + rank is what a merge makes."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") is not None:
            raise ValueError("a byte-level BPE vocabulary without a normalizer is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        number = {c: b for b, c in byte_symbols().items()}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[number[left], number[right]] = rank
            number[left + right] = 256 + rank

    def merges(self, word: bytes) -> int:
        """How many merges the word allows, lowest rank first, leftmost first among equals.

        Symbols are a doubly linked list over positions; the heap holds adjacent pairs,
        and pairs whose symbols have changed since are skipped when popped.
        """
        n, rank = len(word), self.rank
        if n < 2:
            return 0
        symbol: list[int] = list(word)
        at = [rank.get(pair, -1) for pair in zip(symbol, symbol[1:])]  # rank of the pair that begins here
        heap = [r << 40 | i for i, r in enumerate(at) if r >= 0]
        if not heap:
            return 0
        at.append(-1)
        heapq.heapify(heap)
        pop, push, get = heapq.heappop, heapq.heappush, rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            entry = pop(heap)
            i, r = entry & 0xFFFFFFFFFF, entry >> 40
            if at[i] != r:
                continue
            done += 1
            j = after[i]
            made = symbol[i] = 256 + r
            at[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                q = at[i] = get((made, symbol[k]), -1)
                if q >= 0:
                    push(heap, q << 40 | i)
            else:
                at[i] = -1
            h = before[i]
            if h >= 0:
                q = at[h] = get((symbol[h], made), -1)
                if q >= 0:
                    push(heap, q << 40 | h)
        return done

    def tokens(self, word: str) -> int:
        raw = word.encode()
        return len(raw) - self.merges(raw)


class PartCache(dict):
    """Values of parts, made on first use; emptied when it outgrows its bound."""

    def __init__(self, make: Callable[[str], object], bound: int = CACHE):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, part: str):
        if len(self) >= self.bound:
            self.clear()
        value = self[part] = self.make(part)
        return value


def parts_of(text: str) -> tuple[str, list[str]] | None:
    """First part, and the later ones without the space that each begins with.

    None if some space is followed by white space or the end: then use cut_parts.
    """
    if "  " in text or _LOOSE_SPACE.search(text):
        return None
    first, *rest = text.split(" ")
    return first, rest


def cut_parts(text: str) -> list[str]:
    """Parts with their leading spaces, for any text."""
    return _CUT.split(text) if text else []


def around_special(text: str, special: list[str]) -> tuple[list[str], int]:
    """Ordinary stretches of the text, and how many special strings stand between them."""
    pieces, found = [text], 0
    for mark in special:
        if mark in text:
            pieces = [p for piece in pieces for p in piece.split(mark)]
            found = len(pieces) - 1
    return pieces, found
