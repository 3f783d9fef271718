"""Real token counts: a vocabulary file counts, cuts and chunks texts.

A ``Vocabulary`` is only a path, so it goes to tasks as such; each Python worker reads the file
once. The file must lie on a path that all machines see.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame

from tessera.operators.chunking import per_document
from tessera.plans.registry import query
from tessera.sources.tables import table


@cache
def _loaded(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Where the byte-level splitting pattern always ends a word: before a lone space, and around a lone
#: line feed. Any other white space stays within a part.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
#: Parts whose ends a Python worker remembers, and the characters of one at most.
MOST_PARTS, LONGEST_PART = 400_000, 40


@cache
def _parts(path: str) -> tuple[dict[str, list[int]], list[str]] | None:
    """Ends of known parts, and the special strings of texts that must stay whole; None where words
    are not split by the byte-level pattern, so that texts can't be cut."""
    kind = json.loads(_loaded(path).to_str())
    split = kind.get("pre_tokenizer") or {}
    plain = kind["model"]["type"] == "BPE" and not kind.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return ({}, [t["content"] for t in kind.get("added_tokens", [])]) if plain else None


def _ends(path: str, text: str) -> list[int]:
    """Where each token ends, as the library tells it; never falling."""
    out, most = [], 0
    for _, end in _loaded(path).encode(text, add_special_tokens=False).offsets:
        most = max(most, end)
        out.append(most)
    return out


@dataclass(frozen=True)
class Vocabulary:
    """Counts the tokens of a text, without special ones around it; a ``Counter`` for chunks."""

    path: str

    def __call__(self, text: str) -> int:
        return len(_loaded(self.path).encode(text, add_special_tokens=False))

    def ends(self, text: str) -> list[int]:
        """Where each token ends, in characters; never falling, the last at the text's end. Words
        that come again are looked up."""
        parts = _parts(self.path)
        if parts is None or any(t in text for t in parts[1]):
            out = _ends(self.path, text)
        else:
            known, out, base = parts[0], [], 0
            for part in _CUT.split(text):
                own = known.get(part)
                if own is None:
                    own = _ends(self.path, part)
                    if len(part) <= LONGEST_PART:
                        if len(known) >= MOST_PARTS:
                            known.clear()
                        known[part] = own
                if len(own) == 1:
                    out.append(base + own[0])
                else:
                    out += [base + e for e in own]
                base += len(part)
        if out:
            out[-1] = len(text)
        return out

    def truncated(self, text: str, most: int) -> str:
        """The longest start of whole tokens that has ``most`` tokens at most by itself."""
        ends = self.ends(text)
        if len(ends) <= most:
            return text
        n = most
        while n and self(text[: ends[n - 1]]) > most:  # a character of several tokens was cut
            n -= 1
        return text[: ends[n - 1]] if n else ""

    def windows(self, text: str, size: int, overlap: int = 0) -> Iterator[dict]:
        """Windows of ``size`` tokens, each beginning with the last ``overlap`` of the one before."""
        ends, at, place = self.ends(text), 0, 0
        while at < len(ends):
            stop = min(at + size, len(ends))
            start = ends[at - 1] if at else 0
            yield {"place": place, "first_token": at, "n_tokens": stop - at, "char_start": start, "char_end": ends[stop - 1], "chunk_text": text[start : ends[stop - 1]]}
            if stop == len(ends):
                return
            at, place = stop - overlap, place + 1


def token_chunks(docs: DataFrame, vocabulary: Vocabulary, size: int = 600, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, first_token, n_tokens, char_start, char_end, chunk_text). Null and empty texts
    have none; repeated rows are cut each by itself; whole texts are cut, and without an overlap
    the chunks' texts make the text again."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    columns = {"place": "bigint", "first_token": "bigint", "n_tokens": "bigint", "char_start": "bigint", "char_end": "bigint", "chunk_text": "string"}
    return per_document(docs, id_col, columns, lambda t: vocabulary.windows(t, size, overlap), text_col)


@query()
def txt_token_chunks(spark, sf_dir):
    import public_tokenizers

    return token_chunks(table(spark, sf_dir, "documents"), Vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
