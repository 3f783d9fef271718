"""Token counts by heap-and-linked-list byte-pair merging.

The count of a word is its bytes minus the merges its pairs allow; no identifiers are made.
Counts of parts are cached in the Python worker, so a task mostly adds up known numbers.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a special string inside a
text is one token; repeated rows are counted one by one; an empty table gives no rows;
other columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import kept, map_rows, texts_of


class TokenCounter:
    def __init__(self, vocabulary: bytes):
        self.table = bpe.MergeTable(vocabulary)
        self.word = bpe.PartCache(self.table.tokens)
        self.part = bpe.PartCache(self._split)
        self.spaced = bpe.PartCache(lambda rest: self._split(" " + rest))

    def _split(self, part: str) -> int:
        word = self.word
        return sum([word[w] if len(w) < 64 else self.table.tokens(w) for w in bpe.WORD.findall(part)])

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        found = bpe.parts_of(text)
        if found is None:
            return sum(map(self._one, bpe.cut_parts(text)))
        first, rest = found
        return self._one(first) + sum(map(self.spaced.__getitem__, rest))

    def _one(self, part: str) -> int:
        return self.part[part] if len(part) < 64 else self._split(part)

    def count(self, text: str) -> int:
        pieces, special = bpe.around_special(text, self.table.special)
        return special + sum(map(self._plain, pieces))


def counter_for(vocabulary: bytes) -> TokenCounter:
    """One counter for each vocabulary and Python worker."""
    return kept(f"counter-{hash(vocabulary)}", lambda: TokenCounter(vocabulary))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text. No shuffle; the vocabulary file
    (at most ``bpe.MAX_VOCABULARY_BYTES``) is read on the driver and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(tokenizer_path))

    def count(batch):
        texts = texts_of(batch)
        counter = counter_for(shared.value)
        n = [counter.count(t) for t in texts]
        return {"id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over": [x > limit for x in n]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = map_rows(rows, count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", keep=True)
    return out.withColumnRenamed("id", id_col)
