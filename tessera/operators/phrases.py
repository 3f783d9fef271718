"""Many phrases at once: one automaton for all of them, run over texts in Arrow batches.

A phrase is found wherever it stands in the lower-cased text, as ``contains`` would find it; the
work for a text grows with its length and its finds, not with the number of phrases. Phrases
are a small side: collected behind a check of their size and sent to each task once.

Null texts hold nothing; null and empty phrases are left out; phrases that are alike when
lower-cased are found together; an empty table on either side gives no finds.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.vectors import SMALL_SIDE
from tessera.plans.registry import query
from tessera.sources.tables import in_batches, table

#: Texts of an Arrow batch.
TEXTS = 500


@dataclass
class Phrases:
    """Distinct phrases, and the owners (queries, items) of each as ranges of one array."""

    words: list[str]
    owners: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, phrase: str, owner: str) -> Phrases:
        """From rows (owner, phrase); owners are integers."""
        pairs = rows.select(F.lower(F.col(phrase)).alias("p"), F.col(owner).cast("bigint").alias("o")).where("length(p) > 0 and o is not null").distinct()
        size = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("c")).first()
        if size.c + size.n > SMALL_SIDE * 8:
            raise ValueError(f"{size.n} phrases of {size.c} characters are more than a task should hold")
        found = pairs.orderBy("p", "o").collect()
        words = sorted({r.p for r in found})
        number = {w: i for i, w in enumerate(words)}
        of = np.array([number[r.p] for r in found], dtype=np.int64)
        return cls(words, np.array([r.o for r in found], dtype=np.int64), np.searchsorted(of, np.arange(len(words) + 1)))

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i, word in enumerate(self.words):
            out.add_word(word, i)
        if self.words:
            out.make_automaton()
        return out


def phrases_in(texts: DataFrame, key: str, text: str, phrases: Phrases, least: int = 1) -> DataFrame:
    """(key, n_phrases, owners): how many distinct phrases each text holds, and the owners of
    whose phrases it holds at least ``least`` distinct ones, with their number."""
    shared = texts.sparkSession.sparkContext.broadcast(phrases)
    rows = texts.select(F.col(key).alias("id"), F.lower(F.col(text)).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    held: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        if "automaton" not in held:
            held["automaton"] = known.automaton()
        n, owners = [], []
        for t in batch.column(1).to_pylist():
            found = np.unique(np.array([i for _, i in held["automaton"].iter(t)], dtype=np.int64)) if t and known.words else np.zeros(0, np.int64)
            n.append(len(found))
            own = [known.owners[known.begin[i] : known.begin[i + 1]] for i in found]
            name, times = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            owners.append([{"owner": int(o), "n": int(k)} for o, k in zip(name, times, strict=True) if k >= least])
        kinds = pa.list_(pa.struct([("owner", pa.int64()), ("n", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(owners, kinds)], names=["id", "n_phrases", "owners"])

    out = in_batches(rows, run, f"id {kind}, n_phrases bigint, owners array<struct<owner:bigint,n:bigint>>", TEXTS)
    return out.withColumnRenamed("id", key)


#: Letters that a signal word has at least, and signals that make a text relevant.
SIGNAL_LETTERS, LEAST_SIGNALS = 6, 2
_SIGNALS = f"(SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{{SIGNAL_LETTERS},}}')) AS s FROM benchmark)"


@query(f"""WITH s AS {_SIGNALS}, f AS (SELECT doc_id, s FROM documents, (SELECT DISTINCT s FROM s) WHERE contains(lower(text), s)),
    o AS (SELECT doc_id, item_id, count(*) AS n FROM f JOIN s USING (s) GROUP BY ALL)
    SELECT d.doc_id, coalesce(n_phrases, 0) AS n_phrases, coalesce(n_items, 0) AS n_items, best FROM documents AS d LEFT JOIN (SELECT doc_id, count(*) AS n_phrases FROM f GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n_items, max(n) AS best FROM o WHERE n >= {LEAST_SIGNALS} GROUP BY doc_id) USING (doc_id)""")
def search_signals_many(spark, sf_dir):
    """For each document how many of all items' signal words it holds, for how many items it is
    relevant, and the signals of the best; all words are looked for in one pass."""
    items = table(spark, sf_dir, "benchmark")
    words = items.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"([a-z]{{{SIGNAL_LETTERS},}})"), F.lit(1))).alias("signal"))
    found = phrases_in(table(spark, sf_dir, "documents"), "doc_id", "text", Phrases.of(words, "signal", "item_id"), LEAST_SIGNALS)
    return found.select("doc_id", "n_phrases", F.size("owners").cast("bigint").alias("n_items"), F.array_max(F.transform("owners", lambda o: o["n"])).alias("best"))
