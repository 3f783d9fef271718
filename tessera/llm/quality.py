"""Quality scores by logistic regression over hashed word n-grams.

A text's words (split at white space, and every ``LONGEST`` characters) give n-grams of two kinds: of the lower-cased words
themselves, and of the words' shapes (runs of capitals, small letters, digits and other
marks, and whether a word repeats the one before). Each n-gram is hashed to a bucket; a
feature's value is its share of the text's n-grams, so a score is a sparse dot product, the
mean weight of the n-grams.

Training takes a bounded sample of labelled rows (``SAMPLE``, by the hash of their ids),
deals it over ``SHARDS`` groups, runs follow-the-regularised-leader updates in each, and
averages the weights: at most ``BUCKETS`` numbers.

Defined cases: null, empty and blank texts get the score of the intercept alone; rows
labelled more than once count each time; null labels and ids are not learned from; with no
labelled rows every score is 0.5; an empty table gives no rows; other columns are neither
read nor returned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, map_rows, texts_of

BUCKETS = 1 << 18
#: Largest number of labelled rows that a model is fitted on; the id and label of these are broadcast.
SAMPLE = 20_000
SHARDS, PASSES = 8, 3
#: Learning rate, its offset, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-3, 1e-3
#: Feature values are shares of n-grams times this.
SCALE = 8.0
#: Characters of a word; text without spaces is read in words of so many.
LONGEST = 64
_RUNS = re.compile(r"([^\W\d_a-zß-öø-ÿ]+)|([^\W\d_]+)|(\d+)|([\W_])\4*")


def shape(word: str) -> str:
    """Runs of letters and digits as A, a or 9; other marks as they are, once a run."""

    def run(m: re.Match) -> str:
        upper, lower, digits, mark = m.groups()
        return ("A" if len(upper) == 1 else "AA") if upper else "a" if lower else "9" if digits else mark if len(m[0]) == 1 else mark * 2

    return _RUNS.sub(run, word)


def words_of(text: str) -> list[str]:
    """Words of a text; longer ones are cut every LONGEST characters."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[at : at + LONGEST] for w in words for at in range(0, len(w), LONGEST)]


def _mix(*parts: np.ndarray) -> np.ndarray:
    mixed = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        mixed = (mixed ^ p) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(BUCKETS)).astype(np.int64)


class Features:
    """N-gram buckets of texts; what is known of words is kept, up to a bound."""

    KEPT = 500_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.word = np.zeros(0, dtype=np.uint64)
        self.shape = np.zeros(0, dtype=np.uint64)

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.index) > self.KEPT:
            self.clear()
        split = [words_of(t) for t in texts]
        new = list(set().union(*split).difference(self.index))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        crc = zlib.crc32
        self.word = np.r_[self.word, np.array([crc(w.lower().encode("utf-8", "surrogatepass")) for w in new], dtype=np.uint64)]
        self.shape = np.r_[self.shape, np.array([crc(shape(w).encode("utf-8", "surrogatepass")) for w in new], dtype=np.uint64)]
        get = self.index.__getitem__
        for words in split:
            n = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
            w, s = self.word[n], self.shape[n]
            if len(n) > 1:
                s = s + np.r_[False, n[1:] == n[:-1]].astype(np.uint64) * np.uint64(1 << 33)
            one, two = np.uint64(1 << 40), np.uint64(1 << 41)
            yield np.concatenate([_mix(w), _mix(w[:-1] ^ one, w[1:]), _mix(s ^ two), _mix(s[:-1] ^ two, s[1:]), _mix(s[:-2] ^ two, s[1:-1], s[2:])])


class FTRL:
    """Follow the regularised leader, proximal, one coordinate for each bucket and an intercept."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label
        g = error * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sparse(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets with their values; the intercept is last."""
    at, count = np.unique(buckets, return_counts=True)
    return np.r_[at, BUCKETS], np.r_[count / max(1, len(buckets)) * SCALE, 1.0]


def sample(labels: DataFrame, label: Column, id_col: str = "doc_id", rows: int = SAMPLE) -> DataFrame:
    """(key, label) of at most ``rows`` labelled ids, those of least hash. Where there are
    more, a hash threshold passes on about that many, so no task gathers more than that."""
    known = labels.select(F.col(id_col).alias("key"), label.cast("double").alias("label")).dropna()
    n, span = known.count(), 1 << 40
    if n > rows:
        most = int(span * rows / n)
        known = known.where(F.pmod(F.xxhash64("key"), F.lit(span)) < most)
    return known.orderBy(F.pmod(F.xxhash64("key"), F.lit(span)), "key", "label").limit(rows)


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights of all buckets and the intercept; ``labelled`` is a ``sample``."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(labelled), "key")
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SHARDS))).select("shard", "key", "text", "label")
    kinds = arrow_schema("bucket int, weight double")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("label", "ascending")])
        found = [sparse(b) for b in Features().of([t or "" for t in table.column("text").to_pylist()])]
        labels, model = table.column("label").to_pylist(), FTRL()
        order = np.random.default_rng(7)
        for _ in range(PASSES):
            for i in order.permutation(len(found)):
                model.update(*found[i], labels[i])
        weights = model.weights(slice(None))
        at = np.flatnonzero(weights)
        return pa.table({"bucket": pa.array(at, pa.int32()), "weight": weights[at]}, schema=kinds)

    fitted = shards.groupBy("shard").applyInArrow(fit, "bucket int, weight double")
    out = np.zeros(BUCKETS + 1)
    for r in fitted.groupBy("bucket").agg(F.sum("weight").alias("weight")).toLocalIterator():  # at most BUCKETS + 1 rows
        out[r.bucket] = r.weight / SHARDS
    return out


def quality_scores(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    state: list[Features] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not state:
            state.append(Features())
        w = shared.value
        raw = np.array([(w[b].sum() / max(1, len(b)) * SCALE) + w[-1] for b in state[0].of(texts_of(batch))])
        score = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
        return {"id": batch.column(0), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    out = map_rows(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
