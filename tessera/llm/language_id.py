"""Language identification of whole texts, with spans of mixed-language text.

Training counts hashed character trigrams of words by language, over all training rows;
each task sends partial sums, so a language is at most ``BUCKETS`` rows however large or
hot it is. A word's score in a language is the mean log probability of its trigrams.

A prediction first narrows a word's languages to those seen with its script (Unicode
ranges). Viterbi over the words' scores, with a penalty for each switch, then labels spans;
texts of similar length go through it side by side, and long ones by stretches of
``STRETCH`` words, so that memory beyond a few bytes a word doesn't grow with languages. The predicted language is the one whose
spans hold most letters; the score is their share, weighted by how sure the words are.

Defined cases: a null text, or one without letters, is ``und`` with score 0; words (by white
space) without letters take their neighbours' label; letters of a script never seen in training give the
most frequent language with score 0; ties go to the first language in alphabetical order;
training rows without a language or text are skipped; without training rows all is ``und``;
an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, as_batch, map_rows, release, small_batches, texts_of, written

BUCKETS = 1 << 14
#: Cost, in log probability of a word, of a switch of language between two words.
SWITCH = 6.0
#: Words whose switches are held at once; a multiple of 64.
STRETCH = 1 << 14
#: Learned languages are refused beyond this number: the model is sent to every task.
MAX_LANGUAGES = 400
#: First code point after each script's range, and the script.
SCRIPT_ENDS = (
    (0x0250, "Latin"), (0x0370, "other"), (0x0400, "Greek"), (0x0530, "Cyrillic"), (0x0590, "Armenian"), (0x0600, "Hebrew"),
    (0x0780, "Arabic"), (0x0900, "other"), (0x0980, "Devanagari"), (0x0A00, "Bengali"), (0x0E00, "other"), (0x0E80, "Thai"),
    (0x10A0, "other"), (0x1100, "Georgian"), (0x1200, "Hangul"), (0x1E00, "other"), (0x1F00, "Latin"), (0x2000, "Greek"),
    (0x3040, "other"), (0x3100, "Kana"), (0x3400, "other"), (0xA000, "Han"), (0xAC00, "other"), (0xD7B0, "Hangul"),
    (0xF900, "other"), (0xFB00, "Han"), (0x20000, "other"), (0x32000, "Han"), (0x110000, "other"),
)
SCRIPTS = sorted({s for _, s in SCRIPT_ENDS})
_ENDS = np.array([e for e, _ in SCRIPT_ENDS])
_SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in SCRIPT_ENDS])


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the trigrams of words (of letters), each padded by spaces, one word
    after the other, and how many each word has: as many as it has letters."""
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return (mixed % np.uint64(BUCKETS)).astype(np.int64)[codes[1:-1] != 32], np.fromiter(map(len, words), np.int64, len(words))


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    return _SCRIPT_OF[np.searchsorted(_ENDS, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), "right")]


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # (BUCKETS, languages), mean log probabilities
    scripts: np.ndarray  # (scripts, languages), whether seen together
    common: int  # the most frequent language


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) for trigrams, and bucket -1 - script for the words of a script."""
    small_batches(rows.sparkSession)
    kinds = arrow_schema("lang string, bucket int, n bigint")

    def partial(batches):
        release()
        sums: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                words.setdefault(lang, Counter()).update(text.lower().split())
            for lang, own in words.items():
                table = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                script = scripts.setdefault(lang, np.zeros(len(SCRIPTS), dtype=np.int64))
                found = [(w, n) for raw, n in own.items() if (w := letters_of(raw))]
                if found:
                    plain, n = [f[0] for f in found], np.array([f[1] for f in found])
                    buckets, sizes = trigrams(plain)
                    table += np.bincount(buckets, np.repeat(n, sizes), BUCKETS).astype(np.int64)
                    script += np.bincount(scripts_of(plain), n, len(SCRIPTS)).astype(np.int64)
        for lang, table in sums.items():
            every = np.r_[table, scripts[lang][::-1]]
            at = np.flatnonzero(every)
            bucket = np.where(at < BUCKETS, at, at - len(every))
            yield as_batch({"lang": [lang] * len(at), "bucket": bucket, "n": every[at]}, kinds)

    parts = rows.mapInArrow(partial, "lang string, bucket int, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", script_share: float = 0.01) -> Model:
    """A model of all labelled rows: at most MAX_LANGUAGES x (BUCKETS + scripts) numbers."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = written(_counts(rows.where("lang is not null and text is not null")), "grams")
    languages = sorted(r.lang for r in found.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    number = {lang: i for i, lang in enumerate(languages)}
    grams, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    for r in found.toLocalIterator():
        if r.bucket >= 0:
            grams[r.bucket, number[r.lang]] = r.n
        else:
            scripts[-1 - r.bucket, number[r.lang]] = r.n
    words = scripts.sum(0)
    logp = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    seen = scripts >= np.maximum(1, script_share * words)
    return Model(languages, logp, seen, int(words.argmax()) if len(languages) else -1)


class Labeller:
    """Viterbi over a model; the rows of words seen before are kept, up to a bound."""

    KEPT = 500_000

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        """Row 0 stands for words without letters: no evidence."""
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1, len(self.model.languages)), dtype=np.float32)
        self.letters = np.zeros(1, dtype=np.int64)
        self.sums = np.exp(self.scores).sum(1)
        self.known = np.zeros(1, dtype=bool)

    def _add(self, words: list[str]) -> None:
        m = self.model
        plain = [letters_of(w) for w in words]
        full = [p for p in plain if p]
        if not full:
            self.index.update(dict.fromkeys(words, 0))
            return
        buckets, sizes = trigrams(full)
        mean = np.add.reduceat(m.logp[buckets], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        allowed = m.scripts[scripts_of(full)]
        score = mean * (np.minimum(sizes + 1, 8) / 2)[:, None]
        score = score - np.where(allowed, score, -np.inf).max(1, keepdims=True, initial=-1e30)
        # a row of zeros is no evidence, so the best of a known script is a little less
        score = np.where(allowed, score - 1e-6, np.where(allowed.any(1, keepdims=True), -60.0, 0.0)).astype(np.float32)
        number = iter(range(len(self.letters), len(self.letters) + len(full)))
        self.index.update((w, next(number) if p else 0) for w, p in zip(words, plain, strict=True))
        self.scores = np.concatenate([self.scores, score])
        self.letters = np.concatenate([self.letters, sizes])
        self.sums = np.concatenate([self.sums, np.exp(score).sum(1)])
        self.known = np.concatenate([self.known, score.any(1)])

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """For each text the letters of each of its words, their language and how sure it is,
        and whether any word of it has evidence."""
        if len(self.index) > self.KEPT:
            self.clear()
        words = [t.lower().split() for t in texts]
        if new := set().union(*words).difference(self.index):
            self._add(list(new))
        get = self.index.__getitem__
        numbers = [np.fromiter(map(get, w), dtype=np.int64, count=len(w)) for w in words]
        order = sorted(range(len(texts)), key=lambda i: len(words[i]))
        paths: list[np.ndarray] = [np.zeros(0, dtype=np.int16)] * len(texts)
        start = 0
        while start < len(order):  # groups of similar length, of at most a million words
            end, least = start + 1, max(32, len(words[order[start]]))
            while end < len(order) and len(words[order[end]]) <= 2 * least and (end - start + 1) * len(words[order[end]]) <= 1_000_000:
                end += 1
            group = order[start:end]
            for i, path in zip(group, viterbi([numbers[i] for i in group], self.scores), strict=True):
                paths[i] = path
            start = end
        if not self.scores.shape[1]:
            return [(self.letters[n], p, np.zeros(len(n), np.float32), False) for p, n in zip(paths, numbers, strict=True)]
        return [(self.letters[n], p, np.exp(self.scores[n, p]) / self.sums[n], bool(self.known[n].any())) for p, n in zip(paths, numbers, strict=True)]


def viterbi(numbers: list[np.ndarray], table: np.ndarray, switch: float = SWITCH) -> list[np.ndarray]:
    """Best language of each word, for several texts side by side, longest last.

    ``table[numbers[i]]`` are the word scores of text i. Texts end in row 0 (no evidence),
    which changes nothing, so all can run to the longest's end.
    """
    longest, n, k = max(map(len, numbers), default=0), len(numbers), table.shape[1]
    if not longest or not k:
        return [np.zeros(len(x), dtype=np.int8) for x in numbers]
    grid = np.zeros((longest, n), dtype=np.int64)
    for j, x in enumerate(numbers):
        grid[: len(x), j] = x
    each = np.arange(n)

    def forward(best: np.ndarray, begin: int, end: int, came=None, switched=None) -> np.ndarray:
        """The best sums after words ``begin`` to ``end``; ``came`` and ``switched`` take where a
        switch to a word comes from, and which languages it is better for."""
        for t in range(begin, end):
            top = best.argmax(1)
            other = best[each, top] - switch
            if came is not None:
                came[t - begin] = top
                np.greater(other[:, None], best, out=switched[t - begin])
            best = np.maximum(best, other[:, None]) + table[grid[t]]
            if t % 64 == 63:
                best -= best.max(1, keepdims=True)
        return best

    begins = list(range(0, longest, STRETCH))
    starts = [np.zeros((n, k), dtype=np.float32)]
    for begin in begins[:-1]:
        starts.append(forward(starts[-1], begin, begin + STRETCH))
    most = min(longest, STRETCH)
    came, switched = np.zeros((most, n), dtype=np.int16), np.zeros((most, n, k), dtype=bool)
    path = np.zeros((longest, n), dtype=np.int16)
    now = None
    for begin, best in zip(reversed(begins), reversed(starts), strict=True):
        end = min(begin + STRETCH, longest)
        best = forward(best, begin, end, came, switched)
        now = best.argmax(1) if now is None else now
        for t in range(end - 1, begin - 1, -1):
            path[t] = now
            now = np.where(switched[t - begin, each, now], came[t - begin], now)
    return [path[: len(x), j] for j, x in enumerate(numbers)]


def verdict(model: Model, letters: np.ndarray, path: np.ndarray, sure: np.ndarray, known: bool) -> tuple[str, float]:
    total = letters.sum()
    if not total or not model.languages:
        return "und", 0.0
    if not known:
        return model.languages[model.common], 0.0
    held = np.bincount(path, letters, len(model.languages))
    best = int(held.argmax())
    own = path == best
    return model.languages[best], float(np.clip(held[best] / total * np.average(sure[own], weights=letters[own]), 0.0, 1.0))


def spans(model: Model, path: np.ndarray) -> list[tuple[int, int, str]]:
    """(first word, number of words, language) of each run."""
    edges = np.r_[0, np.flatnonzero(np.diff(path)) + 1, len(path)] if len(path) else [0]
    return [(int(a), int(b - a), model.languages[path[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _labelled(docs: DataFrame, model: Model, id_col: str, text_col: str, schema: str, rows_of) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    state: list[Labeller] = []  # one in each Python worker's copy

    def run(batch: pa.RecordBatch) -> dict:
        if not state:
            state.append(Labeller(shared.value))
        return rows_of(shared.value, batch.column(0), state[0].label(texts_of(batch)))

    return map_rows(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every text."""

    def rows_of(model, ids, labelled):
        found = [verdict(model, *x) for x in labelled]
        return {"id": ids, "lang": [f[0] for f in found], "score": [f[1] for f in found]}

    return _labelled(docs, model, id_col, text_col, "lang_pred string, score double", rows_of)


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, n_words, lang): runs of one language, words counted from 0."""

    def rows_of(model, ids, labelled):
        found = [(i, *s) for i, (_, path, *_) in zip(ids.to_pylist(), labelled, strict=True) if model.languages for s in spans(model, path)]
        return dict(zip(("id", "first", "n", "lang"), [list(c) for c in zip(*found, strict=True)] or [[]] * 4, strict=True))

    return _labelled(docs, model, id_col, text_col, "first_word bigint, n_words bigint, lang string", rows_of)


def keep_identified(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with score ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches):
        release()
        labeller = Labeller(shared.value)
        for batch in batches:
            found = [verdict(shared.value, *x) for x in labeller.label(texts_of(batch, text_col))]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
