"""Benchmark decontamination by latent semantic retrieval.

1. Words (lower-cased, letters and digits only) become 32-bit hashes, kept in a written
   table; their low bits are the term buckets.
2. Passages are ``PASSAGE`` words. The document frequency of every bucket over all passages
   gives the weights of the passage-term matrix A.
3. A randomised decomposition in one pass: tasks sum A'(A W) for a random W, partial sums
   are added in a tree, and the leading singular values and vectors follow from W and the
   sum alone (Nystroem). Whatever the corpus, this is BUCKETS x SKETCH numbers.
4. Passages at every half-passage step are projected, scaled by the singular values, and
   compared by cosine with all passages of the benchmark, in blocks of bounded size.
5. Around each candidate, an item counts as leaked if its longest common subsequence with
   the text covers ``SURE`` of its words, or ``LIKELY`` of them and its answer (its last
   quarter) is found in order as well.
6. Items under ``PASSAGE`` words fill too little of a passage for its cosine, and in a few
   passages all words are common, so that no vector tells them apart. So items are also
   looked for by their rarest words, ``TOGETHER`` of which stand near each other: of a short item
   in any text that holds ``LIKELY`` of it, of a longer one in any that holds as many of its
   ``RARE`` rarest words. Around them, a stretch of the item's own length and a quarter more
   on both sides is checked the same way.

Defined cases: null, empty and blank texts and items match nothing; repeated documents are
reported one by one; a row with a null id is reported with it; items found by their words
alone have a null cosine; an empty table on either side gives no rows; other columns are neither
read nor returned; texts are searched whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, as_batch, binary_of, map_rows, ranges_of, release, slices, small_batches, written

BUCKETS, SKETCH, RANK = 1 << 13, 72, 64
PASSAGE = 16
#: Buckets in a larger share of all passages are stop words: they weigh nothing.
COMMON = 0.02
HALF = PASSAGE // 2
#: Least cosine of a candidate; shares of an item's words that its subsequence must cover.
COSINE, SURE, LIKELY, ANSWER = 0.5, 0.8, 0.6, 0.67
#: Items of one block of queries (their words are broadcast).
BLOCK_ITEMS = 5_000
#: Passages of items compared at once in a task.
ITEM_PASSAGES = 16_384
#: Partial sums that one task adds up.
FAN_IN = 64
#: Passages compared at once in a task.
GROUP = 1_024
#: What is not part of words.
OTHER = r"[^\p{L}\p{N}]+"
#: Bytes of text whose words are hashed at once.
SLICE = 4 << 20
#: Of the rarest words of an item, how many must stand near each other; words of a longer item.
TOGETHER, RARE = 3, 8


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 32-bit hash of each string, 0 of empty ones only."""
    ends = np.cumsum(pc.binary_length(strings).to_numpy().astype(np.int64))
    begin = np.r_[0, ends[:-1]]
    data = np.frombuffer("".join(strings.to_numpy(zero_copy_only=False)).encode(), np.uint8)
    out, full = np.zeros(len(strings), dtype=np.uint32), np.flatnonzero(ends > begin)
    if not len(full):
        return out
    place = np.arange(len(data)) - np.repeat(begin, ends - begin)
    power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    sums = np.add.reduceat((data + np.uint64(1)) * power[place], begin[full])
    sums = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    out[full] = np.maximum(1, (sums ^ (sums >> np.uint64(29))) >> np.uint64(32))
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts end to end, and how many each text has. Each word is
    hashed once; those without letters or digits are left out."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    n = pc.list_value_length(split).to_numpy()
    coded = split.flatten().dictionary_encode()
    found = string_hashes(pc.replace_substring_regex(coded.dictionary, pattern=OTHER, replacement=""))[coded.indices.to_numpy()]
    real = found > 0
    return found[real], np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words) with 32-bit word hashes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, words binary"
    small_batches(docs.sparkSession)
    kinds = arrow_schema(schema)

    def run(batches):
        release()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in slices(texts, SLICE):
                words, n = word_hashes(texts.slice(a, b - a))
                yield as_batch({"id": batch.column(0).slice(a, b - a), "words": binary_of(words, 4 * n)}, kinds)

    return rows.mapInArrow(run, schema)


@dataclass
class Texts:
    """Words of a batch's documents, end to end; document d has ``words[begin[d]:begin[d + 1]]``."""

    words: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Texts:
        raw = [w or b"" for w in batch.column(batch.schema.get_field_index("words")).to_pylist()]
        return cls(np.frombuffer(b"".join(raw), np.uint32), np.cumsum([0, *(len(w) // 4 for w in raw)]))

    def stretch(self, d: int, start: int, stop: int) -> np.ndarray:
        return self.words[self.begin[d] + start : min(self.begin[d] + stop, self.begin[d + 1])]

    def padded(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets in rows of ``step`` (BUCKETS fills up), and the number of rows of each document."""
        n = np.diff(self.begin)
        rows = -(-n // step)
        flat = np.full(int(rows.sum()) * step, BUCKETS, dtype=np.int64)
        at = np.repeat((np.cumsum(rows) - rows) * step - self.begin[:-1], n) + np.arange(len(self.words))
        flat[at] = self.words & (BUCKETS - 1)
        return flat.reshape(-1, step), rows


def once(rows: np.ndarray) -> np.ndarray:
    """Each bucket once a row, so that repeated words don't outweigh all others."""
    rows = np.sort(rows, axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = BUCKETS
    return rows


def _sums(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of each row's vectors."""
    out = vectors[rows[:, 0]]
    for column in rows.T[1:]:
        out += vectors[column]
    return out


def _summed(parts: DataFrame) -> np.ndarray:
    """Sum of packed float64 arrays (part, sums), in a tree of at most FAN_IN at a time."""
    kinds = arrow_schema("part bigint, sums binary")

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for b in table.column("sums"):
            total = total + np.frombuffer(b.as_py(), np.float64)
        return pa.table({"part": [table.column("part")[0].as_py()], "sums": [total.tobytes()]}, schema=kinds)

    parts = written(parts, "sums")
    n = parts.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        group = F.pmod(F.xxhash64("part"), F.lit(n)).cast("bigint")
        parts = written(parts.withColumn("part", group).groupBy("part").applyInArrow(add, "part bigint, sums binary"), "sums")
    total = 0.0
    for r in parts.toLocalIterator():  # at most about FAN_IN rows
        total = total + np.frombuffer(r.sums, np.float64)
    return total


def _partial_sums(table: DataFrame, size: int, add) -> np.ndarray:
    """Sum over all batches of ``add(rows of buckets)``, arrays of ``size`` numbers."""
    small_batches(table.sparkSession)
    kinds = arrow_schema("part bigint, sums binary")

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            rows, _ = Texts.of(batch).padded(PASSAGE)
            for start in range(0, len(rows), 4 * GROUP):
                total += add(rows[start : start + 4 * GROUP])
        yield as_batch({"part": [TaskContext.get().partitionId()], "sums": [total.tobytes()]}, kinds)

    return _summed(table.select("words").mapInArrow(run, "part bigint, sums binary"))


def passage_frequency(table: DataFrame) -> np.ndarray:
    """How many passages hold each bucket; the last number is that of all passages."""

    def add(rows):
        counts = np.bincount(once(rows).ravel(), minlength=BUCKETS + 1).astype(float)
        counts[BUCKETS] = len(rows)
        return counts

    return _partial_sums(table, BUCKETS + 1, add)


@dataclass
class Latent:
    """``terms[b]`` projects bucket b, already weighted and scaled; the last row is zero.
    ``mean`` is what the mean passage projects to."""

    terms: np.ndarray
    mean: np.ndarray
    singular: np.ndarray
    frequency: np.ndarray  # passages with each bucket


def decompose(table: DataFrame, seed: int = 11) -> Latent:
    frequency = passage_frequency(table)
    # inverse document frequency as a root, which gives buckets of all frequencies one variance
    weight = np.r_[np.sqrt((frequency[-1] + 1) / (frequency[:-1] + 1)), 0.0]
    weight[:-1][frequency[:-1] > COMMON * frequency[-1]] = 0.0
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, SKETCH)))[0]
    sketch = np.vstack([weight[:-1, None] * omega, np.zeros(SKETCH)]).astype(np.float32)

    stop = weight == 0

    def add(rows):
        rows = once(rows)
        projected = _sums(sketch, rows)  # A W for these passages
        kept = np.flatnonzero(~stop[rows])
        buckets, passage = rows.ravel()[kept], kept // rows.shape[1]
        return np.stack([np.bincount(buckets, column[passage], BUCKETS + 1)[:BUCKETS] for column in projected.T.copy()], 1).ravel()

    y = _partial_sums(table, BUCKETS * SKETCH, add).reshape(BUCKETS, SKETCH) * weight[:-1, None]
    # Nystroem: A'A is about Y (W'Y)^-1 Y', shifted to keep the factor positive definite
    shift = np.finfo(float).eps * max(1.0, np.linalg.norm(y)) * 100
    y = y + shift * omega
    middle = omega.T @ y
    try:
        factor = np.linalg.cholesky((middle + middle.T) / 2)
    except np.linalg.LinAlgError:  # nearly no text: no directions to tell apart
        values, vectors = np.linalg.eigh((middle + middle.T) / 2)
        factor = vectors * np.sqrt(np.maximum(values, shift))
    left, singular, _ = np.linalg.svd(np.linalg.solve(factor, y.T).T, full_matrices=False)
    good = singular[:RANK] > 1e-6 * max(singular[0], 1e-30)
    scaled = left[:, :RANK] * np.where(good, 1 / np.maximum(singular[:RANK], 1e-30), 0)
    terms = np.vstack([weight[:-1, None] * scaled, np.zeros(scaled.shape[1])]).astype(np.float32)
    mean = (frequency[:-1] / max(1.0, frequency[-1])) @ terms[:-1]
    return Latent(terms, mean.astype(np.float32), singular, frequency[:-1])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(1e-30, np.sqrt((v * v).sum(1, keepdims=True)))


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    vectors: np.ndarray  # of all passages of all items
    item: np.ndarray  # the item of each
    start: np.ndarray  # and its first word
    short: Short


@dataclass
class Short:
    """The rarest words of items, sorted: the item of each, and its place in the item.
    For all items: how many of these words must stand together, in how long a stretch."""

    word: np.ndarray
    item: np.ndarray
    at: np.ndarray
    known: np.ndarray  # whether the low 16 bits of a word occur
    together: np.ndarray
    shift: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray], frequency: np.ndarray) -> Short:
        found, together = [], np.ones(len(words), dtype=np.int64)
        for i, w in enumerate(words):
            if 0 < len(w) < PASSAGE:
                # a text with `need` of the words holds one at least of any len - need + 1
                need = -(-len(w) * 3 // 5)
                together[i] = min(TOGETHER, need)
                rarest = np.argsort(frequency[w.astype(np.int64) & (BUCKETS - 1)], kind="stable")
                found.extend((int(w[at]), i, int(at)) for at in rarest[: len(w) - need + int(together[i])])
            elif len(w):
                distinct = np.sort(np.unique(w, return_index=True)[1])
                rarest = distinct[np.argsort(frequency[w[distinct].astype(np.int64) & (BUCKETS - 1)], kind="stable")]
                together[i] = min(TOGETHER, len(rarest))
                found.extend((int(w[at]), i, int(at)) for at in rarest[:RARE])
        word, item, at = np.array(sorted(found), dtype=np.int64).reshape(-1, 3).T
        known = np.zeros(1 << 16, dtype=bool)
        known[word & 0xFFFF] = True
        shift = np.array([len(w) + 2 * (len(w) // 4) for w in words], dtype=np.int64)
        return cls(word.astype(np.uint32), item, at, known, together, shift)

    def places(self, texts: Texts) -> list[tuple[int, int, int]]:
        """(document, item, begin) wherever enough of the words are near each other."""
        maybe = np.flatnonzero(self.known[texts.words & 0xFFFF])
        first, last = (np.searchsorted(self.word, texts.words[maybe], side) for side in ("left", "right"))
        n = last - first
        which = ranges_of(first, n)
        item, word = self.item[which], np.repeat(maybe, n)
        doc = np.searchsorted(texts.begin, word, "right") - 1
        # begins of one item and document are neighbours, those of others far away
        begin = word - texts.begin[doc] - self.at[which]
        place = np.lexsort((begin, item, doc))
        doc, item, begin = doc[place], item[place], begin[place]
        group = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else doc
        line = group * (1 << 32) + begin
        until = np.searchsorted(line, line + self.shift[item], "right")
        good = np.flatnonzero(until - np.arange(len(line)) >= self.together[item])
        held = np.zeros(len(line) + 1, dtype=np.int64)
        np.add.at(held, good, 1)
        np.add.at(held, until[good], -1)
        kept = np.flatnonzero(np.cumsum(held)[:-1] > 0)
        places = np.unique(np.stack([doc[kept], item[kept], begin[kept]], 1), axis=0)
        return [tuple(p) for p in places.tolist()]


def short_leaks(short: Short, items: list[np.ndarray], texts: Texts) -> dict[tuple[int, int], tuple[float, int]]:
    """The best (share, start) of each document's items that are found by their words."""
    out: dict[tuple[int, int], tuple[float, int]] = {}
    if len(short.word):
        for d, i, begin in short.places(texts):
            item = items[i]
            slack = len(item) // 4
            start = max(0, begin - slack)
            good, share = leaked(item, texts.stretch(d, start, begin + len(item) + slack))
            if good and share > out.get((d, i), (0.0,))[0]:
                out[d, i] = share, start
    return out


def prepare(ids: list, words: list[np.ndarray], latent: Latent) -> Items:
    vectors, item, start = [], [], []
    for i, w in enumerate(words):
        for at in range(0, max(1, len(w) - PASSAGE + 1), HALF) if len(w) else []:
            buckets = w[at : at + PASSAGE].astype(np.int64) & (BUCKETS - 1)
            halves = [once(h[None])[0] for h in (buckets[:HALF], buckets[HALF:])]
            vectors.append(latent.terms[np.concatenate(halves)].sum(0) - latent.mean)
            item.append(i)
            start.append(at)
    found = _unit(np.array(vectors, dtype=np.float32)) if vectors else np.zeros((0, latent.terms.shape[1]), np.float32)
    return Items(ids, words, found, np.array(item, dtype=np.int64), np.array(start, dtype=np.int64), Short.of(words, latent.frequency))


def subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        if m := where.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def leaked(item: np.ndarray, text: np.ndarray) -> tuple[bool, float]:
    """Whether the stretch of text holds the item, and the share of its words found."""
    if np.isin(item, text).mean() < LIKELY:
        return False, 0.0
    share = subsequence(item, text) / len(item)
    if share >= SURE or share < LIKELY:
        return share >= SURE, share
    answer = item[-max(3, len(item) // 4) :]
    return subsequence(answer, text) / len(answer) >= ANSWER, share


def search(table: DataFrame, items: Items, latent: Latent, item_kind: str) -> DataFrame:
    """(id, item, word, share, cosine): items found, with the first word of the stretch."""
    shared = table.sparkSession.sparkContext.broadcast((items, latent.terms, latent.mean))
    id_kind = table.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        items, terms, mean = shared.value
        texts = Texts.of(batch)
        rows, n = texts.padded(HALF)
        ids = batch.column(0).to_pylist()
        doc = np.repeat(np.arange(len(n)), n)
        first_row = np.cumsum(n) - n
        best: dict[tuple[int, int, int], tuple[float, int]] = {}
        for at in range(0, len(rows), GROUP):
            halves = _sums(terms, once(rows[at : at + GROUP + 1]))
            own = doc[at : at + GROUP + 1]
            both = halves.copy()
            both[:-1][own[1:] == own[:-1]] += halves[1:][own[1:] == own[:-1]]
            both = _unit(both[:GROUP] - mean)
            for from_ in range(0, len(items.vectors), ITEM_PASSAGES):
                score = both @ items.vectors[from_ : from_ + ITEM_PASSAGES].T
                near, which = np.divmod(np.flatnonzero(score.ravel() >= COSINE), score.shape[1])
                for p, q in zip(near.tolist(), which.tolist(), strict=True):
                    d, i = int(own[p]), int(items.item[from_ + q])
                    begin = int(at + p - first_row[d]) * HALF - int(items.start[from_ + q])
                    key = d, i, begin // PASSAGE
                    if key not in best or best[key][0] < score[p, q]:
                        best[key] = float(score[p, q]), begin
        out: dict[tuple[int, int], tuple] = {}
        for (d, i, _), (cosine, begin) in best.items():
            item = items.words[i]
            start = max(0, begin - PASSAGE)
            good, share = leaked(item, texts.stretch(d, start, begin + len(item) + PASSAGE))
            if good and share > out.get((d, i), (0.0,))[0]:
                out[d, i] = share, start, cosine
        for key, (share, start) in short_leaks(items.short, items.words, texts).items():
            if share > out.get(key, (0.0,))[0]:
                out[key] = share, start, None
        return {
            "id": [ids[d] for d, _ in out], "item": [items.ids[i] for _, i in out], "word": [v[1] for v in out.values()],
            "share": [v[0] for v in out.values()], "cosine": [v[2] for v in out.values()],
        }

    return map_rows(table, run, f"id {id_kind}, item {item_kind}, word bigint, share double, cosine double")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, word, share, cosine) for every document that holds a benchmark item."""
    table = written(hashed(docs, id_col, text_col).where("octet_length(words) > 0"), "words")
    latent = decompose(table)
    queries = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    item_kind = queries.schema["item"].dataType.simpleString()
    blocks = -(-queries.count() // BLOCK_ITEMS) or 1
    out = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item").collect()
        flat, n = word_hashes(pa.array([r.text for r in own], pa.string()))
        words = np.split(flat, np.cumsum(n)[:-1]) if own else []
        found = search(table, prepare([r.item for r in own], words, latent), latent, item_kind)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})
