"""Packing token sequences by non-negative least squares over length combinations.

1. Every document is tokenised once. Its full windows stand alone; what is left over (the
   "rest", 1 to window - 1 ids) goes to the packing. A written table keeps, for each
   document, the checksums of its full windows and of its rest, the ids of the rest, and
   the rest's place among those of its task with the same length.
2. The histogram of rest lengths (at most window - 1 numbers, whatever the corpus) goes to
   the driver. All combinations of one, two or three lengths that fill a window exactly
   are enumerated; repeat counts are solved by non-negative least squares against the
   histogram, rounded, and lowered where they would use more rests than there are.
3. The residuals are packed greedily, longest first, each window filled by the longest rest
   that still fits. Lengths whose windows don't fill exactly are laid end to end and cut
   where a window is full. What remains in the last window is cut into powers of two, which
   need no padding.
4. Each rest finds its slot from its length and its number among rests of that length:
   numbers are per-task counts shifted by the sums of earlier tasks. No length's rests
   meet in one task. Only rests that are cut are read again with their ids; numbers rise
   with tasks, so these are found by the first task of each length that has one.

Defined cases: a null or empty text is the end id alone (one piece of length 1); equal
documents are packed one by one; an empty table gives no rows; very long documents are
tokenised part by part; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import arrow_schema, as_batch, binary_of, kept, map_rows, ranges_of, slices, small_batches, written

#: Bytes of text that are tokenised at once.
SLICE = 4 << 20


class Encoder:
    """Ids of whole texts, each followed by the end id.

    A text is cut at spaces and around line feeds, where the byte-level splitting pattern
    always ends a word if the neighbours aren't white space. ``ids`` holds the ids of all
    known parts end to end: part i has ``ids[start[i] : start[i + 1]]``, and part 0 is the
    end. ``bare`` and ``spaced`` number the parts of words without and with a space before.
    """

    def __init__(self, vocabulary: bytes, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self._ids(["\n"])[0][0]
        self.end_id = end_id
        self.clear()

    def clear(self) -> None:
        self.bare: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.ids, self.start = np.array([self.end_id], dtype="<u4"), np.array([0, 1])

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and the end of each text's."""
        found: list[list[int]] = []
        for i in range(0, len(texts), 10_000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return np.fromiter(chain.from_iterable(found), "<u4", ends[-1] if len(ends) else 0), ends

    def _ids_of_words(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for words after ``before``, which are put in the order of the ids. Printable
        words hold no white space, so many are tokenised as one text of lines, and the ids
        are cut where a line feed's id is."""
        lines = [w for w in words if w.isprintable() and w]
        ids, ends, done = [], [], 0
        for i in range(0, len(lines), 10_000):
            found = self._ids([before + f"\n{before}".join(lines[i : i + 10_000])])[0]
            edges = np.flatnonzero(found == self.feed)
            ids.append(np.delete(found, edges))
            ends.append(done + np.r_[edges - np.arange(len(edges)), len(ids[-1])])
            done += len(ids[-1])
        own, own_ends = self._ids([before + w for w in words if not (w.isprintable() and w)])
        words[:] = lines + [w for w in words if not (w.isprintable() and w)]
        return np.concatenate([*ids, own]), np.concatenate([*ends, done + own_ends])

    def _numbers(self, codes: np.ndarray, words: np.ndarray, known: dict[str, int], before: str) -> np.ndarray:
        """The part of each code: its word after ``before``."""
        asked = np.zeros(len(words), dtype=bool)
        asked[codes] = True
        asked = np.flatnonzero(asked)
        own = words[asked].tolist()
        found = list(map(known.get, own))
        if None in found:
            new = [w for w, i in zip(own, found, strict=True) if i is None]
            ids, ends = self._ids_of_words(new, before)
            known.update(zip(new, range(len(self.start) - 1, len(self.start) - 1 + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            self.start = np.concatenate([self.start, self.start[-1] + ends])
            found = list(map(known.__getitem__, own))
        table = np.zeros(len(words), dtype=np.int64)
        table[asked] = found
        return table[codes]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has. A text with a special string, or
        with white space next to a space or line feed, is tokenised as a whole."""
        if len(self.start) > bpe.CACHE or len(self.ids) > 8 * bpe.CACHE:
            self.clear()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        n = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        blank = pc.or_(pc.equal(pc.binary_length(words), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1)))
        feed = pc.index(words, "\n").as_py()
        loose = blank.to_numpy(zero_copy_only=False).copy()
        if feed >= 0:
            loose[feed] = False
        words = words.to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(n)), n)
        first = np.zeros(len(code), dtype=bool)
        first[np.cumsum(n) - n] = True
        feeds = code == feed
        # an empty first part is a text that begins with a space or line feed
        whole = np.zeros(len(n), dtype=bool)
        whole[text[loose[code] & ~first]] = True
        whole[n == 1] |= loose[code[first & (n[text] == 1)]]
        for mark in self.special:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        bare = first | feeds
        bare[1:] |= feeds[:-1]
        good = ~whole[text]
        code, text, bare = code[good], text[good], bare[good]
        part = np.zeros(len(code), dtype=np.int64)
        part[bare] = self._numbers(code[bare], words, self.bare, "")
        part[~bare] = self._numbers(code[~bare], words, self.spaced, " ")
        ids, start = self.ids, self.start
        odd = np.flatnonzero(whole)
        if len(odd):
            own, ends = self._ids(texts.take(pa.array(odd)).to_pylist())
            part, text = np.r_[part, len(start) - 1 + np.arange(len(odd))], np.r_[text, odd]
            ids, start = np.concatenate([ids, own]), np.r_[start, start[-1] + ends]
        text = np.r_[text, np.arange(len(n))]
        order = np.argsort(text, kind="stable")
        part, text = np.r_[part, np.zeros(len(n), np.int64)][order], text[order]
        size = start[part + 1] - start[part]
        return ids[ranges_of(start[part], size)], np.bincount(text, size, len(n)).astype(np.int64)


def encoder_for(vocabulary: bytes, end_id: int) -> Encoder:
    return kept(f"encoder-{hash(vocabulary)}-{end_id}", lambda: Encoder(vocabulary, end_id))


@dataclass
class Plan:
    """Where rests go. Row i says: rests of length ``length[i]`` numbered ``first[i]`` on
    (up to the next row of that length) come ``each[i]`` to a sequence, from sequence
    ``sequence[i]`` and offset ``offset[i]`` on. Later numbers are laid end to end from
    ``tail_start[length]``; ``taken[length]`` is the first of these numbers."""

    window: int
    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    taken: np.ndarray
    tail_start: np.ndarray
    tail_tokens: int
    sequences: int

    def rows_of(self, length: int) -> tuple[int, int]:
        return int(np.searchsorted(self.length, length, "left")), int(np.searchsorted(self.length, length, "right"))


def combinations_filling(window: int) -> np.ndarray:
    """All sorted pairs and triples of lengths that add up to the window; 0 pads a pair."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    triples = []
    for small in range(1, window // 3 + 1):
        mid = np.arange(small, (window - small) // 2 + 1)
        triples.append(np.stack([np.full_like(mid, small), mid, window - small - mid], 1))
    return np.concatenate([pairs, *triples]) if triples else pairs


def solve_repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with least squared error of A x against the histogram.

    Column c of A counts how often combination c holds each length. Accelerated projected
    gradient; A is kept as its three index columns. The step is 1 / ||A||^2, bounded by the
    largest row sum times the largest column sum.
    """
    size = len(histogram)

    def forward(x):
        return sum(np.bincount(combos[:, j], x, size) for j in range(combos.shape[1]))

    real = np.arange(size) > 0
    weight = real / np.maximum(1.0, np.sqrt(histogram))
    bound = (forward(np.ones(len(combos))) * weight**2).max() * combos.shape[1]
    x = y = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(steps):
        error = (forward(y) - histogram) * weight**2
        new = np.maximum(0.0, y - error[combos].sum(1) / bound)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def whole_repeats(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Rounded repeat counts that use no length more often than it occurs.

    Combinations are taken greedily, largest repeat count first; a second pass lets each
    use what the rounding left.
    """
    left = histogram.astype(np.int64).copy()
    out = np.zeros(len(combos), dtype=np.int64)

    def take(c: int, wanted: int | None) -> None:
        lengths, need = np.unique(combos[c][combos[c] > 0], return_counts=True)
        most = int((left[lengths] // need).min())
        some = most if wanted is None else min(most, wanted)
        if some > 0:
            out[c] += some
            left[lengths] -= some * need

    order, whole = np.argsort(-x, kind="stable"), np.rint(x).astype(np.int64)
    for c in order[whole[order] > 0].tolist():
        take(c, int(whole[c]))
    while len(order):  # those whose lengths are all left, some at a time
        order = order[((combos[order] == 0) | (left[combos[order]] > 0)).all(1)]
        for c in order[:256].tolist():
            take(c, None)
        order = order[256:]
    return out


def greedy_fills(left: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(lengths, each, repeats) of windows filled greedily from ``left``, which is lowered:
    the longest rest first, then the longest that fits. A length that begins no full window
    is put aside, so each step uses up or puts aside at least one length."""
    out, aside = [], np.zeros_like(left)
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        free, taken, room = left.copy(), np.zeros_like(left), window
        while room:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            some = min(int(free[length]), room // length)
            taken[length] += some
            free[length] -= some
            room -= some * length
        if room:
            aside[longest], left[longest] = left[longest], 0
            continue
        lengths = np.flatnonzero(taken)
        repeats = int((left[lengths] // taken[lengths]).min())
        left -= repeats * taken
        out.append((lengths, taken[lengths], repeats))
    left += aside
    return out


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """histogram[r]: how many rests have r ids (histogram[0] is ignored)."""
    histogram = histogram.copy()
    histogram[0] = 0
    combos = combinations_filling(window)
    combos = combos[((combos == 0) | (histogram[combos] > 0)).all(1)]
    x = solve_repeats(combos, histogram.astype(float)) if len(combos) else np.zeros(0)
    repeats = whole_repeats(combos, x, histogram)
    fills = [(*np.unique(combos[c][combos[c] > 0], return_counts=True), int(repeats[c])) for c in np.flatnonzero(repeats)]
    left = histogram.astype(np.int64)
    for lengths, need, n in fills:
        left[lengths] -= n * need
    fills += greedy_fills(left, window)
    rows, taken, sequence = [], np.zeros(window, dtype=np.int64), 0
    for lengths, need, n in fills:
        offset = 0
        for length, each in zip(lengths.tolist(), need.tolist(), strict=True):
            rows.append((length, int(taken[length]), each, sequence, offset))
            taken[length] += n * each
            offset += length * each
        sequence += n
    tail_start, position = np.zeros(window, dtype=np.int64), 0
    for length in range(window - 1, 0, -1):
        tail_start[length] = position
        position += int(histogram[length] - taken[length]) * length
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Plan(window, *table.T, taken, tail_start, position, sequence + -(-position // window))


def cuts_of_last(plan: Plan) -> list[int]:
    """Lengths (powers of two, falling) into which the last, unfilled window is cut."""
    rest = plan.tail_tokens % plan.window
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def placed(plan: Plan, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of rests that are not cut."""
    row = np.searchsorted(plan.length << 40 | plan.first, length.astype(np.int64) << 40 | number, "right") - 1
    nth, inside = np.divmod(number - plan.first[row], plan.each[row])
    return plan.sequence[row] + nth, plan.offset[row] + inside * length


def slots(plan: Plan, length: int, number: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, ids) of each piece of a rest, with sequences counted from 0."""
    w = plan.window
    if number < plan.taken[length]:
        sequence, offset = placed(plan, np.array([length]), np.array([number]))
        return [(int(sequence[0]), int(offset[0]), length)]
    at = int(plan.tail_start[length]) + (number - int(plan.taken[length])) * length
    base = plan.sequences - -(-plan.tail_tokens // w)
    full = plan.tail_tokens // w * w
    out, end = [], at + length
    edges = np.cumsum([0, *cuts_of_last(plan)]) + full
    while at < end:
        if at < full:
            to = min(end, (at // w + 1) * w)
            out.append((base + at // w, at % w, to - at))
        else:
            k = int(np.searchsorted(edges, at, "right")) - 1
            to = min(end, int(edges[k + 1]))
            out.append((base + full // w + k, at - int(edges[k]), to - at))
        at = to
    return out


def tokenised(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: checksums of its full windows and its rest, the rest, and its
    numbers in its task (``nth`` among rests of its length, ``full_nth`` among full windows)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(tokenizer_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, doc_tokens bigint, crcs array<bigint>, full_nth bigint, rest binary, rest_crc bigint, length int, nth bigint"
    kinds = arrow_schema(schema)

    def encode(batches):
        encoder, seen, windows = encoder_for(shared.value, end_id), np.zeros(window, dtype=np.int64), 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in slices(texts, SLICE):
                ids, n = encoder.encode(texts.slice(a, b - a))
                raw, begin = memoryview(ids).cast("B"), np.cumsum(n) - n
                full, length = np.divmod(n, window)
                at = 4 * (np.repeat(begin - (np.cumsum(full) - full) * window, full) + np.arange(full.sum()) * window)
                crcs = [zlib.crc32(raw[i : i + 4 * window]) for i in at.tolist()]
                last = begin + full * window
                rest_crcs = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(last.tolist(), (begin + n).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                count = np.bincount(length, minlength=window)
                nth = np.empty_like(length)
                nth[order] = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
                seen += count
                yield as_batch({
                    "id": batch.column(0).slice(a, b - a), "doc_tokens": n,
                    "crcs": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full)], pa.int32()), pa.array(crcs, pa.int64())),
                    "full_nth": windows + np.cumsum(full) - full, "rest": binary_of(ids[ranges_of(last, length)], 4 * length), "rest_crc": rest_crcs,
                    "length": length, "nth": nth,
                }, kinds)
                windows += int(full.sum())

    return rows.mapInArrow(encode, schema).withColumn("task", F.spark_partition_id())


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Packed sequences come first, then the documents' own full windows, numbered by the same
    per-task counting. Every sequence is a full window or a power of two; none is padded.
    """
    held = written(tokenised(docs, tokenizer_path, window, end_id, id_col, text_col), "tokens")
    # full windows count as "length 0", which no rest of a non-empty document has
    rests = held.where("length > 0").groupBy("task", "length").agg(F.count("*").alias("n"))
    fulls = held.groupBy("task").agg(F.sum(F.size("crcs")).alias("n")).select("task", F.lit(0).alias("length"), "n")
    # one row for each task and length, never one for each document
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rests.unionByName(fulls).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = written(counts, "counts")
    histogram = np.zeros(window, dtype=np.int64)
    for row in counts.where("length > 0").groupBy("length").agg(F.sum("n").alias("n")).collect():  # under `window` rows
        histogram[row.length] = row.n
    plan = make_plan(histogram, window)

    starts = counts.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"))
    taken = F.get(F.lit(plan.taken.tolist()), F.col("length"))
    cut = (F.col("length") > 0) & (F.col("nth") >= taken)

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.join(starts, "task").withColumns({
            "nth": F.col("nth") + F.coalesce(F.col("before")[F.col("length")], F.lit(0)),
            "full_nth": F.col("full_nth") + F.coalesce(F.col("before")[F.lit(0)], F.lit(0)),
        })

    own = plan.sequences + max(0, len(cuts_of_last(plan)) - 1)
    kind = f"id {held.schema['id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def place(batch):
        """Full windows, and rests that are not cut."""
        ids, crcs = batch.column(0), batch.column(2)
        tokens, first, crc, length, number, inside = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4, 5, 6, 7))
        full = pc.list_value_length(crcs).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(full)), full)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        whole = np.flatnonzero(inside)
        sequence, offset = placed(plan, length[whole], number[whole])
        return {
            "id": ids.take(pa.array(np.r_[row, whole])), "start": np.r_[nth, full[whole]] * window,
            "length": np.r_[np.full(len(row), window), length[whole]], "crc": np.r_[crcs.flatten().to_numpy(), crc[whole]],
            "tokens": tokens[np.r_[row, whole]], "sequence": np.r_[own + first[row] + nth, sequence], "offset": np.r_[np.zeros_like(row), offset],
        }

    def cut_up(batch):
        out = {k: [] for k in ("id", "start", "length", "crc", "tokens", "sequence", "offset")}
        for r in batch.to_pylist():
            at, first = 0, r["doc_tokens"] - r["length"]
            for sequence, offset, n in slots(plan, r["length"], r["nth"]):
                row = (r["id"], first + at, n, zlib.crc32(r["rest"][4 * at : 4 * (at + n)]), r["doc_tokens"], sequence, offset)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                at += n
        return out

    small = numbered(held.select("id", "doc_tokens", "crcs", "full_nth", "rest_crc", "length", "nth", "task"))
    small = small.select("id", "doc_tokens", "crcs", "full_nth", "rest_crc", "length", "nth", ((F.col("length") > 0) & ~cut).alias("inside"))
    out = map_rows(small, place, kind)
    if plan.tail_tokens:
        # numbers rise with tasks: each length's cut rests are in its last tasks
        late = counts.where((F.col("length") > 0) & (F.col("before") + F.col("n") > taken)).groupBy("length").agg(F.min("task").alias("task"))
        since = [1 << 31] * window
        for row in late.collect():  # under `window` rows
            since[row.length] = row.task
        some = held.where(F.col("task") >= F.get(F.lit(since), F.col("length")))
        rows = numbered(some.select("id", "doc_tokens", "rest", "length", "nth", "task", "full_nth")).where(cut)
        out = out.unionByName(map_rows(rows.select("id", "doc_tokens", "rest", "length", "nth"), cut_up, kind))
    return out.withColumnRenamed("id", id_col)
