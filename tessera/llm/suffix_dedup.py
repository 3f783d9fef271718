"""Suffix-array dedup: bytes of strings that also start in a document of smaller id.

1. Exact copies of whole texts are found by their SHA-256 and removed against the smallest
   id. Of the copies that a task holds, only the least goes on to the anchors, and no copy
   to the contexts.
2. Every repeated string of ``LENGTH`` bytes holds a content-defined anchor (``anchors``).
   Anchor hashes, one for each document, travel as packed byte planes by hash range;
   those of two or more documents go back to their documents. If a task holds an anchor in
   several documents, it knows that it repeats: two of them and their number tell its range,
   and the others go straight back, so a frequent anchor's documents don't meet in one task.
3. Each window of LENGTH bytes belongs to one anchor, told by its own bytes alone.
   Neighbouring windows of a repeated anchor are one context. Contexts that a task holds
   twice are settled there; the rest go to shards by anchor hash, a row each, so equal
   windows meet.
   Windows of anchors in over ``HOT`` documents (or one millionth of all anchors, if more: so
   there are never many) go one by one, by their own hash.
4. A shard sorts the suffixes that start at its windows in two stages: those smaller than
   their successor are sorted directly, the others are induced by one scan over the buckets
   of first bytes. Neighbours whose common prefix reaches LENGTH form classes; in a class,
   windows of a larger id than the least are removed.
5. Removed windows are joined to the documents by id; the documents' exchange is used for
   both joins.

Ids are integers. Defined cases: null and empty texts are empty and lose nothing; texts of
under LENGTH bytes lose nothing; repeated rows (equal id) never remove each other; a row
with a null id neither loses bytes nor removes any; if rows share an id but not a text, what
is found in one applies to all by position; an empty table gives no rows; other columns are
neither read nor returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import anchors, gram_hashes
from tessera.llm.common import arrow_schema, as_batch, binary_of, dealt, map_rows, ranges_of, release, small_batches, texts_of, written

LENGTH, GRAM = 50, 22
WINDOW = LENGTH - GRAM + 1
HOT = 20_000
#: Bytes of text that one task handles at once, and of text and contexts that it gathers
#: results of before it sends them; anchors and context bytes of a range or shard.
CHUNK, GATHER, GATHER_CONTEXTS, RANGE_ANCHORS, SHARD_BYTES = 256 << 10, 8 << 20, 1 << 20, 300_000, 512 << 10
_KEY_BITS = 40
#: More bytes than any text has.
_WHOLE = (1 << 31) - 1


def planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of 64-bit values, all first bytes, then all second ones, and
    so on; sorted or small values then compress well in the exchange."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def from_planes(raw: bytes, size: int) -> np.ndarray:
    """The inverse of ``planes``, for values that are not negative if size < 8."""
    out = np.zeros((len(raw) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T
    return out.view("<i8").ravel()


def chunks(batches):
    """(ids, bytes, ends) of documents of at least LENGTH bytes, some CHUNK bytes at a time."""
    release()
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) >= LENGTH:
                ids.append(i)
                texts.append(raw)
                size += len(raw)
            if size >= CHUNK:
                yield np.array(ids), np.frombuffer(b"".join(texts), np.uint8), np.cumsum(list(map(len, texts)))
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids), np.frombuffer(b"".join(texts), np.uint8), np.cumsum(list(map(len, texts)))


def _keys(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _KEY_BITS)).astype(np.int64)


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each anchor key. Ranges are neighbouring keys and hold equal shares of the
    anchors, of which most are small: each is the least hash of some window. A hash that a share
    1 - q of all hashes lies below is an anchor if WINDOW - 1 neighbours in a row are larger, with
    probability q^(WINDOW - 1) (1 + (WINDOW - 1) (1 - q)); this is summed up. Products only: machines
    must agree on each bit."""
    q = 1.0 - keys / 2.0**_KEY_BITS
    power, square, rest = 1.0, q, WINDOW
    while rest:
        if rest & 1:
            power = power * square
        square, rest = square * square, rest >> 1
    below = 1.0 - power * ((WINDOW + 1) / 2 - (WINDOW - 1) / 2 * q)
    return np.clip((below * ranges).astype(np.int64), 0, ranges - 1)


def _split(part: np.ndarray, parts: int):
    """(part, rows) for each part that has rows, keeping their order."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]


def _lists(ids: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """One row an id, with the list of its values."""
    order = np.argsort(ids, kind="stable")
    own, first = np.unique(ids[order], return_index=True)
    offsets = pa.array(np.r_[first, len(ids)], pa.int32())
    return [pa.array(own), *(pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in values)]


def _send_anchors(batches, ranges: int):
    """Rows (back, part, keys, ids, counts). For ranges of anchors (not ``back``): keys, ids
    and how many documents each stands for. Straight back to parts of documents: keys, ids."""
    kinds = arrow_schema(_ANCHORS)
    keys, owned, size = [], [], 0
    copies: dict[bytes, int] = {}

    def flush():
        key, own = np.concatenate(keys), np.concatenate(owned)
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        nth = np.arange(len(key)) - np.repeat(first, n)
        count = np.where(nth == 0, 1, np.repeat(n, n) - 1)
        out = {f.name: [] for f in kinds}
        told, back = np.flatnonzero(nth < 2), np.flatnonzero(nth >= 2)
        for part, rows in _split(_ranges(key[told], ranges), ranges):
            rows = told[rows]
            _append(out, False, part, planes(key[rows], 5), planes(own[rows], 8), planes(count[rows], 3))
        for part, rows in _split(_part(own[back], ranges), ranges):
            rows = back[rows]
            _append(out, True, part, planes(key[rows], 5), planes(own[rows], 8), None)
        return as_batch(out, kinds)

    for ids, data, ends in chunks(batches):
        least = []
        for i, start, end in zip(ids.tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            seen = copies.setdefault(hashlib.blake2b(data[start:end], digest_size=16).digest(), i)
            least.append(i <= seen)
        hashes = gram_hashes(data, GRAM)
        at = anchors(hashes, WINDOW)
        doc = np.searchsorted(ends, at, "right")
        inside = (at + GRAM <= ends[doc]) & np.array(least)[doc]
        both = np.unique(_keys(hashes[at[inside]]) << 23 | doc[inside])  # under 2^23 documents a chunk
        keys.append(both >> 23)
        owned.append(ids[both & ((1 << 23) - 1)])
        size += len(data)
        if size >= GATHER:
            yield flush()
            keys, owned, size = [], [], 0
    if keys:
        yield flush()


_ANCHORS = "back boolean, part int, keys binary, ids binary, counts binary"
_REPEATED = "part int, keys binary, ids binary"


def _append(out: dict, *row) -> None:
    for column, value in zip(out.values(), row, strict=True):
        column.append(value)


def _repeated(table: pa.Table, ranges: int, hot: int) -> pa.Table:
    """Of a range, the anchors of two or more documents, by part of the documents. Part -1
    holds those of over ``hot`` documents."""
    kinds = arrow_schema(_REPEATED)
    if table.column("back")[0].as_py():
        return table.select(kinds.names)
    read = lambda c, size: np.concatenate([from_planes(b, size) for b in table.column(c).to_pylist()])
    key, ids, count = read("keys", 5), read("ids", 8), read("counts", 3)
    order = np.lexsort((-count, ids, key))
    key, ids, count = key[order], ids[order], count[order]
    again = np.r_[False, (key[1:] == key[:-1]) & (ids[1:] == ids[:-1])]
    key, ids, count = key[~again], ids[~again], count[~again]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    docs = np.repeat(np.add.reduceat(count, first) if len(first) else first, np.diff(np.r_[first, len(key)]))
    out = {f.name: [] for f in kinds}
    often = np.unique(key[docs > hot])
    if len(often):
        _append(out, -1, planes(often, 5), b"")
    key, ids = key[docs > 1], ids[docs > 1]
    for part, own in _split(_part(ids, ranges), ranges):
        _append(out, part, planes(key[own], 5), planes(ids[own], 8))
    return pa.table({n: pa.array(v, f.type) for (n, v), f in zip(out.items(), kinds, strict=True)})


def _by_document(table: pa.Table) -> pa.Table:
    """(id, keys) of a part of the documents; part -1 becomes one row without an id."""
    read = lambda c, size: np.concatenate([from_planes(b, size) for b in table.column(c).to_pylist()])
    key, kinds = read("keys", 5), arrow_schema("id bigint, keys array<bigint>")
    if table.column("part")[0].as_py() < 0:
        return pa.table({"id": [None], "keys": [key]}, schema=kinds)
    return pa.table(_lists(read("ids", 8), key), schema=kinds)


def repeated_anchors(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """Written (id, keys), the anchor keys of each document that another one has too, and the
    keys of over HOT documents (at most a million; each has over a millionth of all)."""
    small_batches(rows.sparkSession)
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, int(size * 2 / (WINDOW + 1) / RANGE_ANCHORS))
    hot = max(HOT, size // 1_000_000)  # a text has fewer anchors than bytes
    sent = dealt(rows.mapInArrow(lambda b: _send_anchors(b, ranges), _ANCHORS), 2 * ranges // 32, "back", "part")
    met = dealt(sent.applyInArrow(lambda t: _repeated(t, ranges, hot), _REPEATED), ranges // 16, "part")
    found = written(met.applyInArrow(_by_document, "id bigint, keys array<bigint>"), "anchors")
    often = [k for r in found.where("id is null").toLocalIterator() for k in r.keys]
    return found.where("id is not null"), often


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    """A part number for each document or key, whichever values are frequent."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return (mixed % np.uint64(parts)).astype(np.int64)


def owners(hashes: np.ndarray) -> np.ndarray:
    """For each window start, the rightmost place of the least hash in the window."""
    place = np.arange(len(hashes), dtype=np.int32)
    value, length = hashes, 1

    def better(left, right, a, b):
        take = b <= a
        return np.where(take, right, left), np.where(take, b, a)

    while 2 * length <= WINDOW:
        place, value = better(place[:-length], place[length:], value[:-length], value[length:])
        length *= 2
    if extra := WINDOW - length:
        place, value = better(place[:-extra], place[extra:], value[:-extra], value[extra:])
    return place


def contexts(data: np.ndarray, ends: np.ndarray, known: list[np.ndarray], hot: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(document, start, windows, key) of the contexts of repeated anchors in a chunk, and
    the hash of LENGTH bytes at each start. ``known`` and ``hot`` are sorted keys by document."""
    hashes = gram_hashes(data, GRAM)
    whole = gram_hashes(data, LENGTH)
    owner = owners(hashes)[: len(whole)]
    starts = np.arange(len(whole))
    doc = np.searchsorted(ends, starts, "right")
    inside = starts + LENGTH <= ends[doc]
    starts, doc, owner = starts[inside], doc[inside], owner[inside]
    key = _keys(hashes[owner])
    tagged = lambda lists: np.concatenate([np.zeros(0, np.int64), *(k | i << _KEY_BITS for i, k in enumerate(lists))])
    # a chunk has under 2^23 documents, so document and key fit 63 bits
    wanted = doc.astype(np.int64) << _KEY_BITS | key
    single = _isin_sorted(wanted, tagged(hot))
    good = single | _isin_sorted(wanted, tagged(known))
    starts, doc, owner, key, single = (x[good] for x in (starts, doc, owner, key, single))
    if not len(starts):
        return doc, starts, starts, key, whole
    new = np.r_[True, (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1]) | single[1:]]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(starts)])
    spread = np.where(single[first], _keys(whole[starts[first]]), key[first])
    return doc[first], starts[first], n, spread, whole


def _isin_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


#: A row a context, with all its starts in that document (four bytes each), so that rows grow
#: with the contexts, and not with tasks times shards. A document's settled windows are one
#: row without text, of pairs of start and stop.
_SENT = "shard int, id bigint, text binary, starts binary"


def _send_contexts(batches, shards: int, hot):
    kinds, hot = arrow_schema(_SENT), np.sort(np.array(hot.value, dtype=np.int64))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    past: set[int] = set()

    def known_of(batch):
        for i in past:  # of earlier batches
            held.pop(i, None)
        past.clear()
        batch = batch.filter(pc.is_valid(batch.column(2)))
        for i, keys in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            k = np.unique(np.array(keys, dtype=np.int64))
            often = _isin_sorted(k, hot)
            held[i] = k[~often], k[often]
        return batch

    gathered: list[tuple[np.ndarray, ...]] = []
    texts: list[np.ndarray] = []

    def flush():
        n, own, place, spread, head, tail = (np.concatenate(c) for c in zip(*gathered, strict=True))
        text = np.concatenate(texts)
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        # equal contexts: the least id's go on, larger ids' are settled here
        order = np.lexsort((own, tail, head, n))
        a, b, c = n[order], head[order], tail[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]
        least = own[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        kept = order[own[order] == least]  # rows of one context are neighbours, all of one id
        first = np.flatnonzero(new[own[order] == least])
        times = np.diff(np.r_[first, len(kept)])
        line = np.argsort(kept[first])  # as they stand in the texts: neighbours have like ids and starts
        first, times = first[line], times[line]
        sent, settled = kept[first], order[own[order] > least]
        size = n[sent] + LENGTH - 1
        where, places = text[ranges_of(begin[sent], size)], place[kept[ranges_of(first, times)]]
        told, some, start, stop = _merged(own[settled], place[settled], place[settled] + n[settled] + LENGTH - 1)
        out = (
            np.r_[_part(spread[sent], shards), told % shards],
            np.r_[own[sent], told],
            binary_of(where, np.r_[size, np.zeros(len(told), np.int64)]),
            binary_of(np.r_[places, np.column_stack([start, stop]).ravel()].astype("<i4"), 4 * np.r_[times, 2 * some]),
        )
        gathered.clear()
        texts.clear()
        return as_batch(dict(zip(kinds.names, map(pa.array, out), strict=True)), kinds)

    size = 0
    for ids, data, ends in chunks(map(known_of, batches)):
        doc, start, n, spread, whole = contexts(data, ends, [held[i][0] for i in ids.tolist()], [held[i][1] for i in ids.tolist()])
        past.update(ids.tolist())
        if len(start):
            texts.append(data[ranges_of(start, n + LENGTH - 1)])
            begin = np.r_[0, ends[:-1]]
            gathered.append((n, ids[doc], start - begin[doc], spread, whole[start], whole[start + n - 1]))
            size += len(texts[-1])
        if size >= GATHER_CONTEXTS:
            yield flush()
            size = 0
    if gathered:
        yield flush()


def _merged(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each id, how many spans its own ones make where those that meet are one, and all these
    spans' starts and stops."""
    order = np.lexsort((starts, ids))
    own, rank = np.unique(ids[order], return_inverse=True)
    base = rank << 32  # more than any place
    start, until = base + starts[order], np.maximum.accumulate(base + stops[order])
    first = np.flatnonzero(np.r_[True, start[1:] > until[:-1]][: len(ids)])
    last = np.r_[first[1:], len(ids)][: len(first)] - 1
    return own, np.bincount(rank[first], minlength=len(own)), (start - base)[first], (until - base)[last]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of binary values without nulls, end to end, and the size of each."""
    whole = pa.concat_arrays(column.chunks)
    sizes = pc.binary_length(whole).to_numpy().astype(np.int64)
    begin = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset] if len(whole) else 0
    data = whole.buffers()[2]
    return np.frombuffer(data or b"", np.uint8)[begin : begin + sizes.sum()], sizes


def suffix_order(text: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The wanted suffixes of ``text`` in order of their first ``depth`` bytes, by two-stage
    sorting. ``text`` is strings laid end to end, ``ends`` the end of each (sorted); a suffix
    ends with its string. ``wanted`` are sorted starts.

    Stage one sorts the suffixes smaller than their successors directly. The others begin
    with a byte no smaller than the next, so one scan over the buckets of first bytes, from
    small to large, meets each after its successor and appends it to its bucket.
    """
    n = len(text)
    last = np.zeros(n, dtype=bool)
    last[ends - 1] = True
    # type: smaller than the successor, looking past equal bytes
    differs = np.r_[text[1:] != text[:-1], True] | last
    decide = np.flatnonzero(differs)
    turn = decide[np.searchsorted(decide, np.arange(n))]  # the first place that decides
    smaller = ~last[turn] & (np.r_[text[1:], 0][turn] > text[turn])
    # the others need their successors, up to the first suffix of the smaller kind
    needed = np.zeros(n, dtype=bool)
    needed[wanted] = True
    now = wanted[~smaller[wanted]]
    while len(now):
        now = now[~last[now]] + 1
        now = now[~needed[now]]
        needed[now] = True
        now = now[~smaller[now]]
    direct = np.flatnonzero(needed & smaller)
    direct = direct[np.lexsort(_words(text, direct, depth)[::-1])]
    by_byte = dict(_split(text[direct].astype(np.int64), 256))
    grown: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(successors: np.ndarray, at: int, run: bool) -> None:
        """Append the predecessors of ``successors`` (of bucket ``at``) to their buckets."""
        before = successors - 1
        ok = (before >= 0) & ~last[before] & needed[before] & ~smaller[before]
        before = before[ok]
        for c, rows in _split(text[before].astype(np.int64), 256):
            if c > at or run:
                grown[c].append(before[rows])

    # suffixes that end with their string come first in their bucket
    for c, rows in _split(text[tail := np.flatnonzero(needed & ~smaller & last)].astype(np.int64), 256):
        grown[c].append(tail[rows])
    out = []
    for c in range(256):
        done = 0
        while done < len(grown[c]):  # runs of one byte grow the bucket that is being scanned
            some = np.concatenate(grown[c][done:])
            done = len(grown[c])
            out.append(some)
            induce(some, c, True)
        if c in by_byte:
            some = direct[by_byte[c]]
            out.append(some)
            induce(some, c, False)
    order = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    mark = np.zeros(n, dtype=bool)
    mark[wanted] = True
    return order[mark[order]]


def _words(text: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The bytes at each start as big-endian words, zeros beyond the text; the last word
    overlaps the one before so that ``depth`` bytes are covered."""
    padded = np.concatenate([text, np.zeros(8 + depth, dtype=np.uint8)])
    view = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    offsets = [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]
    return [view[at + o].astype(np.uint64) for o in offsets]


def repeats_in_shard(text: np.ndarray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows repeat one of a smaller id. Context i has n[i] windows and n[i] +
    LENGTH - 1 bytes; windows are numbered context by context."""
    ends = np.cumsum(n + LENGTH - 1)
    context = np.repeat(np.arange(len(n)), n)
    wanted = np.arange(len(context)) + context * (LENGTH - 1)
    order = suffix_order(text, ends, wanted)
    number = np.zeros(len(text), dtype=np.int64)
    number[wanted] = np.arange(len(wanted))
    window = number[order]
    words = _words(text, order, LENGTH)
    long_prefix = np.logical_and.reduce([w[1:] == w[:-1] for w in words])  # common prefix of LENGTH
    first = np.r_[True, ~long_prefix]
    own = ids[context[window]]
    least = np.minimum.reduceat(own, np.flatnonzero(first))[np.cumsum(first) - 1]
    out = np.zeros(len(context), dtype=bool)
    out[window] = own > least
    return out


_SPANS = "part int, id bigint, start bigint, stop bigint"


def _settle(table: pa.Table, parts: int) -> pa.Table:
    """Removed windows of a shard, a row a run of them, by part of their documents."""
    release()
    ids = table.column("id").to_numpy()
    (text, size), (places, each) = _flat(table.column("text")), _flat(table.column("starts"))
    at, times = places.view("<i4").astype(np.int64), each // 4
    told = size == 0
    pairs = at[np.repeat(told, times)].reshape(-1, 2)
    spans = [(np.repeat(ids[told], times[told] // 2), pairs[:, 0], pairs[:, 1])]
    own, n, at, times = ids[~told], size[~told] - (LENGTH - 1), at[np.repeat(~told, times)], times[~told]
    if len(n):
        gone = np.flatnonzero(repeats_in_shard(text, n, own))
        context = np.repeat(np.arange(len(n)), n)[gone]
        place = gone - (np.cumsum(n) - n)[context]
        if len(gone):
            new = np.flatnonzero(np.r_[True, (gone[1:] != gone[:-1] + 1) | (context[1:] != context[:-1])])
            until = np.r_[new[1:], len(gone)] - 1
            c = context[new]  # each run of windows, at each start of its context
            begin = at[ranges_of((np.cumsum(times) - times)[c], times[c])]
            spans.append((np.repeat(own[c], times[c]), begin + np.repeat(place[new], times[c]), begin + np.repeat(place[until] + LENGTH, times[c])))
    own, start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
    out = (_part(own, parts).astype(np.int32), own, start, stop)
    return pa.table(list(map(pa.array, out)), schema=arrow_schema(_SPANS))


def _unpack(table: pa.Table) -> pa.Table:
    """One row a document, with all its removed windows."""
    cols = _lists(*(table.column(c).to_numpy() for c in ("id", "start", "stop")))
    return pa.table(cols, schema=arrow_schema("id bigint, starts array<bigint>, stops array<bigint>"))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, text) of all documents, with ``rest`` also a struct of all other columns, and
    (id, starts, stops) of removed windows (one row an id, unsorted and overlapping)."""
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if rest else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *others)
    real = rows.where("id is not null and octet_length(text) >= %d" % LENGTH)
    marks = written(real.select("id", F.unhex(F.sha2("text", 256)).alias("sha")).distinct(), "marks")
    firsts = marks.groupBy("sha").agg(F.min("id").alias("id"))
    copies = written(marks.join(firsts, ["id", "sha"], "left_anti").select("id").distinct(), "copies")
    found, often = repeated_anchors(real)
    hot = rows.sparkSession.sparkContext.broadcast(often)
    lists = found.join(copies, "id", "left_anti")
    total = found.select(F.sum(F.size("keys"))).first()[0] or 0
    shards = max(16, int(total * (LENGTH + WINDOW // 2) / SHARD_BYTES))
    parts = max(16, total // 500_000)
    # a left join like the one with the spans below, so that both read one exchange of the texts
    # (so the rest goes along, unread)
    sent = rows.join(lists, "id", "left").select("id", "text", "keys", *rows.columns[2:]).mapInArrow(lambda b: _send_contexts(b, shards, hot), _SENT)
    packed = dealt(sent, shards // 128, "shard").applyInArrow(lambda t: _settle(t, parts), _SPANS)
    spans = dealt(packed, parts // 16, "part").applyInArrow(_unpack, "id bigint, starts array<bigint>, stops array<bigint>")
    whole = copies.select("id", F.array(F.lit(0).cast("bigint")).alias("starts"), F.array(F.lit(_WHOLE).cast("bigint")).alias("stops"))
    return rows, spans.unionByName(whole)


def removed_mask(size: int, starts, stops) -> np.ndarray:
    edge = np.zeros(size + 1, dtype=np.int64)
    if starts and size >= LENGTH:
        np.add.at(edge, np.minimum(starts, size), 1)
        np.add.at(edge, np.minimum(stops, size), -1)
    return np.cumsum(edge)[:size] > 0


def _each(batch: pa.RecordBatch):
    """Raw bytes and removed mask of each row of (.., text, starts, stops)."""
    lists = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("starts", "stops"))
    for text, starts, stops in zip(texts_of(batch), *lists, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        yield raw, removed_mask(len(raw), starts, stops)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    rows, spans = removed_spans(docs, id_col, text_col)

    def run(batch):
        out = {"id": batch.column(0), "n": [], "gone": [], "spans": [], "sha": []}
        for raw, mask in _each(batch):
            out["n"].append(len(raw))
            out["gone"].append(int(mask.sum()))
            out["spans"].append(int((np.diff(np.r_[0, mask.view(np.int8)]) == 1).sum()))
            kept = np.frombuffer(raw, np.uint8)[~mask].tobytes() if out["gone"][-1] else raw
            out["sha"].append(hashlib.sha256(kept).hexdigest())
        return out

    joined = rows.join(spans, "id", "left").select("id", "text", "starts", "stops")
    out = map_rows(joined, run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed bytes gone from the text; a character cut by a removal goes
    too. All other columns stay."""
    rows, spans = removed_spans(docs, id_col, text_col, rest=True)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            kept = [t if not m.any() else np.frombuffer(raw, np.uint8)[~m].tobytes().decode("utf-8", "ignore") for t, (raw, m) in zip(texts, _each(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column(1)], names=["text", "rest"])

    joined = rows.join(spans, "id", "left").select("text", "rest", "starts", "stops")
    out = joined.mapInArrow(run, joined.select("text", "rest").schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
