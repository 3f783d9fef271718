"""Line dedup over an index that takes documents in and out again.

A line's key is the line without white space at both ends, A-Z lower-cased; keys of at least
LEAST code points count. A line whose key more than one document holds stays in the document of
the smallest id alone.

1. Documents are packed by Arrow batch: line by line the number of its key among the batch's
   distinct keys, written once (``batches``). Each batch tells a key's shard how many of its
   documents hold the key and their least and largest id, so a key that all documents hold
   sends a few numbers a batch.
2. A shard has a cuckoo filter of all its keys and an exact reference-count table, one entry a
   key and batch. Keys that the filter hasn't seen are new and need no comparison; those that
   it may have seen are confirmed in the table, where false hits are told apart. What two
   documents hold is marked.
3. Marked keys go back to their batches with the least id, each batch tells its documents which
   lines go, and these meet the texts in one join.
4. Taking documents out lowers the counts of their batches' entries; an entry without documents
   goes, and a key without entries leaves the filter. Nothing tells whether a document was ever
   in: the lines it displaced come back.

Defined cases: a null or empty text is one empty line; a null id counts as the largest id;
rows of one id are one document, so a key that only they hold stays in all of them; repeated
rows lose the same lines; an empty table gives no rows; other columns are neither read nor
returned. Ids are integers.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import cuckoo
from tessera.llm.common import arrow_schema, as_batch, dealt, map_rows, ranges_of, release, slices, small_batches, texts_of, written

LEAST = 10
BLANK = " \t\n\x0b\x0c\r"
#: Entries that one shard should hold on average; keys looked up at once; bytes of text of a batch.
SHARD_ENTRIES, LOOKED_UP, BATCH_BYTES = 400_000, 1 << 16, 8 << 20
#: What a null id counts as.
NO_ID = (1 << 63) - 1

_BATCH = "batch bigint, entries bigint, ids binary, hashes binary, lines binary, places binary, keys binary"
_MESSAGE = "shard int, batch bigint, at binary, keys binary, n binary, low binary, high binary"
_STATE = "shard int, filter binary, keys binary, batch binary, at binary, n binary, low binary, high binary, marked binary"
_KEY = np.dtype([("hash", "<i8"), ("rest", "<i8")])
_ENTRY = {"keys": _KEY, "batch": np.int64, "at": np.int32, "n": np.int32, "low": np.int64, "high": np.int64, "marked": np.bool_}


def line_keys(text: str, least: int = LEAST) -> list[bytes | None]:
    """The key of each line, None for short ones."""
    stripped = (line.strip(BLANK) for line in text.split("\n"))
    return [s.encode("utf-8", "surrogatepass").lower() if len(s) >= least else None for s in stripped]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _batches(rows: DataFrame, least: int) -> DataFrame:
    """Written batches of packed documents."""
    small_batches(rows.sparkSession)
    kinds = arrow_schema(_BATCH)

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        lines, places = [], []
        for text in texts_of(batch):
            keys = line_keys(text, least)
            lines.append(len(keys))
            places.extend(-1 if k is None else known.setdefault(xxhash.xxh3_128_digest(k), len(known)) for k in keys)
        out = {
            "batch": [uuid.uuid4().int >> 66], "entries": [len(known)],
            "ids": [batch.column(0).to_numpy().tobytes()], "hashes": [batch.column(1).to_numpy().tobytes()],
            "lines": [np.array(lines, np.int32).tobytes()], "places": [np.array(places, np.int32).tobytes()], "keys": [b"".join(known)],
        }
        return as_batch(out, kinds)

    def run(batches):
        release()
        for batch in batches:
            for at, end in slices(batch.column(2), BATCH_BYTES) if batch.num_rows else ():
                yield packed(batch.slice(at, end - at))

    return written(rows.mapInArrow(run, _BATCH), "batches")


@dataclass
class _Packed:
    """Arrays of one batch: documents, and (document, key) pairs, each once."""

    ids: np.ndarray
    hashes: np.ndarray
    lines: np.ndarray
    places: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Packed:
        kinds = (np.int64, np.int64, np.int32, np.int32, _KEY)
        return cls(*(np.frombuffer(row[c], k) for c, k in zip(("ids", "hashes", "lines", "places", "keys"), kinds, strict=True)))

    def held(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, documents, least id, largest id) of the keys that some of ``docs`` hold."""
        starts = np.cumsum(self.lines, dtype=np.int64) - self.lines
        doc = np.repeat(docs, self.lines[docs])
        key = self.places[ranges_of(starts[docs], self.lines[docs].astype(np.int64))]
        pair = np.unique(np.stack([key, doc], 1)[key >= 0], axis=0)
        key, own = pair[:, 0], self.ids[pair[:, 1]]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        return key[first], np.diff(np.r_[first, len(key)]), np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys["rest"].view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _message(out: dict, batch: int, keys: np.ndarray, at, n, low, high, shards: int) -> None:
    """Add a batch's counts, by shard."""
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        own = order[edges[s] : edges[s + 1]]
        values = (int(s), batch, at[own].astype(np.int32).tobytes(), keys[own].tobytes(), n[own].astype(np.int32).tobytes(), low[own].tobytes(), high[own].tobytes())
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)


def _counts(batches: DataFrame, shards: int) -> DataFrame:
    """Messages with all counts of ``batches``."""

    def run(rows: pa.RecordBatch):
        out = {f.name: [] for f in arrow_schema(_MESSAGE)}
        for row in rows.to_pylist():
            packed = _Packed.of(row)
            key, n, low, high = packed.held(np.arange(len(packed.ids)))
            _message(out, row["batch"], packed.keys[key], key, n, low, high, shards)
        return out

    return map_rows(batches, run, _MESSAGE)


def _entries(table: pa.Table) -> dict[str, np.ndarray]:
    """Entries of messages, end to end."""
    column = lambda c: [np.frombuffer(b, _ENTRY[c]) for b in table.column(c).to_pylist()]
    out = {c: np.concatenate([np.zeros(0, _ENTRY[c]), *column(c)]) for c in ("keys", "at", "n", "low", "high")}
    sizes = [len(b) // 4 for b in table.column("at").to_pylist()]
    return out | {"batch": np.repeat(table.column("batch").to_numpy().astype(np.int64), sizes), "marked": np.zeros(len(out["at"]), np.bool_)}


def _state_of(table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A shard's filter and its entries; both empty where the shard is new."""
    if not table.num_rows:
        return cuckoo.empty(0), {c: np.zeros(0, k) for c, k in _ENTRY.items()}
    row = table.to_pylist()[0]
    return np.frombuffer(row["filter"], np.uint16).reshape(-1, cuckoo.SLOTS).copy(), {c: np.frombuffer(row[c], k).copy() for c, k in _ENTRY.items()}


def _state_row(shard: int, table: np.ndarray, entries: dict[str, np.ndarray]) -> pa.Table:
    row = {"shard": [shard], "filter": [table.tobytes()]} | {c: [entries[c].tobytes()] for c in _ENTRY}
    return pa.table({f.name: pa.array(row[f.name], f.type) for f in arrow_schema(_STATE)})


def _confirmed(entries: dict[str, np.ndarray]) -> None:
    """Keep the marks of keys that more than one document holds, told by the whole key."""
    some = np.flatnonzero(entries["marked"])
    keys = entries["keys"][some]
    order = np.lexsort((keys["rest"], keys["hash"]))
    some, keys = some[order], keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if len(first):
        low, high = np.minimum.reduceat(entries["low"][some], first), np.maximum.reduceat(entries["high"][some], first)
        entries["marked"][some] = np.repeat(low != high, np.diff(np.r_[first, len(keys)]))


def _absorbed(shard: int, state: pa.Table, messages: pa.Table) -> pa.Table:
    """A shard with the counts of new batches."""
    table, old = _state_of(state)
    new = _entries(messages)
    hashes = new["keys"]["hash"]
    if cuckoo.SLOTS * len(table) * cuckoo.LOAD < len(old["n"]) + len(hashes):
        table = _grown(old, len(hashes))
    maybe, fresh, room = [new["keys"]["hash"][new["low"] != new["high"]]], [], True
    for at in range(0, len(hashes), LOOKED_UP):
        some, times = np.unique(hashes[at : at + LOOKED_UP], return_counts=True)
        seen = cuckoo.contains(table, some)
        maybe += [some[seen], some[times > 1]]
        fresh.append(some[~seen])
        room = room and cuckoo.insert(table, fresh[-1])
    own = np.unique(np.concatenate([np.zeros(0, np.int64), *maybe]))
    # a filter's false hit is a key that neither the table nor this turn has had
    there = np.concatenate([old["keys"]["hash"], *fresh]) if fresh else old["keys"]["hash"]
    room = room and cuckoo.insert(table, own[~np.isin(own, there)])
    old["marked"] |= np.isin(old["keys"]["hash"], own)
    new["marked"] |= np.isin(hashes, own)
    both = {c: np.concatenate([old[c], new[c]]) for c in _ENTRY}
    _confirmed(both)
    return _state_row(shard, table if room else cuckoo.of(np.unique(both["keys"]["hash"])), both)


def _grown(old: dict[str, np.ndarray], more: int) -> np.ndarray:
    """A filter with the old keys and room for ``more``."""
    known = np.unique(old["keys"]["hash"])
    out = cuckoo.empty(len(known) + more)
    return out if cuckoo.insert(out, known) else cuckoo.of(known)


def _released(shard: int, state: pa.Table, messages: pa.Table) -> pa.Table:
    """A shard with changed counts of some entries; those without documents go."""
    table, own = _state_of(state)
    new = _entries(messages)
    named = lambda e, rows: e["batch"][rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + e["at"][rows].astype(np.uint64)
    touched = np.flatnonzero(np.isin(own["batch"], np.unique(new["batch"])))
    order = touched[np.argsort(named(own, touched), kind="stable")]
    where = order[np.searchsorted(named(own, order), named(new, slice(None)))]
    assert (own["keys"][where] == new["keys"]).all()
    for c in ("n", "low", "high"):
        own[c][where] = new[c]
    gone = own["n"] == 0
    left = {c: own[c][~gone] for c in _ENTRY}
    out = np.unique(own["keys"]["hash"][gone])
    cuckoo.delete(table, out[~np.isin(out, left["keys"]["hash"])])
    _confirmed(left)
    return _state_row(shard, table, left)


def _answers(batch: pa.RecordBatch) -> dict:
    """For each batch, its marked keys and the least id that holds each."""
    out = {"batch": [], "at": [], "low": []}
    for i in range(batch.num_rows):
        _, entries = _state_of(pa.Table.from_batches([batch.slice(i, 1)]))
        own = {c: entries[c][entries["marked"]] for c in ("keys", "batch", "at", "low")}
        _, group = np.unique(own["keys"], return_inverse=True)
        least = np.full(group.max(initial=-1) + 1, NO_ID, np.int64)
        np.minimum.at(least, group, own["low"])
        order = np.argsort(own["batch"], kind="stable")
        for name, rows in zip(*_by(own["batch"][order], order), strict=True):
            for column, value in zip(out.values(), (name, own["at"][rows].tobytes(), least[group[rows]].tobytes()), strict=True):
                column.append(value)
    return out


def _dropped(batches: pa.Table, answers: pa.Table) -> pa.Table:
    """(id, hash, dropped): the documents of a batch that lose lines, with the lines' numbers."""
    kinds = arrow_schema("id bigint, hash bigint, dropped binary")
    out = {f.name: [] for f in kinds}
    for row in batches.to_pylist():
        packed = _Packed.of(row)
        least = np.full(len(packed.keys) + 1, NO_ID, np.int64)  # the last is for short lines
        for at, low in zip(answers.column("at").to_pylist(), answers.column("low").to_pylist(), strict=True):
            least[np.frombuffer(at, np.int32)] = np.frombuffer(low, np.int64)
        doc = np.repeat(np.arange(len(packed.ids)), packed.lines)
        gone = np.flatnonzero(least[packed.places] < packed.ids[doc])
        starts = np.cumsum(packed.lines, dtype=np.int64) - packed.lines
        for d, lines in zip(*_by(doc[gone], gone), strict=True):
            for column, value in zip(out.values(), (packed.ids[d], packed.hashes[d], (lines - starts[d]).astype(np.int32).tobytes()), strict=True):
                column.append(value)
    return pa.table(out, schema=kinds)


def _by(group: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Values of each group; ``group`` ascends."""
    if not len(group):
        return [], []
    names, first = np.unique(group, return_index=True)
    return names.tolist(), np.split(values, first[1:])


@dataclass
class LineIndex:
    """Documents as packed batches, and shards of filters and counts. Both are written tables;
    taking documents in or out gives a new index."""

    batches: DataFrame
    state: DataFrame
    shards: int
    least: int = LEAST

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> LineIndex:
        return cls._of(_batches(_rows(docs, id_col, text_col), least), least)

    @classmethod
    def _of(cls, batches: DataFrame, least: int) -> LineIndex:
        shards = max(16, (batches.agg(F.sum("entries")).first()[0] or 0) // SHARD_ENTRIES)
        none = pa.table({f.name: pa.array([], f.type) for f in arrow_schema(_STATE)})
        built = dealt(_counts(batches, shards), shards // 4, "shard").applyInArrow(lambda key, t: _absorbed(key[0].as_py(), none, t), _STATE)
        return cls(batches, written(built, "shards"), shards, least)

    def _turned(self, messages: DataFrame, turn) -> DataFrame:
        """Written shards after a turn over those that ``messages`` name."""
        messages = written(messages, "messages")
        named = messages.select("shard").distinct()
        both = self.state.join(named, "shard", "left_semi").groupBy("shard").cogroup(messages.groupBy("shard"))
        changed = both.applyInArrow(lambda key, state, sent: turn(key[0].as_py(), state, sent), _STATE)
        return written(changed.unionByName(self.state.join(named, "shard", "left_anti")), "shards")

    def inserted(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """With more documents; shards that get too large are dealt anew."""
        more = _batches(_rows(docs, id_col, text_col), self.least)
        both = written(self.batches.unionByName(more), "batches")
        if (both.agg(F.sum("entries")).first()[0] or 0) // SHARD_ENTRIES > 2 * self.shards:
            return self._of(both, self.least)
        return LineIndex(both, self._turned(_counts(more, self.shards), _absorbed), self.shards, self.least)

    def deleted(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without all documents of some ids; ids that are not in change nothing."""
        gone = ids.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("id")).distinct()

        def held(rows: pa.RecordBatch):
            out = {"batch": [], "id": []}
            for row in rows.to_pylist():
                own = np.unique(np.frombuffer(row["ids"], np.int64)).tolist()
                out["batch"] += [row["batch"]] * len(own)
                out["id"] += own
            return out

        # only ids travel: which batches hold them
        found = map_rows(self.batches.select("batch", "ids"), held, "batch bigint, id bigint").join(gone, "id")
        lists = written(found.groupBy("batch").agg(F.collect_list("id").alias("out")), "out")
        shards, kinds = self.shards, arrow_schema(_BATCH)
        touched = written(self.batches.join(lists, "batch"), "touched")

        def recounted(rows: pa.RecordBatch):
            out = {f.name: [] for f in arrow_schema(_MESSAGE)}
            for row in rows.to_pylist():
                packed = _Packed.of(row)
                lost = np.isin(packed.ids, np.array(row["out"], np.int64))
                changed, *_ = packed.held(np.flatnonzero(lost))
                key, n, low, high = packed.held(np.flatnonzero(~lost))
                full = [np.zeros(len(packed.keys), np.int64) for _ in range(3)]
                for column, value in zip(full, (n, low, high), strict=True):
                    column[key] = value
                _message(out, row["batch"], packed.keys[changed], changed, *[c[changed] for c in full], shards)
            return out

        def kept(rows: pa.RecordBatch):
            out = {f.name: [] for f in kinds}
            for row in rows.to_pylist():
                packed = _Packed.of(row)
                stay = ~np.isin(packed.ids, np.array(row["out"], np.int64))
                places = packed.places[np.repeat(stay, packed.lines)]
                values = (row["batch"], row["entries"], packed.ids[stay].tobytes(), packed.hashes[stay].tobytes(), packed.lines[stay].tobytes(), places.tobytes(), row["keys"])
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            return out

        state = self._turned(map_rows(touched, recounted, _MESSAGE), _released)
        rest = self.batches.join(lists.select("batch"), "batch", "left_anti")
        return LineIndex(written(map_rows(touched, kept, _BATCH).unionByName(rest), "batches"), state, self.shards, self.least)

    def drops(self) -> DataFrame:
        """(id, hash, dropped): which lines each document loses; ``hash`` is that of its text."""
        answers = map_rows(self.state, _answers, "batch bigint, at binary, low binary")
        both = self.batches.groupBy("batch").cogroup(answers.groupBy("batch"))
        found = both.applyInArrow(_dropped, "id bigint, hash bigint, dropped binary")
        return found.groupBy("id", "hash").agg(F.first("dropped").alias("dropped"))

    def report(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_lines, n_dropped, kept_sha256) of documents that are in."""

        def run(batch: pa.RecordBatch):
            out = {"id": batch.column(0), "n": [], "gone": [], "sha": []}
            for text, dropped in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, kept, gone = text.count("\n") + 1, text, 0
                if dropped:
                    kept, gone = without_lines(text, dropped)
                for column, value in zip(list(out.values())[1:], (lines, gone, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()), strict=True):
                    column.append(value)
            return out

        met = _rows(docs, id_col, text_col).join(self.drops(), ["id", "hash"], "left").select("id", "text", "dropped")
        out = map_rows(met, run, "id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
        return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_lines", "n_dropped", "kept_sha256")

    def applied(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs``, all columns, without the lines that go; null texts stay null."""
        text = F.col(f"`{text_col}`")
        key = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID))
        rows = docs.select(F.struct("*").alias("row"), key.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), text.alias("text"))
        met = rows.join(self.drops(), ["id", "hash"], "left").select("row", "text", "dropped")

        def run(batches):
            for batch in batches:
                texts = [t if not d else without_lines(t, d)[0] for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

        out = met.mapInArrow(run, met.select("row", "text").schema)
        return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without_lines(text: str, dropped: bytes) -> tuple[str, int]:
    gone = set(np.frombuffer(dropped, np.int32).tolist())
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone), len(gone)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every row, after all rows were taken in."""
    return LineIndex.of(docs, id_col, text_col).report(docs, id_col, text_col)
