"""SimHash near-duplicate groups with Golay-code fuzzy keys.

1. A fingerprint bit is 1 if it is set in over half of the hashes of the text's word
   shingles. Equal fingerprints become one row, so copies never meet as pairs.
2. The 64 bits are three segments (22, 21, 21 bits, filled with zeros to 23). Fingerprints
   that differ in at most four bits have at most one segment with three or more errors, so
   two segments have at most two each, and there they share a Golay key. The keys of each
   two segments together (24 bits) are the join keys.
3. Rows travel as packed arrays by key range. Within a key, exact distances are computed
   and only links of a spanning forest leave, never all pairs. A key with more than
   ``HOT_KEY`` fingerprints is not compared there: its fingerprints go to an exact linear
   way, where all words within two bits of each are keys; those that meet at such a word
   are at most four bits apart, and fingerprints at most four apart meet at one.
4. Components are found by joins (``components``).

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle; repeated rows and ties share their
component, named by its smallest id; a null id is never the smallest unless all are null;
an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.llm import golay
from tessera.llm.common import arrow_schema, as_batch, dealt, map_rows, release, small_batches, texts_of, unused, written
from tessera.llm.components import components

MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HOT_KEY = 8192
#: Key rows that one range of keys should hold on average.
RANGE_ROWS = 1_500_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) <= shingle:
        raw = digest(joined, seed)
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0, *[e + 1 for e in ends]]
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)])
    return majority(raw)


def majority(raw: bytes) -> int:
    """The bits that are set in over half of 64-bit hashes, given as big-endian bytes."""
    by_byte = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)
    n = len(by_byte)
    if n > 300:
        counts = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ _BITS for j in range(8)])
    else:
        counts = np.unpackbits(by_byte, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batch):
        fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], dtype=np.uint64)
        return {"id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    return map_rows(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for all keys of all fingerprints; a key holds which two segments it is of."""
    fps = fps.view(np.uint64)
    found = [golay.keys((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)) for at, n in SEGMENTS]
    keys, rows = [], []
    for which, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = found[i][:, :, None], found[j][:, None, :]
        good = (a >= 0) & (b >= 0)
        keys.append(((which << 24) | (a << 12) | b)[good].astype(np.uint32))
        rows.append(np.nonzero(good)[0])
    return np.concatenate(keys), np.concatenate(rows)


def spread(values: np.ndarray, ranges: int) -> np.ndarray:
    """A range number for each value, by a multiplicative hash."""
    mixed = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _packed(batches, ranges: int, step: int, make):
    """Rows (range, keys, fps) of packed arrays, from batches of fingerprints."""
    kinds = arrow_schema("part int, keys binary, fps binary")

    def flush(fps: np.ndarray):
        out = {"part": [], "keys": [], "fps": []}
        keys, rows = make(fps)
        part = spread(keys, ranges)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(edges)):
            own = order[edges[r] : edges[r + 1]]
            out["part"].append(int(r))
            out["keys"].append(keys[own].tobytes())
            out["fps"].append(fps[rows[own]].tobytes())
        return as_batch(out, kinds)

    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        n += len(held[-1])
        if n >= step:
            yield flush(np.concatenate(held))
            held, n = [], 0
    if n:
        yield flush(np.concatenate(held))


def _of_range(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints of a range, sorted by key, without repeats."""
    keys = np.concatenate([np.frombuffer(b, dtype=kind) for b in table.column("keys").to_pylist()])
    fps = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in table.column("fps").to_pylist()])
    order = np.lexsort((fps, keys))
    return keys[order], fps[order]


def forest(fps: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (fp, root) that connect what is connected within ``most`` bits."""
    left, out = fps.view(np.uint64), []
    while len(left) > 1:
        root, rest = int(left[0]), left[1:]
        queue = [left[0]]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= most
            if near.any():
                new = rest[near]
                queue.extend(new)
                out.extend((root, int(x)) for x in new)
                rest = rest[~near]
        left = rest
    return out


def links_within(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) of all keys of a range, and fingerprints of its hot keys."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    a, b, hot = [], [], []
    plain = fps.view(np.uint64)
    for n in np.unique(size[(size > 1) & (size <= 12)]):  # small groups of one size at once
        at = first[size == n]
        for i, j in combinations(range(n), 2):
            near = np.bitwise_count(plain[at + i] ^ plain[at + j]) <= MAX_BITS
            a.append(fps[at[near] + i])
            b.append(fps[at[near] + j])
    for at, n in zip(first[size > 12].tolist(), size[size > 12].tolist(), strict=True):
        if n > HOT_KEY:
            hot.append(fps[at : at + n])
        elif pairs := forest(fps[at : at + n]):
            x = np.array(pairs, dtype=np.uint64).view(np.int64)
            a.append(x[:, 0])
            b.append(x[:, 1])
    none = np.zeros(0, dtype=np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1], np.unique(np.concatenate([none, *hot]))


def words_near(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, row): every word within two bits of each fingerprint."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate([np.zeros(1, dtype=np.uint64), one, one[i] | one[j]])
    words = fps.view(np.uint64)[:, None] ^ flips
    return words.ravel(), np.repeat(np.arange(len(fps)), len(flips))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most MAX_BITS apart; ``distinct`` has
    a written column fp of distinct values."""
    n = distinct.count()
    ranges = max(16, -(-n * 84 // RANGE_ROWS))
    keyed = distinct.select("fp").mapInArrow(lambda b: _packed(b, ranges, 40_000, fuzzy_keys), "part int, keys binary, fps binary")
    kinds = arrow_schema("a bigint, b bigint")

    def verify(table: pa.Table) -> pa.Table:
        a, b, hot = links_within(*_of_range(table, np.uint32))
        rows = {"a": np.r_[a, hot], "b": pa.array(np.r_[b, hot], mask=np.r_[np.zeros(len(a), bool), np.ones(len(hot), bool)])}
        return pa.table({k: pa.array(v) for k, v in rows.items()}, schema=kinds)

    found = written(dealt(keyed, ranges // 4, "part").applyInArrow(verify, "a bigint, b bigint"), "found")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    wide = max(16, -(-hot.count() * 2081 // RANGE_ROWS))
    near = hot.mapInArrow(lambda b: _packed(b, wide, 2_000, words_near), "part int, keys binary, fps binary")

    def star(table: pa.Table) -> pa.Table:
        keys, fps = _of_range(table, np.uint64)
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        center = fps[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        pairs = np.unique(np.stack([center, fps], 1)[center != fps], axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, schema=kinds)

    starred = dealt(near, wide // 4, "part").applyInArrow(star, "a bigint, b bigint")
    return found.where("b is not null").unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id)."""
    marked = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    grouped = components(links(distinct)).withColumnRenamed("node", "fp")
    named = distinct.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "component").select("fp", "component_id")
    out = marked.join(by_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bands of ``similar_groups`` and the minimum hashes of one; least similarity, as a fraction.
BANDS, BAND_ROWS = 46, 7
SIMILAR = (4, 5)
#: Larger groups of a band are first compared with one member only.
PAIRED = 8
#: Rounds in which the rest of a group is compared with some members, and how many.
ROUNDS, ROOTS = 2, 4
#: Pairs that one copy of a shingle set is compared in.
PAIRS_A_COPY = 256
_SEEDS = np.random.default_rng(17).integers(0, 1 << 32, size=(2, BANDS * BAND_ROWS, 1), dtype=np.uint32) | np.array([[[0]], [[1]]], np.uint32)


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; fewer words make one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends]]
    last = ends[shingle - 1 :] or ends[-1:]
    return np.array([digest(joined[a:b]) for a, b in zip(starts, last, strict=False)], dtype=np.uint64)


def shingle_set(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the word shingles, each once."""
    return np.unique(shingle_hashes(words, shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the least values of the set under BAND_ROWS permutations."""
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, ((short[at : at + 1024] ^ _SEEDS[0]) * _SEEDS[1]).min(1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _packed_bands(batches, ranges: int):
    kinds = arrow_schema("part int, keys binary, ids binary")
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
        ids = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), BANDS)
        part = spread(keys, ranges)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(ranges + 1))
        out = {f.name: [] for f in kinds}
        for r in np.flatnonzero(np.diff(edges)):
            own = order[edges[r] : edges[r + 1]]
            for column, value in zip(out.values(), (int(r), keys[own].tobytes(), ids[own].tobytes()), strict=True):
                column.append(value)
        yield as_batch(out, kinds)


_FOUND = "a bigint, b bigint, key bigint"


def _candidates(table: pa.Table) -> pa.Table:
    """Pairs (a, b) of ids to compare in a range of keys: all of a small group, those with
    the smallest id in a larger one, whose members are also given, as (id, null, key)."""
    read = lambda c, kind: np.concatenate([np.frombuffer(b, dtype=kind) for b in table.column(c).to_pylist()])
    keys, ids = read("keys", np.int64), read("ids", np.int64)
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]
    keys, ids = keys[new], ids[new]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, PAIRED + 1):
        at = first[size == n]
        for i, j in combinations(range(n), 2):
            a.append(ids[at + i])
            b.append(ids[at + j])
    big = np.repeat(size > PAIRED, size)
    root = np.repeat(ids[first], size)
    a.append(root[big])
    b.append(ids[big])
    pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    none, n = np.zeros(0, np.int64), int(big.sum())
    kinds = arrow_schema(_FOUND)
    members = {"a": pa.array(ids[big]), "b": pa.nulls(n, pa.int64()), "key": pa.array(keys[big])}
    paired = {"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "key": pa.nulls(len(pairs), pa.int64())}
    return pa.concat_tables([pa.table(paired, schema=kinds), pa.table(members, schema=kinds), pa.table({"a": none, "b": none, "key": none}, schema=kinds)])


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two shingle sets have at least SIMILAR of their union in common."""
    part, whole = SIMILAR
    if min(len(x), len(y)) * whole < max(len(x), len(y)) * part:
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * whole >= (len(both) - common) * part


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, x, y): pairs with the shingle sets of both, of ``sets`` (id, hashes). An id in many
    pairs as ``a`` has its set copied, so that its pairs are dealt over tasks."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies")).where("copies > 1")
    dealt = pairs.join(copies, "a", "left").withColumn("copy", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).cast("int"))
    firsts = sets.withColumnsRenamed({"id": "a", "hashes": "x"}).join(copies, "a", "left")
    firsts = firsts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    joined = dealt.drop("copies").join(sets.withColumnsRenamed({"id": "b", "hashes": "y"}), "b").join(firsts, ["a", "copy"])
    return joined.select("a", "b", "x", "y")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike."""

    def run(batch):
        x, y = (batch.column(i).to_pylist() for i in (2, 3))
        good = [alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)]
        kept = np.flatnonzero(good)
        return {"a": batch.column(0).take(pa.array(kept)), "b": batch.column(1).take(pa.array(kept))}

    return map_rows(_with_sets(pairs, sets), run, "a bigint, b bigint")


def _candidates_by_fingerprint(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes of ``distinct`` (node, bits) that have one fingerprint, or that
    ``links`` connects: Golay keys of two of three segments, at most MAX_BITS apart."""
    firsts = written(distinct.groupBy(F.col("bits").alias("fp")).agg(F.min("node").alias("first")), "firsts")
    same = distinct.join(firsts, F.col("bits") == F.col("fp")).where("node != first").select("first", "node")
    a, b = (firsts.toDF(c, f"of_{c}") for c in "ab")
    near = links(firsts.select("fp")).join(a, "a").join(b, "b").select(F.least("of_a", "of_b"), F.greatest("of_a", "of_b"))
    return same.toDF("a", "b").unionByName(near.toDF("a", "b"))


def _apart(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not of one component."""
    a, b = (grouped.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    named = pairs.join(a, "a", "left").join(b, "b", "left")
    return named.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _tallied(named: DataFrame) -> DataFrame:
    """(key, component, n): members of (keys, component) by key, counted within each batch first, so
    that what many members share is one row a batch and not one a member and key."""
    kinds = arrow_schema("key bigint, component bigint, n bigint")

    def run(batch):
        lengths = pc.list_value_length(batch.column(0)).to_numpy()
        both = pa.table({"key": batch.column(0).flatten(), "component": np.repeat(batch.column(1).to_numpy(), lengths)})
        found = both.group_by(["key", "component"]).aggregate([([], "count_all")]).select(["key", "component", "count_all"])
        return as_batch({c: found.column(c).combine_chunks() for c in found.column_names}, kinds)

    parts = map_rows(named, run, "key bigint, component bigint, n bigint")
    return parts.groupBy("key", "component").agg(F.sum("n").alias("n"))


def _split(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """Written (key, main, id, component): members of the keys that hold several components,
    with the one that most of them are in."""
    of = grouped.withColumnRenamed("node", "id")
    own = members.groupBy("id").agg(F.collect_set("key").alias("keys"))  # BANDS at most, so that a member is named once
    tally = _tallied(own.join(of, "id", "left").select("keys", F.coalesce("component", "id").alias("component"))).groupBy("key")
    tally = tally.agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("several")).where("several > 1")
    tally = written(tally.select("key", F.col("most.component").alias("main")), "tally")
    left = members.distinct().join(tally, "key").join(of, "id", "left")
    return written(left.select("key", "main", "id", F.coalesce("component", "id").alias("component")), "split")


def _differences(split: DataFrame, sets: DataFrame) -> DataFrame:
    """Written (main, id, d, u, near, e) of the members of each main component's keys: the
    shingles ``e`` in which a member differs from the set of the component's node, packed, their
    number d, u as ``_across`` needs it, and whether the member is alike to that node."""
    part, whole = SIMILAR

    def run(batch):
        out = {k: [] for k in ("main", "id", "d", "u", "near", "e")}
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            own = np.setxor1d(x, y, assume_unique=True)
            d = (whole + part) * len(own)
            row = (a, b, len(own), d - (whole - part) * len(y), d <= (whole - part) * (len(x) + len(y)), own.tobytes())
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        return out

    pairs = written(split.select(F.col("main").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    return written(map_rows(_with_sets(pairs, sets), run, "main bigint, id bigint, d bigint, u bigint, near boolean, e binary"), "differences")


def _rarest_shared(found: DataFrame) -> DataFrame:
    """(main, id, e, place): the differing shingles that several members of a main component
    share, with their place among all of the member's, rarest first."""

    def run(batch):
        own = [np.frombuffer(e, np.int64) for e in batch.column(3).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(own)), list(map(len, own))))
        return {n: batch.column(i).take(at) for i, n in enumerate(("main", "id", "d"))} | {"e": np.concatenate([np.zeros(0, np.int64), *own])}

    single = map_rows(found.select("main", "id", "d", "e"), run, "main bigint, id bigint, d bigint, e bigint")
    held = single.groupBy("main", "e").agg(F.count("*").alias("held")).where("held > 1")
    own = Window.partitionBy("main", "id")  # the shingles of one text
    rare = single.join(held, ["main", "e"]).withColumn("n", F.row_number().over(own.orderBy("held", "e")))
    return rare.select("main", "id", "e", (F.col("d") - F.count("*").over(own) + F.col("n")).alias("place"))


def _across(split: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that hold, or make needless, every link between members of one key that are
    not of one component.

    Let D(x) be the shingles in which x differs from its main component's node, d their number,
    n the size of x, p / w the similarity asked for, and u = (w + p) d - (w - p) n. As x and y
    differ in d(x) + d(y) - 2 |D(x) & D(y)| shingles, they are alike if and only if
    u(x) + u(y) <= 2 (w + p) |D(x) & D(y)|. So

    * members that are alike to the node itself are paired with it;
    * where u(x) + u(y) <= 0, x is alike to the member of least u too, and that one to the node,
      as is every y of u < 0: x is paired with that member;
    * any others share a number t of differing shingles, one at least. In one order of all
      shingles, rarest first, two sets that share t have one in common among the first
      d(x) - t + 1 and d(y) - t + 1, so only these are joined. Each member takes for t what
      its partner of least u asks for. Their first common one must have as many left on both
      sides as the two ask for.

    Changes that no other member has come first in that order, so copies that were each changed
    in their own way meet none of their group.
    """
    shared = 2 * sum(SIMILAR)
    found = _differences(split, sets)
    rows = split.select("main", "id", "component").distinct().join(found.drop("e"), ["main", "id"]).withColumn("other", F.col("component") != F.col("main"))
    bounds = rows.groupBy("main").agg(F.min(F.struct("u", "id")).alias("least"), F.min(F.when(F.col("other"), F.col("u"))).alias("least_other"))
    rows = written(rows.join(bounds, "main"), "across")
    near = rows.where("other and near").select(F.col("main").alias("a"), F.col("id").alias("b"))
    certain = rows.where(F.col("other") & (F.col("u") + F.col("least.u") <= 0)).select("least.id", "id").toDF("a", "b").where("a != b")

    def reach(least) -> Column:
        return F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("u") + least) / shared)) + 1

    placed = written(_rarest_shared(found).join(rows, ["main", "id"]).withColumns({"first": F.col("other") & (F.col("place") <= reach(F.col("least.u"))), "second": F.col("place") <= reach(F.col("least_other"))}), "placed")
    left = F.col("d") - F.col("place") + 1
    x = placed.where("first").select("main", "e", F.col("id").alias("a"), F.col("component").alias("of"), F.col("u").alias("ua"), left.alias("left_a"))
    y = placed.where("second").select("main", "e", F.col("id").alias("b"), "component", "other", "u", left.alias("left"))
    enough = F.col("ua") + F.col("u") <= shared * F.least("left_a", "left")
    met = x.join(y, ["main", "e"]).where((F.col("component") != F.col("of")) & (~F.col("other") | (F.col("b") < F.col("a"))) & enough)
    keys = split.groupBy("id").agg(F.collect_set("key").alias("keys"))  # BANDS at most
    a, b = (keys.toDF(n, f"keys_{n}") for n in "ab")
    met = met.select("a", "b").distinct().join(a, "a").join(b, "b").where(F.arrays_overlap("keys_a", "keys_b"))
    return near.unionByName(certain).unionByName(met.select("a", "b")).distinct()


def _joined(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) with the components that ``links`` (a, b) connect made one. Components
    are the nodes of that graph, so it is small."""
    a, b = (grouped.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    named = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    above = components(named.distinct())
    lone = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().join(grouped, "node", "left_anti")
    every = grouped.unionByName(lone.withColumn("component", F.col("node")))
    found = every.join(above.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    return written(found.select("node", F.coalesce("least", "component").alias("component")), "labels")


def _settled(members: DataFrame, grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) with all links between ``members`` (key, id) of a key.

    In each of ROUNDS, the members outside their key's main component are compared with ROOTS
    members of it, others each time, so that near copies of one text join it with a few pairs
    a member. Those still outside are then compared with the members in other components that
    share enough of their differing shingles, so that no link between components is left out.
    """
    for number in range(ROUNDS + 1):
        split = _split(members, grouped)
        if split.isEmpty():
            return grouped
        if number < ROUNDS:
            # by main component, so that a member of many keys is paired once
            w = Window.partitionBy("main").orderBy(F.xxhash64("id", F.lit(number)), "id")
            roots = split.where("component = main").select("main", "id").distinct()
            roots = roots.withColumn("n", F.row_number().over(w)).where(F.col("n") <= ROOTS).select("main", F.col("id").alias("a"))
            others = split.where("component != main").select("main", F.col("id").alias("b")).distinct()
            pairs = others.join(roots, "main").select("a", "b").distinct()
        else:
            pairs = _across(split, sets)
        links = written(verified(written(pairs, "pairs"), sets), "links")
        if not links.isEmpty():
            grouped = _joined(grouped, links)
    return grouped


def similar_groups(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, component_id, kept): groups of texts linked by shingle sets alike by
    SIMILAR or more, for every row that has an id. ``text_hash`` is that of the normal words;
    ``kept`` marks one (id, text_hash) of each group, that of its smallest id.

    Texts of equal words become one node. Fingerprints of the shingles, their Golay keys and exact
    distances give the first pairs (``links``); they are links only if their whole shingle
    sets, written once by node, are alike by SIMILAR, and their components are the first groups.
    At a similarity of 0.8 fingerprints differ in some ten bits, too many for these keys, so what
    is still apart is also brought together by a set's minimum hashes under BANDS x BAND_ROWS
    permutations, a key a band; texts of similarity s share one with probability
    1 - (1 - s^7)^46, 0.99998 at 0.8. These pairs are verified in the same way. Groups of over
    PAIRED texts are compared with their smallest node first, and then as ``_settled`` says, so
    that no link between components is left out.

    Defined cases: null, empty and blank texts are one group, as their sets are equal; rows
    that repeat id and text are one member; rows of one id with unlike texts are members of
    different groups; rows with a null id are left out; an empty table gives no rows. Ids are
    integers.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def run(batch):
        words = [normal_words(t) for t in texts_of(batch)]
        hashes = [shingle_hashes(w, shingle) for w in words]
        bits = np.array([majority(h.astype(">u8").tobytes()) if len(h) else 0 for h in hashes], dtype=np.uint64)
        keys = [band_keys(np.unique(h)).tobytes() for h in hashes]
        return {"id": batch.column(0), "fp": [text_hash(w) for w in words], "bits": pa.array(bits.view(np.int64)), "keys": keys}

    marked = written(map_rows(rows, run, "id bigint, fp binary, bits bigint, keys binary"), "bands")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("least"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    ranges = max(16, -(-distinct.count() * BANDS // RANGE_ROWS))
    keyed = distinct.select("keys", "node").mapInArrow(lambda b: _packed_bands(b, ranges), "part int, keys binary, ids binary")
    found = written(dealt(keyed, ranges // 4, "part").applyInArrow(_candidates, _FOUND), "found")
    near = written(_candidates_by_fingerprint(distinct.select("node", "bits")).distinct(), "near")
    banded = written(found.where("b is not null").select("a", "b").distinct(), "pairs")
    pairs = near.unionByName(banded)
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = distinct.join(needed, "node").select("node", F.col("least").alias("id"), "fp")
    # a shuffle at every size, as it must be where the wanted ids are many
    sets = _sets(rows.join(wanted.hint("merge"), "id").select("node", "fp", "text"), shingle)
    grouped = components(written(verified(near, sets), "links"))
    more = written(verified(written(_apart(banded, grouped), "pairs"), sets), "links")
    grouped = grouped if more.isEmpty() else _joined(grouped, more)
    grouped = _settled(found.where("b is null").select("key", F.col("a").alias("id")), grouped, sets)
    named = distinct.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min(F.struct("least", "node")).alias("first"))
    named = named.join(firsts, "component").select("fp", "least", F.col("first.least").alias("component_id"), (F.col("node") == F.col("first.node")).alias("own"))
    out = marked.select("id", "fp").join(named, "fp")
    kept = F.col("own") & (F.col("id") == F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("fp").alias("text_hash"), "component_id", kept.alias("kept"))


def text_hash(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Written (id, hashes), one row a node, from the texts (node, fp, text) of rows that have
    a node's id; only texts with its hash are the node's. Repeated rows go within each task,
    and by an exchange only where some are left."""
    small_batches(texts.sparkSession)
    kinds = arrow_schema("id bigint, hashes binary")

    def run(batches):
        release()
        seen: set[int] = set()
        for batch in batches:
            out = {"id": [], "hashes": []}
            for node, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch), strict=True):
                words = normal_words(text)
                if node not in seen and text_hash(words) == fp:
                    seen.add(node)
                    out["id"].append(node)
                    out["hashes"].append(shingle_set(words, shingle).tobytes())
            yield as_batch(out, kinds)

    sets = written(texts.mapInArrow(run, "id bigint, hashes binary"), "sets")
    repeated = sets.groupBy("id").count().where("count > 1")
    return sets if repeated.isEmpty() else written(sets.dropDuplicates(["id"]), "sets")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of ``similar_groups``: that of its
    smallest id. Rows that repeat id and words become one; rows with a null id stay."""
    own_id = F.col(f"`{id_col}`").cast("bigint")
    id_name, hash_name, kept_name = (unused(docs, n) for n in ("#id", "#hash", "#own"))
    groups = written(similar_groups(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "id"), "groups")
    repeated = written(groups.groupBy("id").count().where("count > 1").select(F.col("id").alias(id_name)), "repeated")
    gone = groups.where("not kept").select(F.col("id").alias(id_name)).unionByName(repeated).distinct()
    out = docs.join(gone, own_id == F.col(f"`{id_name}`"), "left_anti")
    if repeated.isEmpty():
        return out
    position = docs.columns.index(text_col)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = (t or "" for t in batch.column(position).to_pylist())
            hashes = pa.array([text_hash(normal_words(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], names=[*batch.schema.names, hash_name])

    several = docs.join(repeated, own_id == F.col(f"`{id_name}`"), "left_semi")
    several = several.mapInArrow(run, StructType([*docs.schema.fields, StructField(hash_name, BinaryType())]))
    kept = groups.where("kept").select(F.col("id").alias(id_name), F.col("text_hash").alias(kept_name))
    several = several.join(kept, (own_id == F.col(f"`{id_name}`")) & (F.col(f"`{hash_name}`") == F.col(f"`{kept_name}`")), "left_semi").dropDuplicates([id_col, hash_name])
    return out.unionByName(several.select(*[F.col(f"`{c}`") for c in docs.columns]))
