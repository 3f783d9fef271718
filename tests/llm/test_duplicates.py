import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import golay
from tessera.llm import simhash as H
from tessera.llm import suffix_dedup as D
from tessera.llm.components import components
from tests.conftest import DATA
from tests.llm.helpers import SCHEMA, awkward, nothing, words_text


def plain_fingerprint(text, k=4):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_groups(fps, most=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_groups_equal_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {rows[i].doc_id: (f"{fps[i]:016x}", rows[g].doc_id) for i, g in enumerate(plain_groups(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in H.near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert got == want


def test_awkward_rows(spark):
    got = H.near_duplicates(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].fingerprint == by_id[1].fingerprint == by_id[2].fingerprint == "0" * 16
    assert by_id[1].component_id == by_id[2].component_id == 0
    assert by_id[6].component_id == by_id[None].component_id == 5
    assert H.near_duplicates(nothing(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4))
def test_fingerprints_four_bits_apart_share_a_key(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    keys, rows = H.fuzzy_keys(np.array([fp, other], dtype=np.uint64).view(np.int64))
    assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_golay_code():
    words = np.arange(0, 1 << 23, 977)
    keys = golay.keys(words)
    assert set(((keys >= 0).sum(1)).tolist()) <= {1, 6}
    assert keys.max() < 4096 and (keys[:, 0] >= 0).all()


def test_hot_keys_take_the_linear_way(spark, monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    table = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    monkeypatch.setattr(H, "HOT_KEY", 3)
    monkeypatch.setattr(H, "links_within", _with_hot(H.links_within))
    found = {tuple(sorted(r)) for r in H.links(table).collect()}
    groups = plain_groups(fps)
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[find(a)] = find(b)
    for i in range(len(fps)):
        for j in range(i):
            assert (find(signed[i]) == find(signed[j])) == (groups[i] == groups[j])


def _with_hot(links_within):
    def small(keys, fps):  # tasks read the module anew, so the bound is set there too
        from tessera.llm import simhash

        simhash.HOT_KEY = 13
        return links_within(keys, fps)

    return small


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[201] == got[200] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_removal(docs):
    first = {}
    for i, raw in docs:
        for s in range(len(raw) - 49):
            first[raw[s : s + 50]] = min(first.get(raw[s : s + 50], i), i)
    out = {}
    for i, raw in docs:
        mask = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < i:
                mask[s : s + 50] = True
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        out[i] = (len(raw), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def as_map(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_removal_equals_brute_force(spark):
    rng = random.Random(4)
    shared = [words_text(rng, n) for n in (9, 12, 30)]
    texts = [" ".join(rng.choice([words_text(rng, rng.randrange(1, 40)), rng.choice(shared)]) for _ in range(4)) for _ in range(60)]
    texts += [texts[3], texts[3][:49], texts[3][:50], "ab" * 90, "ab" * 40, "a" * 200, "a" * 49, "a" * 75 + "b", "é" * 60, "é" * 30, "", None]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    assert as_map(D.dedup_report(docs)) == plain_removal([(order[i], (t or "").encode()) for i, t in enumerate(texts)])


def groups(tables, *columns):
    """Rows of Arrow tables by the values of some columns, as Spark would deal them."""
    whole = pa.concat_tables([t if isinstance(t, pa.Table) else pa.Table.from_batches([t]) for t in tables])
    keys = list(zip(*(whole.column(c).to_pylist() for c in columns), strict=True))
    return [whole.take([i for i, k in enumerate(keys) if k == key]) for key in sorted(set(keys))]


def steps(tasks, hot, ranges=5, shards=4, parts=3):
    """The steps of suffix dedup over tasks of (id, text), without Spark: removal masks by id."""
    batch = lambda rows: pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    every = [r for t in tasks for r in t]
    first = {}
    for i, t in every:
        first[t] = min(first.get(t, i), i)
    copies = {i for i, t in every if first[t] < i}
    sent = [b for t in tasks for b in D._send_anchors([batch(t)], ranges)]
    met = [D._repeated(g, ranges, hot) for g in groups(sent, "back", "part")]
    lists, often = {}, []
    for g in groups(met, "part"):
        for r in D._by_document(g).to_pylist():
            if r["id"] is None:
                often += r["keys"]
            else:
                lists[r["id"]] = r["keys"]

    class Often:
        value = often

    rows = [batch(t).append_column("keys", pa.array([None if i in copies else lists.get(i) for i, _ in t], pa.list_(pa.int64()))) for t in tasks]
    sent = [b for r in rows for b in D._send_contexts([r], shards, Often)]
    found = [D._settle(g, parts) for g in groups(sent, "shard")] if sent else []
    spans = {r["id"]: (r["starts"], r["stops"]) for g in (groups(found, "part") if found else []) for r in D._unpack(g).to_pylist()}
    out = {}
    for i, t in every:
        raw = t.encode()
        out[i] = D.removed_mask(len(raw), *(([0], [D._WHOLE]) if i in copies and len(raw) >= D.LENGTH else spans.get(i, ([], []))))
    return out, often, lists, sent


@pytest.mark.parametrize("hot", [2, 5, 10_000])
@pytest.mark.parametrize("trial", range(3))
def test_steps_with_hot_anchors_and_several_flushes(monkeypatch, hot, trial):
    """Frequent passages, copies, several flushes a task and several shards."""
    for name, value in (("CHUNK", 2_000), ("GATHER", 5_000), ("GATHER_CONTEXTS", 3_000)):
        monkeypatch.setattr(D, name, value)
    rng = random.Random(trial)
    shared = [words_text(rng, n) for n in (10, 14, 40)]
    texts = [" ".join(rng.choice([words_text(rng, rng.randrange(1, 30)), rng.choice(shared)]) for _ in range(4)) for _ in range(80)]
    texts += [texts[0]] * 12 + ["ab" * 90, "ab" * 40]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = list(zip(ids, texts, strict=True))
    got, often, lists, sent = steps([docs[:50], docs[50:70], docs[70:]], hot)
    want = plain_removal([(i, t.encode()) for i, t in docs])
    assert {i: int(m.sum()) for i, m in got.items()} == {i: w[1] for i, w in want.items()}
    assert (len(often) > 0) == (hot < 10_000) and len({r for b in sent for r in b.column(0).to_pylist()}) > 1


def test_copies_of_a_task_send_their_anchors_once():
    text = words_text(random.Random(1), 200)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(100, 200), pa.int64()), "text": [text] * 100})
    sent = pa.Table.from_batches(list(D._send_anchors([batch], 4)))
    assert {i for b in sent.column("ids").to_pylist() for i in D.from_planes(b, 8).tolist()} == {100}


def test_ranges_and_shards_hold_like_shares():
    """Anchors are least hashes, so most of their keys are small."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000)) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(40), pa.int64()), "text": texts})
    sent = pa.Table.from_batches(list(D._send_anchors([batch], 32)))
    told = np.zeros(32)
    np.add.at(told, sent.column("part").to_numpy(), [len(k) for k in sent.column("keys").to_pylist()])
    assert told.max() < 1.5 * told.mean()
    found = [r for p in groups([sent], "part") for r in D._by_document(p).to_pylist()]
    keys = [np.concatenate([r["keys"] for r in found if r["id"] == i]) for i in range(40)]

    class Often:
        value = []

    sent = pa.Table.from_batches(list(D._send_contexts([batch.append_column("keys", pa.array(keys))], 32, Often)))
    held = np.zeros(32)
    np.add.at(held, sent.column("shard").to_numpy(), [len(t) for t in sent.column("text").to_pylist()])
    assert held.sum() > 800_000 and held.max() < 1.5 * held.mean()


def test_rows_do_not_grow_with_shards_and_parts(monkeypatch):
    """Rows follow the contexts and removed runs; shards and parts grow with the input as the tasks
    do, so a row a flush and shard would grow with its square."""
    monkeypatch.setattr(D, "CHUNK", 3_000)
    monkeypatch.setattr(D, "GATHER_CONTEXTS", 8_000)
    rng = random.Random(5)
    shared = [words_text(rng, 40) for _ in range(30)]
    texts = [" ".join(rng.choice([words_text(rng, 20), rng.choice(shared)]) for _ in range(8)) for _ in range(80)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(80), pa.int64()), "text": texts})
    found = [r for t in groups([D._repeated(g, 4, 10_000) for g in groups(D._send_anchors([batch], 4), "back", "part")], "part") for r in D._by_document(t).to_pylist()]
    known = batch.append_column("keys", pa.array([next((r["keys"] for r in found if r["id"] == i), None) for i in range(80)], pa.list_(pa.int64())))

    class Often:
        value = []

    def rows(shards, parts):
        sent = list(D._send_contexts([known], shards, Often))
        settled = [D._settle(g, parts) for g in groups(sent, "shard")]
        return len(sent), sum(b.num_rows for b in sent), sum(t.num_rows for t in settled)

    few, many = rows(8, 3), rows(4_000, 300)
    assert few[0] > 3 and few == many


def test_settled_windows_that_meet_are_one_span():
    ids, starts, stops = (np.array(x) for x in ([7, 3, 7, 7, 3], [90, 0, 10, 60, 200], [140, 50, 70, 95, 260]))
    assert [x.tolist() for x in D._merged(ids, starts, stops)] == [[3, 7], [2, 1], [0, 200, 10], [50, 260, 140]]
    assert [x.tolist() for x in D._merged(*(x[:0] for x in (ids, starts, stops)))] == [[], [], [], []]


def test_frequent_anchors_go_straight_back():
    passage = words_text(random.Random(2), 60)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(300), pa.int64()), "text": [f"{passage} own{i}" for i in range(300)]})
    sent = list(D._send_anchors([batch], 4))
    told = [D.from_planes(k, 5) for b in sent for back, k in zip(b.column("back").to_pylist(), b.column("keys").to_pylist(), strict=True) if not back]
    keys, n = np.unique(np.concatenate(told), return_counts=True)
    assert n.max() <= 2
    found = [D._repeated(g, 4, 250) for g in groups(sent, "back", "part")]
    often = [k for t in found for p, b in zip(t.column("part").to_pylist(), t.column("keys").to_pylist(), strict=True) if p < 0 for k in D.from_planes(b, 5)]
    assert often and {r["id"] for g in groups(found, "part") if g.column("part")[0].as_py() >= 0 for r in D._by_document(g).to_pylist()} == set(range(300))


def test_removal_in_awkward_rows(spark):
    got = D.dedup_report(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    removed = {r.doc_id: r.n_removed for r in got if r.doc_id not in (5, None)}
    assert removed[0] == removed[1] == 0 and removed[6] > 50
    assert {r.n_removed for r in got if r.doc_id in (5, None)} == {0} or all(r.n_removed < r.n_bytes for r in got if r.doc_id in (5, None))
    assert D.dedup_report(nothing(spark)).count() == 0
    kept = D.without_repeats(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == awkward(spark).count()


@pytest.mark.parametrize("trial", range(12))
def test_two_stage_order(trial):
    rng = random.Random(trial)
    strings = [bytes(rng.choice(b"abc"[: 1 + trial % 3]) for _ in range(rng.randrange(50, 90))) for _ in range(6)]
    text, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
    begin = ends - [len(s) for s in strings]
    wanted = np.concatenate([np.arange(b, e - 49) for b, e in zip(begin, ends, strict=True)])
    order = D.suffix_order(text, ends, wanted)
    assert sorted(order.tolist()) == wanted.tolist()
    heads = [text[p : p + 50].tobytes() for p in order]
    seen = set()
    for a, b in zip(heads, heads[1:]):  # equal heads are neighbours
        if a != b:
            assert b not in seen
            seen.add(a)


def test_pages_of_bytes():
    values = np.array([0, 1, 255, 256, 2**39, 7])
    assert (D.from_planes(D.planes(values, 5), 5) == values).all()
    assert (D.from_planes(D.planes(-values, 8), 8) == -values).all()


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_similar_groups_join_copies_and_leave_others(spark):
    rng = random.Random(9)
    texts = [words_text(rng, 200, 2000) for _ in range(120)]
    for i in range(40):  # near copies: a few words changed
        words = texts[i].split()
        for at in rng.sample(range(len(words)), 2):
            words[at] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper()]
    got = {r.doc_id: r.component_id for r in H.similar_groups(spark.createDataFrame(list(enumerate(texts)), SCHEMA.split(", lang")[0])).collect()}
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert alike < 0.8 or got[i] == got[j]
            assert alike > 0.3 or got[i] != got[j]
    assert all(c == min(k for k in got if got[k] == c) for c in got.values())


def test_similar_groups_of_awkward_rows(spark):
    got = {r.doc_id: r.component_id for r in H.similar_groups(awkward(spark)).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[6] == got[5] == 5 and None not in got
    assert H.similar_groups(nothing(spark)).count() == 0


def planted(rng, low, high, n=200):
    """A text and a near copy of it whose shingle sets are alike by ``low`` to ``high``."""
    while True:
        words = words_text(rng, n, 5000).split()
        copy = list(words)
        for at in rng.sample(range(n), rng.randrange(3, 24)):
            copy[at] = f"new{rng.randrange(10**6)}"
        a, b = " ".join(words), " ".join(copy)
        if low <= len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < high:
            return a, b


def groups_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.component_id for r in H.similar_groups(docs).collect()}


def test_lone_pairs_are_found_from_the_threshold_on(spark):
    rng = random.Random(12)
    texts = [t for _ in range(400) for t in planted(rng, 0.8, 0.85)]
    got = groups_of(spark, texts)
    assert [got[i + 1] for i in range(0, len(texts), 2)] == list(range(0, len(texts), 2))


def test_pairs_below_the_threshold_stay_apart(spark):
    rng = random.Random(13)
    texts = [t for low in (0.5, 0.6, 0.7) for _ in range(100) for t in planted(rng, low, low + 0.099)]
    assert groups_of(spark, texts) == {i: i for i in range(len(texts))}


def test_large_groups_equal_brute_force(spark):
    """A template with many near copies of several versions: components by all pairs."""
    rng = random.Random(14)
    base = words_text(rng, 200, 5000).split()
    versions = []
    for _ in range(6):
        version = list(base)
        for at in rng.sample(range(200), 8):
            version[at] = f"new{rng.randrange(10**6)}"
        versions.append(version)
    texts = []
    for _ in range(120):
        words = list(rng.choice(versions))
        for at in rng.sample(range(200), rng.randrange(4)):
            words[at] = f"own{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets, want = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    assert 1 < len(set(want)) < 60
    assert groups_of(spark, texts) == dict(enumerate(want))


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(15)
    a, b, c = (words_text(rng, 80, 5000) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, c), (3, b + " end"), (4, a.upper()), (None, a), (None, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id bigint, text string, id string, component_id int").repartition(3)
    kept = H.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("1", a), ("1", b), ("2", c), ("None", a), ("None", "None"), ("5", "None")])
    groups_ = {(r.doc_id, r.text_hash.hex()): (r.component_id, r.kept) for r in H.similar_groups(docs).collect()}
    assert len({k for k, v in groups_.items() if v[1]}) == 4 and len(groups_) == 7
    assert H.without_near_duplicates(docs.where("false")).count() == 0


def test_a_row_repeated_very_often_is_one_member(spark):
    rng = random.Random(16)
    base = words_text(rng, 60, 5000)
    rows = [(7, base)] * 500 + [(8, base + " tail")] + [(9, words_text(rng, 60, 5000))]
    kept = H.without_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == [7, 9]


@pytest.mark.parametrize("trial", range(3))
def test_pairs_across_components_hold_all_that_are_alike(spark, trial):
    """Near copies of one set, with edits of their own or shared, longer and shorter ones, and
    unlike sets: no pair of unlike components that is alike is left out, and few others stay."""
    rng = random.Random(trial)
    base = [rng.getrandbits(60) for _ in range(60)]
    pool = [rng.getrandbits(60) for _ in range(12)]
    sets = {0: base}
    for i in range(1, 150):
        own = list(base)
        for _ in range(rng.randrange(0, 26)):
            where = rng.randrange(len(own))
            how = rng.randrange(4)
            new = rng.choice(pool) if rng.random() < 0.3 else rng.getrandbits(60)
            own[where : where + (how != 3)] = [new] if how else []
        sets[i] = own if rng.random() < 0.9 else [rng.getrandbits(60) for _ in range(50)]
    sets = {i: np.unique(np.array(x, dtype=np.uint64)) for i, x in sets.items()}
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) * 5 >= len(np.union1d(sets[i], sets[j])) * 4
    component = {i: 0 if alike(0, i) else i for i in sets}
    for i in sets:  # some of the others are in one component
        if component[i] and rng.random() < 0.2:
            component[i] = min([j for j in sets if component[j] and alike(i, j)], default=i)
    keys = {i: [k for k in range(3) if rng.random() < 0.7] or [0] for i in sets}
    rows = [(k, 0, i, component[i]) for i in sets for k in keys[i]]
    split = spark.createDataFrame(rows, "key bigint, main bigint, id bigint, component bigint")
    stored = spark.createDataFrame([(i, x.tobytes()) for i, x in sets.items()], "id bigint, hashes binary")
    got = {tuple(sorted((r.a, r.b))) for r in H._across(split, stored).collect()}
    met = {(i, j) for i in sets for j in sets if i < j and component[i] != component[j] and set(keys[i]) & set(keys[j])}
    assert {(i, j) for i, j in met if alike(i, j)} <= got <= met and len(got) < len(met) / 4


def test_similar_groups_begin_with_fingerprints(spark, monkeypatch):
    """Without any minimum-hash key, near copies within four bits are still found, by Golay keys
    alone, and verified; a member of many keys is named by a join of one row."""
    rng = random.Random(21)
    texts = [words_text(rng, 400, 5000) for _ in range(60)]
    texts += [t + " more" for t in texts[:30]]
    monkeypatch.setattr(H, "_candidates", lambda table: pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "key")}))
    got = groups_of(spark, texts)
    bits = [H.majority(H.shingle_hashes(H.normal_words(t)).astype(">u8").tobytes()) for t in texts]
    near = [i for i in range(30) if (bits[i] ^ bits[60 + i]).bit_count() <= H.MAX_BITS]
    assert len(near) > 20 and all(got[60 + i] == i for i in near)
    assert all(got[i] == i for i in range(60))
    members = spark.createDataFrame([(k, i) for k in range(7) for i in range(40)], "key bigint, id bigint")
    grouped = spark.createDataFrame([(i, i % 2) for i in range(40)], "node bigint, component bigint")
    split = H._split(members, grouped)
    assert sorted(map(tuple, split.select("key", "id", "component", "main").collect())) == sorted((k, i, i % 2, 1) for k in range(7) for i in range(40))
