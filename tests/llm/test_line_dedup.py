import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import cuckoo
from tessera.llm import line_dedup as L
from tests.conftest import DATA
from tests.llm.helpers import awkward, nothing

KEY = "doc_id bigint, text string"


def plain(rows):
    """Sorted (doc_id, n_lines, n_dropped, kept_sha256) by brute force."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line))
    order = lambda i: float("inf") if i is None else i
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)], key=order) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(found):
    return sorted(map(tuple, found.collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_report_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain(pairs(docs))
    assert got(L.line_report(docs)) == want and any(r[2] for r in want)


def test_awkward_rows(spark):
    lines = ["The Same Long Line here", "  the same long line HERE\t", "short", "", "ÄÖÜ lines of Other letters", "äöü lines of other letters", "123456789", "1234567890", "a long line\r", "a long line"]
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, "", "\n", "\n\n", "\n".join(rng.choices(lines, k=rng.randrange(1, 9)))])) for _ in range(60)]
    rows += [(3, rows[5][1]), (3, rows[5][1]), (100, "\n".join(rng.choices(lines, k=40_000)))]
    assert got(L.line_report(spark.createDataFrame(rows, KEY))) == plain(rows)
    assert got(L.line_report(awkward(spark))) == plain(pairs(awkward(spark)))
    assert L.line_report(nothing(spark)).collect() == []


def test_texts_lose_lines_and_columns_stay(spark):
    rows = [(2, "one long line here\nown", 7, "x", "y"), (1, "ONE long line HERE", 8, "z", None), (3, None, 1, "q", "r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id int, hash string, dropped string")
    out = L.LineIndex.of(docs).applied(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "ONE long line HERE", 8, "z", None), (2, "own", 7, "x", "y"), (3, None, 1, "q", "r")]


def members(index):
    """(hash64, times) of all keys, and whether each shard's filter holds exactly its keys."""
    for row in index.state.collect():
        table, entries = L._state_of(pa.Table.from_pylist([row.asDict()], schema=L.arrow_schema(L._STATE)))
        known = np.unique(entries["keys"]["hash"])
        assert cuckoo.contains(table, known).all() and int((table > 0).sum()) == len(known)
        assert (entries["n"] > 0).all()


def test_documents_in_and_out(spark):
    """After any turns the index tells what a new one of the documents that are in would tell."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = sorted(pairs(docs))
    part = lambda k: spark.createDataFrame([r for r in rows if r[0] % 3 == k], KEY)
    index = L.LineIndex.of(part(1)).inserted(part(0))
    assert got(index.report(part(0).unionByName(part(1)))) == plain([r for r in rows if r[0] % 3 < 2])
    index = index.inserted(part(2))
    assert got(index.report(docs)) == plain(rows)
    members(index)
    out = [r for r in rows if r[0] % 4 == 0 or r[0] < 10]
    left = index.deleted(spark.createDataFrame(out + [(999_999, "")], KEY))
    rest = [r for r in rows if r not in out]
    assert got(left.report(spark.createDataFrame(rest, KEY))) == plain(rest)
    members(left)
    again = left.inserted(spark.createDataFrame(out, KEY))
    assert got(again.report(docs)) == plain(rows)
    members(again)


def test_shards_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_ENTRIES", 5)
    rows = [(i, "\n".join(f"line number {j}" for j in range(i, i + 20))) for i in range(40)]
    index = L.LineIndex.of(spark.createDataFrame(rows[:3], KEY))
    more = index.inserted(spark.createDataFrame(rows[3:], KEY))
    assert more.shards > index.shards
    assert got(more.report(spark.createDataFrame(rows, KEY))) == plain(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=300, unique=True), st.data())
def test_filter_holds_what_is_in(hashes, data):
    hashes = np.array(sorted(hashes), np.int64)
    table = cuckoo.of(hashes)
    assert cuckoo.contains(table, hashes).all() and (table > 0).sum() == len(hashes)
    gone = hashes[data.draw(st.lists(st.booleans(), min_size=len(hashes), max_size=len(hashes)).map(lambda x: np.array(x, bool)))]
    cuckoo.delete(table, gone)
    left = np.setdiff1d(hashes, gone)
    assert cuckoo.contains(table, left).all() and (table > 0).sum() == len(left)


def test_filter_under_load():
    rng = np.random.default_rng(4)
    hashes = np.unique(rng.integers(-(1 << 62), 1 << 62, size=200_000))
    table = cuckoo.empty(int(len(hashes) * 0.9))
    assert cuckoo.insert(table, hashes) and cuckoo.contains(table, hashes).all()
    assert cuckoo.contains(table, rng.integers(-(1 << 62), 1 << 62, size=200_000)).mean() < 0.001


def test_false_hits_are_told_apart(monkeypatch):
    """With fingerprints of three values, most new keys seem to be there; the table tells."""
    places = cuckoo._places

    def narrow(hashes, buckets):
        mark, one, _ = places(hashes, buckets)
        mark = mark % np.uint16(3) + np.uint16(1)
        return mark, one, cuckoo._other(one, mark, buckets)

    monkeypatch.setattr(cuckoo, "_places", narrow)
    keys = np.zeros(500, L._KEY)
    keys["hash"], keys["rest"] = np.arange(500) * 7919, np.arange(500)
    row = {"shard": 0, "batch": 1, "at": np.arange(500, dtype=np.int32).tobytes(), "keys": keys.tobytes(), "n": np.ones(500, np.int32).tobytes(), "low": np.arange(500).tobytes(), "high": np.arange(500).tobytes()}
    schema = L.arrow_schema(L._MESSAGE)
    empty = pa.table({f.name: pa.array([], f.type) for f in L.arrow_schema(L._STATE)})
    monkeypatch.setattr(L, "LOOKED_UP", 50)
    state = L._absorbed(0, empty, pa.Table.from_pylist([row], schema=schema))
    table, entries = L._state_of(state)
    assert not entries["marked"].any() and (table > 0).sum() == 500
    again = row | {"batch": 2, "low": (np.arange(500) + 1).tobytes(), "high": (np.arange(500) + 1).tobytes()}
    _, entries = L._state_of(L._absorbed(0, state, pa.Table.from_pylist([again], schema=schema)))
    assert entries["marked"].all()
