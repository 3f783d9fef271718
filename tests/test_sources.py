import itertools
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, intervals
from tessera.operators.phrases import Phrases, phrases_in
from tessera.sources import sqlite
from tessera.sources.keyed import KeyedTable
from tessera.sources.tables import good_rows, read_csv, read_jsonl, write_jsonl
from tessera.streaming import incremental as R


def keyed(spark, path, buckets=8):
    return KeyedTable(spark, str(path), ["k"], spark.createDataFrame([], "k int, v string, at int").schema, buckets)


def test_merges_touch_their_buckets_only(spark, tmp_path):
    t = keyed(spark, tmp_path / "t")
    assert t.read().collect() == [] and t.merge(t.read()) == 0
    rows = [(k, f"v{k}", 1) for k in range(100)]
    assert t.merge(spark.createDataFrame(rows, t.schema)) == 8
    before = t.state()[1]
    late = spark.createDataFrame([(5, "new", 2), (5, "newer", 3), (5, "old", 0)], t.schema)
    assert t.merge(late, ["at"]) == 1
    after = t.state()[1]
    assert sum(before[b] != after[b] for b in after) == 1
    want = {k: v for k, v, _ in rows} | {5: "newer"}
    assert {r.k: r.v for r in t.read().collect()} == want
    t.merge(late, ["at"])  # again: nothing changes; an older row doesn't replace
    assert {r.k: r.v for r in t.read().collect()} == want and t.read().count() == 100
    t.merge(spark.createDataFrame([(5, None, 9), (7, None, 9), (1000, None, 9)], t.schema), gone=F.lit(True))
    assert {r.k for r in t.read().collect()} == set(range(100)) - {5, 7}


def test_readers_see_the_old_or_the_new_state(spark, tmp_path):
    t = keyed(spark, tmp_path / "t")
    t.merge(spark.createDataFrame([(k, "a", 1) for k in range(20)], t.schema))
    reader = t.read()
    t.merge(spark.createDataFrame([(k, "b", 2) for k in range(40)], t.schema))
    assert {r.v for r in reader.collect()} == {"a"} and {r.v for r in t.read().collect()} == {"b"}
    number, folders = t.state()
    with pytest.raises(RuntimeError, match="another merge"):
        t._publish(number, folders)
    assert t.state() == (number, folders)


def test_keys_that_come_again_in_later_files(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    t = keyed(spark, tmp_path / "t")
    put = lambda rows: spark.createDataFrame(rows, t.schema).coalesce(1).write.mode("append").parquet(source)
    put([(1, "a", 1), (2, "b", 1)])
    R.ingest_keyed(spark, source, t, state, ["at"])
    put([(2, "c", 2), (3, "d", 1), (None, "n", 1)])
    R.ingest_keyed(spark, source, t, state, ["at"])
    R.ingest_keyed(spark, source, t, str(tmp_path / "lost"), ["at"])  # all files again, as after a lost state
    assert sorted(map(tuple, t.read().collect()), key=str) == [(1, "a", 1), (2, "c", 2), (3, "d", 1), (None, "n", 1)]
    target = str(tmp_path / "first")
    R.ingest_available(spark, source, target, str(tmp_path / "s2"), "k")
    put([(1, "z", 9), (4, "e", 1)])
    R.ingest_available(spark, source, target, str(tmp_path / "s2"), "k")
    assert {(r.k, r.n) for r in spark.read.parquet(target).groupBy("k").agg(F.count("*").alias("n")).collect()} >= {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_ledger_by_listener(spark, tmp_path):
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    spark.range(50).write.parquet(source)
    listener = R.LedgerListener(spark, ledger, "ingest")
    spark.streams.addListener(listener)
    try:
        R.ingest_available(spark, source, str(tmp_path / "out"), str(tmp_path / "state"), "id")
        for _ in range(60):
            found = [r for r in R.runs(spark.read.schema(R.LEDGER).parquet(ledger)).collect() if r.status == "completed"] if (tmp_path / "ledger").exists() else []
            if found:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert found[0].run_type == "ingest" and found[0].detail["rows"] == "50" and found[0].completed_at is not None


def test_observed_counts(spark, tmp_path):
    seen = R.observed_write(spark.range(70), str(tmp_path / "o"), top=F.max("id"))
    assert seen == {"rows": 70, "top": 69} and spark.read.parquet(str(tmp_path / "o")).count() == 70


def test_sqlite_files(spark, tmp_path):
    path = str(tmp_path / "one.db")
    db = sqlite3.connect(path)
    db.execute('CREATE TABLE "odd ""name" (id INTEGER PRIMARY KEY, "a b" TEXT, x REAL, y BLOB)')
    rows = [(i * 7, None if i % 5 == 0 else f"t{i % 3}", i / 2, bytes([i])) for i in range(40)]
    db.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?, ?)', rows)
    db.execute("CREATE TABLE empty_one (id INTEGER)")
    db.commit()
    db.close()
    read = lambda **o: sqlite.read_sqlite(spark, f"file://{path}", 'odd "name', **o)
    assert [f.simpleString() for f in read().schema] == ["id:bigint", "a b:string", "x:double", "y:binary"]
    assert sorted(map(tuple, read().collect()), key=str) == sorted(rows, key=str)
    few = spark.read.format("sqlite").option("path", path).option("table", 'odd "name').option("range", 50).load()
    assert few.rdd.getNumPartitions() == 6 and few.count() == 40
    got = read(columns="x double, `a b` string").where("x >= 3 and `a b` = 't1' and `a b` is not null").collect()
    assert sorted((r.x, r["a b"]) for r in got) == sorted((x, t) for _, t, x, _ in rows if x >= 3 and t == "t1")
    assert sqlite.read_sqlite(spark, path, "empty_one").collect() == []


def test_conditions_reach_the_database():
    from pyspark.sql import datasource as D

    reader = sqlite.Reader({"path": "/none", "table": "t"}, None)
    left = list(reader.pushFilters([D.GreaterThan(("x",), 3), D.IsNotNull(("x",)), D.StringContains(("s",), "a"), D.EqualTo(("b",), True)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "EqualTo"] and reader.conditions == [('"x" > ?', 3), ('"x" IS NOT NULL', None)]


def test_sqlite_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}" if i % 4 else None, i / 3) for i in range(1000)], "k bigint, v string, x double")
    assert sqlite.write_sqlite(rows.repartition(3), str(tmp_path / "db"), "t") == 1000
    assert sorted(sqlite.read_sqlite(spark, str(tmp_path / "db"), "t").collect()) == sorted(rows.collect())


def test_text_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(good_rows(read_jsonl(spark, str(tmp_path / "j"), "k int, v string")).collect()) == sorted(rows.collect())
    rows.write.option("header", True).csv(str(tmp_path / "c"))
    assert sorted(read_csv(spark, str(tmp_path / "c"), "k int, v string").collect()) == sorted(rows.collect())


def test_many_phrases_equal_contains(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdeé ", k=n))
    phrases = [(rng.randrange(300), word(rng.randrange(2, 6))) for _ in range(10_000)] + [(1, None), (2, ""), (None, "abc"), (5, "ABC")]
    texts = [(i, word(rng.randrange(0, 200)).upper() if i % 2 else word(80)) for i in range(60)] + [(60, None), (61, "")]
    found = Phrases.of(spark.createDataFrame(phrases, "o int, p string"), "p", "o")
    got = {r.id: (r.n_phrases, {o.owner: o.n for o in r.owners}) for r in phrases_in(spark.createDataFrame(texts, "id int, t string"), "id", "t", found, 2).collect()}
    pairs = {(o, p.lower()) for o, p in phrases if p and o is not None}
    for i, t in texts:
        held = {(o, p) for o, p in pairs if p in (t or "").lower()}
        owners = [o for o, _ in held]
        assert got[i] == (len({p for _, p in held}), {o: owners.count(o) for o in set(owners) if owners.count(o) >= 2})
    none = Phrases.of(spark.createDataFrame([], "o int, p string"), "p", "o")
    assert {r.n_phrases for r in phrases_in(spark.createDataFrame(texts, "id int, t string"), "id", "t", none).collect()} == {0}


def test_intervals_of_all_lengths(spark):
    """One entity holds most rows; long, short, touching, empty, open and repeated intervals."""
    rng = random.Random(9)

    def some(n):
        out = []
        for i in range(n):
            a, size = rng.randrange(2000), rng.choice([0, 1, 1, 2, 3, 5, 60, 64, 65, 900, 5000, None])
            out.append((rng.choice(["hot", "hot", "hot", "e", None]), i, a, None if size is None else a + size))
        return [*out, out[0], ("hot", n, None, 5), ("hot", n + 1, 9, 3)]

    left, right = some(120), some(90)
    x, y = (spark.createDataFrame(r, "e string, i int, a int, b int") for r in (left, right))
    got = sorted((r.left.e, r.left.i, r.right.i) for r in intervals.overlapping(x, y, ["e"], ("a", "b"), ("a", "b")).collect())
    end = lambda b: float("inf") if b is None else b
    good = lambda r: r[0] is not None and r[2] is not None and end(r[3]) > r[2]
    want = sorted((p[0], p[1], q[1]) for p in left for q in right if good(p) and good(q) and p[0] == q[0] and p[2] < end(q[3]) and q[2] < end(p[3]))
    assert got == want and len(got) > 1000
    assert intervals.overlapping(x.where("false"), y, ["e"], ("a", "b"), ("a", "b")).collect() == []


@pytest.mark.parametrize("n", [1, 5, 10, 13])
def test_exact_ranks_equal_enumeration(n):
    sums = [sum(r for r, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=n)]
    for w in range(n * (n + 1) // 4 + 1):
        assert evaluation.signed_rank_exact(w, n) == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / len(sums)), abs=1e-12)


def test_exact_ranks_of_pairs(spark):
    rows = [(float(i), float(i) + (0.1 + i / 100) * (1 if i % 4 else -1)) for i in range(12)]
    row = evaluation.paired_tests(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert row.w_p_value == pytest.approx(evaluation.signed_rank_exact(row.w, 12)) and row.w_p_value != pytest.approx(0.05, abs=1e-9)
    tied = evaluation.paired_tests(spark.createDataFrame([*rows, (0.0, 0.0)], "a double, b double"), "a", "b").first()
    assert tied.w == row.w and tied.w_p_value != pytest.approx(row.w_p_value)
