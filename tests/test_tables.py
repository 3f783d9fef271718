import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import assemble, keys, retrieval, statistics, vectors
from tessera.plans import catalog
from tessera.sources import tables as S
from tessera.streaming import incremental as R
from tests.conftest import DATA


def test_jsonl_keeps_bad_lines_apart(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    read = S.read_jsonl(spark, str(path), "a bigint").cache()
    assert sorted(r.a for r in S.good_rows(read).collect()) == [1, 2]
    assert read.where("_corrupt_record is not null").count() == 1


def test_page_tree_and_latest_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}/page_{i}.json").write_text(json.dumps({"page": i, "text": "t"}, indent=1))
    assert S.read_page_tree(spark, str(tmp_path), "page bigint, text string").count() == 3
    assert S.latest_file(spark, f"{tmp_path}/*/page_*.json").endswith("page_2.json")
    assert S.latest_file(spark, f"{tmp_path}/none*") is None


def test_runs_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "runs")
    S.write_run(spark.range(3), path, 1)
    S.write_run(spark.range(5), path, 2)
    S.write_run(spark.range(2), path, 1)
    assert dict(spark.read.parquet(path).groupBy("run_id").count().collect()) == {1: 2, 2: 5}
    counts = S.row_and_byte_counts(spark, path).first()
    assert counts.rows == 7 and counts.bytes > 0


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, keep int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 3), (4, None, 4)], "k int, v string, keep int")
    got = {r.k: (r.v, r.keep) for r in S.upsert(old, new, ["k"], ["keep"]).collect()}
    assert got == {1: ("a", 1), 2: ("B", 2), 3: ("c", 3), 4: (None, 4)}
    left, n = S.delete_where(old, F.col("k") == 1)
    assert (left.count(), n) == (1, 1)


def test_page_boundaries_count_separators(spark):
    pages = spark.createDataFrame([(1, 0, "abcd", "user"), (1, 1, "ef", "bot"), (1, 3, "g", "user")], "d int, p int, t string, s string")
    row = assemble.documents_of(pages, "d", "p", "t", "s").first()
    assert row.full_text == "abcd\n\nef\n\ng" and row.primary_source == "mixed"
    assert [(x.start, x.stop) for x in row.pages] == [(0, 4), (4, 8), (8, 11)]
    assert all(row.full_text[x.start : x.stop].strip() == x.t for x in row.pages)


def test_key_sets(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "k int") for x in ([1, 2, 2, 3], [3, 4]))
    assert tuple(keys.key_sets(a, b, "k").first()) == (1, 2, 1)


def test_equal_similarities_prefer_the_later_category(spark):
    import numpy as np

    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, v array<double>")
    got = vectors.assign(rows, "id", "v", [10, 20, 30], np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), 2, 0.1).collect()
    assert [(r.category, r.rank) for r in got] == [(20, 1), (10, 2)]


def test_metrics_of_repeated_results(spark):
    ranked = spark.createDataFrame([(1, "a", 1, True), (1, "a", 2, True), (1, "b", 3, False)], "query int, item string, rank int, relevant boolean")
    row = retrieval.metrics(ranked, spark.createDataFrame([(1, 2)], "query int, n_relevant bigint")).first()
    assert (row.mrr, row.precision_5, row.recall_10, row.hit_1) == (1.0, 0.4, 0.5, 1)
    assert 0.5 < row.ndcg_10 < 0.7
    nothing = retrieval.metrics(ranked.withColumn("relevant", F.lit(False)), spark.createDataFrame([(1, 0)], "query int, n_relevant bigint")).first()
    assert (nothing.mrr, nothing.recall_10, nothing.ndcg_10, nothing.hit_20) == (0.0, 0.0, 0.0, 0)


def test_paired_statistics(spark):
    pairs = [(float(i), float(i) + (0.5 if i % 3 else -0.2)) for i in range(12)]
    row = statistics.paired_t(spark.createDataFrame(pairs, "a double, b double"), "a", "b").first()
    assert row.n == 12 and row.t_statistic < 0
    assert 0 < statistics.t_p_value(spark, row.t_statistic, row.n) < 0.05
    assert 0 < statistics.signed_rank_p_value(spark, [p[0] for p in pairs], [p[1] for p in pairs]) < 0.2
    few = statistics.paired_t(spark.createDataFrame(pairs[:5], "a double, b double"), "a", "b").first()
    assert few.t_statistic is None


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"))
    row = statistics.bootstrap_interval(df, "x", 200).first()
    assert row.low < 4.5 < row.high and row.high - row.low < 1.2
    assert row == statistics.bootstrap_interval(df, "x", 200).first()


def test_topics_and_their_words(spark):
    docs = spark.createDataFrame([(i, "engine fire smoke engine" if i % 2 else "runway landing gear runway") for i in range(20)], "doc_id bigint, text string")
    found = statistics.topics(docs, "doc_id", "text", k=2)
    by_parity = {(r.doc_id % 2, r.topic) for r in found.collect()}
    assert len(by_parity) == 2
    best = {r.word for r in statistics.topic_words(found).where("rank = 1").collect()}
    assert best == {"engine", "runway"}


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("s", "t", "c"))
    spark.range(5).write.parquet(source)
    R.ingest_available(spark, source, target, state, "id")
    spark.range(5, 8).write.mode("append").parquet(source)
    R.ingest_available(spark, source, target, state, "id")
    R.ingest_available(spark, source, target, state, "id")
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(8))


def test_run_ledger_folds_events(spark, tmp_path):
    path = str(tmp_path / "ledger")
    R.append_event(spark, path, "r1", "full", "running")
    R.append_event(spark, path, "r1", "full", "completed", rows="5")
    R.append_event(spark, path, "r2", "full", "running")
    found = {r.run_id: r for r in R.runs(spark.read.parquet(path)).collect()}
    assert found["r1"].status == "completed" and found["r1"].completed_at and found["r1"].detail == {"rows": "5"}
    assert found["r2"].status == "running" and found["r2"].completed_at is None


def test_catalog_and_shell(spark):
    names = catalog.register_tables(spark, DATA)
    assert set(names) == set(catalog.TABLES)
    assert "v_chunks_by_section" in catalog.register_views(spark, DATA)
    assert catalog.row_counts(spark, ["region", "nothing_here"]) == {"region": 5, "nothing_here": 0}
    said = []
    catalog.shell(spark, ["SELECT r_name -- a comment\n", "FROM region WHERE r_regionkey = 0;\n", "SELECT nope;\n", ".views\n", ".exit\n"], said.append)
    assert "r_name" in said[0] and said[1].startswith("error") and "v_chunks_by_section" in said[2]
    assert catalog.run_sql(spark, "SELECT * FROM region WHERE r_regionkey = :k", said.append, k=99) and said[-1] == "(0 rows)"


@pytest.mark.parametrize("size", [0, 3])
def test_neighbours_of_few_rows(spark, size):
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(size)], "vec_id bigint, v array<double>")
    found = vectors.neighbours(rows, rows.where("vec_id = 0"), "vec_id", "v", 5)
    assert [r.vec_id for r in found.orderBy("rank").collect()] == ([1, 2] if size else [])


def test_gold_queries_and_their_issues(spark, tmp_path, monkeypatch):
    from tessera.operators import records

    path = tmp_path / "gold.yaml"
    path.write_text(
        "queries:\n- {id: a, query: x, difficulty: easy, ground_truth: {expected_report_ids: [r1]}}\n"
        "- {id: b, query: '', difficulty: odd, ground_truth: {relevance_signals: []}}\n"
    )
    found = {(r.id, r.issue) for r in records.gold_issues(records.read_gold(spark, str(path))).collect()}
    assert found == {("b", "missing query"), ("b", "unknown difficulty"), ("b", "no ground truth")}
    monkeypatch.setattr(records, "GOLD_BYTES", 20)
    with pytest.raises(ValueError, match="more than 20"):
        records.read_gold(spark, str(path))


def test_ocr_statistics_count_words_only(spark):
    from tessera.operators import records

    rows = [(1, 5, "word", 90.0), (1, 5, "dim", 40.0), (1, 5, " ", 10.0), (1, 4, "line", 80.0), (1, 5, "none", -1.0), (2, 5, "", 50.0)]
    got = {r.p: r for r in records.ocr_statistics(spark.createDataFrame(rows, "p int, level int, text string, conf double"), ["p"]).collect()}
    assert (got[1].mean_confidence, got[1].low_confidence_words, got[1].total_words) == (65.0, 1, 2)
    assert (got[2].mean_confidence, got[2].total_words) == (0.0, 0)
    bands = spark.createDataFrame([(85.0,), (60.0,), (1.0,), (None,)], "c double").select(records.ocr_band(F.col("c"))).collect()
    assert [b[0] for b in bands] == ["good", "acceptable", "poor", None]


def test_page_documents_and_collections(spark, tmp_path):
    from tessera.operators import records

    pages = spark.createDataFrame([("r.pdf", 3, "some text")], "r string, p int, t string")
    row = records.page_documents(pages, "r", "p", "t", "embedded").first()
    assert row.name == "r.pdf_page_0003.json" and json.loads(row.body)["quality_metrics"]["reason"] == "too_short"
    vectors = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [2.0])], "k int, v array<double>")
    assert records.write_collection(vectors, str(tmp_path / "c"), "k") == 2
    arrays = spark.createDataFrame([(1, ["x"])], "k int, tags array<string>")
    assert {r.k: r.tags for r in records.enrich_collection(vectors, arrays, "k").collect()} == {1: ["x"], 2: []}


def test_neighbours_of_many_queries_take_little_memory():
    """A batch meets many queries in blocks; ties, copies and vectors with NaN rank as by brute force."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, size=(10_000, 8)).astype(np.float32)  # many ties
    v[17] = np.nan
    unit, ids = vectors._guarded(v[::5].astype(np.float64)), np.arange(0, 10_000, 5)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(np.arange(10_000)), "v": pa.array(list(v), pa.list_(pa.float32()))})
    tracemalloc.start()
    found = pa.Table.from_batches(vectors._nearest_in([batch.slice(0, 6_000), batch.slice(6_000)], "id", ids, unit, 20))
    assert tracemalloc.get_traced_memory()[1] < 150e6  # all similarities at once are 160 MB, and were held several times
    tracemalloc.stop()
    q, got, s = (found.column(i).to_numpy().reshape(len(ids), 20) for i in range(3))
    assert (q == ids[:, None]).all()
    for at in range(0, len(ids), 97):
        similar = np.round(vectors._guarded(v.astype(np.float64)) @ unit[at], 9)
        similar[[17, ids[at]]] = -np.inf
        want = np.lexsort((np.arange(10_000), -similar))[:20]
        assert got[at].tolist() == want.tolist() and np.allclose(s[at], similar[want], atol=1e-9)
