import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import dashboard, evaluation, lookups, records, reports, statistics, vectors
from tessera.plans import cli, schemas
from tessera.plans.all import QUERIES
from tessera.sources import tables
from tessera.streaming import incremental
from tests.conftest import DATA

QUERY_SCHEMA = "query int, category string, difficulty string, expected_items array<string>, expected_sections array<string>, signals array<string>"


def test_modes_of_categories(spark):
    queries = [
        (1, "incident_lookup", "easy", ["x", "y"], [], []), (2, "section_queries", "easy", ["x"], ["Probable Cause"], []), (3, "phase_queries", "hard", [], [], ["fire", "wing"]),
        (4, "phase_queries", "hard", ["x"], [], ["fire", "wing"]), (5, "other", "hard", ["x"], ["A"], []), (6, "phase_queries", "hard", [], [], ["fire", "wing"]),
    ]
    hits = [("z", "", "none"), ("x", "(b) PROBABLE CAUSE", "Fire on the WING"), ("x", "probable", "fire only"), ("y", None, "wing and fire")]
    results = [(q, rank, *h) for q in range(1, 6) for rank, h in enumerate(hits, 1)]
    df = spark.createDataFrame(results, "query int, rank int, item string, section string, text string")
    got = {r["query"]: r for r in evaluation.evaluated(df, spark.createDataFrame(queries, QUERY_SCHEMA)).collect()}
    gain = 1 / math.log2(3) + 1 / math.log2(5)
    assert [got[i].mode for i in range(1, 7)] == ["items", "sections", "signals", "items", "none", "signals"]
    assert (got[1].mrr, got[1].precision_10, got[1].recall_10, got[1].hit_1, got[1].hit_3) == (0.5, 0.3, 1.0, False, True)
    assert got[1].ndcg_10 == pytest.approx(gain / (1 + 1 / math.log2(3)))
    assert got[2].section_accuracy == 0.2 and got[2].mrr == 0 and got[2].hit_10
    assert (got[3].mrr, got[3].precision_10, got[3].recall_10) == (0.5, 0.2, 0.0) and got[3].ndcg_10 == pytest.approx(gain / (1 + 1 / math.log2(3)))
    assert got[4].recall_10 == 1.0 and got[5].mrr == got[5].section_accuracy == 0 and got[6].mrr == got[6].ndcg_10 == 0
    means = {r.category: r for r in evaluation.means(spark.createDataFrame(list(got.values())), "category").where("no_category = 0").collect()}
    assert means["section_queries"].mrr is None and means["section_queries"].section_accuracy == 0.2
    assert means["phase_queries"].n_ranked == 3 and means["other"].n_ranked == 1


def test_p_values_equal_the_jvms(spark):
    for t, n in ((0.0, 12), (0.3, 10), (-2.5, 12), (4.0, 40), (12.0, 200)):
        assert evaluation.t_two_sided(t, n) == pytest.approx(statistics.t_p_value(spark, t, n), abs=1e-10)


def test_paired_tests(spark):
    pairs = [(float(i), float(i) + (0.5 if i % 3 else -0.2)) for i in range(12)]
    row = evaluation.paired_tests(spark.createDataFrame(pairs, "a double, b double"), "a", "b").first()
    assert row.n == 12 and row.t < 0 and row.t_p_value == pytest.approx(statistics.t_p_value(spark, row.t, 12), abs=1e-9)
    # 8 differences of 0.5 share rank 8.5, 4 of 0.2 share 2.5
    assert row.w == 10.0 and row.z == pytest.approx((10 - 39) / math.sqrt(12 * 13 * 25 / 24 - (8**3 - 8 + 4**3 - 4) / 48))
    few = evaluation.paired_tests(spark.createDataFrame(pairs[:5], "a double, b double"), "a", "b").first()
    assert few.n == 5 and few.t is None and few.t_p_value is None and few.w_p_value is None
    same = evaluation.paired_tests(spark.createDataFrame([(1.0, 1.0)] * 12, "a double, b double"), "a", "b").first()
    assert same.t is None and same.z is None
    row = QUERIES["stat_paired_tests"](spark, DATA).first()
    assert row.n >= 10 and 0 < row.t_p_value < 1 and 0 < row.w_p_value <= 1


def test_bootstrap_by_class(spark):
    rows = {r.o_orderpriority: r for r in QUERIES["stat_bootstrap"](spark, DATA).collect()}
    means = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/orders.parquet").groupBy("o_orderpriority").agg(F.avg("o_totalprice")).collect()}
    assert set(rows) == set(means) and all(rows[k].low < means[k] < rows[k].high for k in rows)
    constant = spark.range(50).select("id", F.lit(2.0).alias("x"))
    row = statistics.bootstrap_interval(constant, "x", 100, key="id").first()
    assert row.low == pytest.approx(2) and row.high == pytest.approx(2)
    assert statistics.bootstrap_interval(constant.where("false"), "x", 10).first().low is None


def test_topics_cover_the_documents(spark):
    got = QUERIES["topics_approx"](spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count() and got.where("topic not between 0 and 7").count() == 0


def test_stratified_sample_quotas_and_top_up(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 93 else "c") for i in range(100)], "id int, s string")
    got = reports.stratified_sample(rows, "s", "id", 30).collect()
    per = {s: sum(r.s == s for r in got) for s in "abc"}
    assert len({r.id for r in got}) == 30 and per["b"] == 3 and per["c"] == 7 and per["a"] == 20
    assert reports.stratified_sample(rows, "s", "id", 500).count() == 100
    assert reports.stratified_sample(rows, "s", "id", 2).count() == 2 and reports.stratified_sample(rows.where("false"), "s", "id", 5).count() == 0


def test_page_issues_stop_at_the_first_error(spark):
    good = {"report_id": "r", "page_number": 1, "extraction_method": "embedded", "extraction_pass": 1, "text": "t", "quality_metrics": dict.fromkeys(records.QUALITY_FIELDS, 1), "metadata": dict.fromkeys(records.METADATA_FIELDS, "x")}
    ocr = good | {"extraction_method": "ocr"}
    cases = {
        "good": good, "no text": {k: v for k, v in good.items() if k not in ("text", "metadata")}, "no ratio": good | {"quality_metrics": {"char_count": 1}},
        "no source": good | {"metadata": {"extracted_at": 1}}, "unsure": ocr, "ocr": ocr | {"ocr_confidence": dict.fromkeys(records.CONFIDENCE_FIELDS, 1)}, "no words": ocr | {"ocr_confidence": dict.fromkeys(records.CONFIDENCE_FIELDS[:4], 1)},
    }
    rows = [(k, json.dumps(v)) for k, v in cases.items()] + [("broken", "{"), ("null", None)]
    got = sorted((r.k, r.severity, r.issue) for r in records.page_issues(spark.createDataFrame(rows, "k string, raw string"), "k", "raw").collect())
    assert got == sorted([
        ("no text", "ERROR", "missing field: text"), ("no ratio", "ERROR", "missing quality_metrics field: alphabetic_ratio"), ("no source", "WARNING", "missing metadata field: extraction_time_ms"),
        ("no source", "WARNING", "missing metadata field: pdf_source"), ("unsure", "ERROR", "missing ocr_confidence"), ("no words", "ERROR", "missing ocr_confidence field: total_words"),
        ("broken", "ERROR", "invalid JSON"), ("null", "ERROR", "invalid JSON"),
    ])


def test_vectors_that_cannot_be_compared(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.9, 0.1])], "vec_id bigint, v array<double>")
    assert [r.vec_id for r in vectors.neighbours(rows, rows.where("vec_id = 1"), "vec_id", "v", 5).collect()] == [5]
    keyed = spark.createDataFrame([(i % 3, [float(i), 1.0]) for i in range(30)] + [(None, [1.0, 1.0]), (1, None)], "k int, v array<double>").repartition(4)
    assert {r.k: r.vector for r in vectors.centroids(keyed, "k", "v").collect()} == {k: [13.5 + k, 1.0] for k in range(3)}
    assert vectors.centroids(keyed.where("false"), "k", "v").count() == 0


def test_cursor_and_retry(spark, tmp_path):
    path = str(tmp_path / "cursor")
    incremental.save_cursor(spark, path, "scrape", 3, 7)
    incremental.save_cursor(spark, path, "scrape", 4, 1)
    assert incremental.cursor(spark.read.parquet(path), "scrape") == (4, 1) and incremental.cursor(spark.read.parquet(path), "other") is None
    incremental.save_cursor(spark, path, "scrape")
    assert incremental.cursor(spark.read.parquet(path), "scrape") is None
    first = spark.createDataFrame([(1, "passed"), (2, "failed"), (3, None)], "id int, status string")
    got = incremental.retried(first, lambda rows: rows.withColumn("status", F.lit("retried"))).collect()
    assert sorted((r.id, r.status) for r in got if r.status) == [(1, "passed"), (2, "retried")] and len(got) == 3


def test_files_hashes_and_metadata(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("hello")
    (tmp_path / "y.txt").write_text("no")
    assert [r.path.rsplit("/", 1)[1] for r in tables.files_under(spark, str(tmp_path), "*.json").collect()] == ["x.json"]
    row = tables.file_hashes(spark, str(tmp_path), "*.json").first()
    assert row.length == 5 and row.sha256.startswith("2cf24dba")
    tables.write_with_metadata(spark.range(3), str(tmp_path / "v"), model="m")
    assert tables.read_metadata(spark, str(tmp_path / "v")) == {"model": "m"} and spark.read.parquet(str(tmp_path / "v" / "data")).count() == 3
    sizes = tables.in_batches(spark.range(250).coalesce(1), lambda b: __import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]}), "n bigint", 100).collect()
    assert sum(r.n for r in sizes) == 250 and max(r.n for r in sizes) <= 100


def test_dashboard_tables_and_sinks(spark, tmp_path):
    a, b = (spark.createDataFrame(evaluation.provided(spark, DATA, r).collect()) for r in (False, True))
    found = dashboard.dashboard_tables(a, b, spark.createDataFrame([("a", 1)], "run string, query int"))
    done = dashboard.export_tables(found | {"broken": spark.range(1).selectExpr("raise_error('no') AS x")}, str(tmp_path / "dash"))
    assert len(found) == 7 and {k: v[0] for k, v in done.items()} == {**dict.fromkeys(found, "ok"), "broken": "failed"}
    assert spark.read.parquet(done["benchmark_decision"][1]).count() == 1
    assert dashboard.decision(a, a).first().recommendation == "a: similar, smaller" and dashboard.decision(a, a, 0.1, 0.2).first().recommendation == "b: higher lift"
    rows = spark.createDataFrame([("x|y", None), ("<b>", "{1}")], "t string, v string")
    assert dashboard.markdown_table(rows) == "| t | v |\n| --- | --- |\n| x\\|y |  |\n| <b> | {1} |\n"
    page = dashboard.html_cards(rows, "t")
    assert "<h2>&lt;b&gt;</h2><ul><li>v: {1}</li></ul>" in page
    with pytest.raises(ValueError, match="more than 1 rows"):
        dashboard.markdown_table(rows, 1)
    dashboard.write_review_csv(rows, str(tmp_path / "csv"), "your_decision")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["t", "v", "your_decision"]
    dashboard.write_text(page, spark, str(tmp_path / "html"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "html")).collect()) == page.rstrip("\n")


def test_schema_creation(spark, tmp_path):
    root = str(tmp_path / "db")
    assert schemas.schema_version(spark, root) == 0
    assert set(schemas.create_tables(spark, root)) == set(schemas.SCHEMAS) and schemas.create_tables(spark, root) == []
    assert schemas.schema_version(spark, root) == schemas.VERSION and spark.read.parquet(f"{root}/chunks").count() == 0


def test_command_line(spark, tmp_path):
    said = []
    assert cli.main(["list"], spark, said.append) == 0 and "txt_chunks" in said[0]
    assert cli.main(["run", "dim_children", DATA, "--out", str(tmp_path), "--format", "json", "--limit", "2"], spark, said.append) == 0
    assert spark.read.json(str(tmp_path / "dim_children")).count() == 2
    assert cli.main(["exploration", "/nowhere", "--out", str(tmp_path)], spark, said.append) == 1 and "failed" in said[-1]
    assert all(cli.names_of(g) for g in cli.GROUPS)


def test_runs_and_topics_are_read_back_if_they_are_there(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert lookups.read_run(spark, path, 1) is None
    tables.write_run(spark.range(3), path, 1)
    assert lookups.read_run(spark, path, 1).count() == 3 and lookups.read_run(spark, path, 2) is None
    words = lookups.fixed_chunks(spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, None)], "i int, t string"), "i", "t", 4, 1).orderBy("i", "n").collect()
    assert [(r.i, r.n, r.chunk) for r in words] == [(1, 0, "a b c d"), (1, 1, "d e f g")]
