"""Records around the pipeline: payloads, page documents, OCR statistics, dimensions, gold
queries, review routing, reconciliation and version comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import page_quality, preview, token_estimate
from tessera.operators.reports import stratified_sample
from tessera.plans.registry import query
from tessera.sources.tables import table, write_parquet


@query("""SELECT d.doc_id, coalesce(d.source, '') AS report_id, coalesce(d.lang, 'unknown') AS section_name, greatest(1, d.n_chars // 4)::BIGINT AS token_count,
    CASE WHEN length(d.text) > 500 THEN left(d.text, 500) || '...' ELSE d.text END AS preview, l.quality, l.toxic FROM documents AS d LEFT JOIN labels AS l USING (doc_id)""")
def payloads(spark, sf_dir):
    """What is stored beside a vector: chunk fields with defaults, report fields if there are any."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("report_id"), F.coalesce("lang", F.lit("unknown")).alias("section_name"),
        token_estimate(F.col("n_chars")).alias("token_count"), preview(F.col("text")).alias("preview"), "quality", "toxic",
    )


def page_documents(pages: DataFrame, report: str, page: str, text: str, method: str) -> DataFrame:
    """One JSON document a page: name, and body with its quality metrics nested."""
    q = page_quality(F.col(text)).alias("quality_metrics")
    body = F.to_json(F.struct(F.col(report).alias("report_id"), F.col(page).alias("page_number"), F.lit(method).alias("extraction_method"), F.col(text).alias("text"), q))
    return pages.select(F.format_string("%s_page_%04d.json", F.col(report).cast("string"), F.col(page)).alias("name"), body.alias("body"))


def ocr_statistics(words: DataFrame, key: list[str], low: float = 60.0) -> DataFrame:
    """Confidence of recognised words by page: word level, not blank, with a confidence."""
    good = words.where((F.col("level") == 5) & (F.trim("text") != "") & (F.col("conf") != -1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = good.groupBy(*key).agg(
        F.avg("conf").alias("mean_confidence"), F.min("conf").alias("min_confidence"), F.max("conf").alias("max_confidence"),
        F.count_if(F.col("conf") < low).alias("low_confidence_words"), F.count("*").alias("total_words"),
    )
    every = words.select(*key).distinct().join(found, key, "left")
    return every.select(*key, *[zero(F.col(c)).alias(c) for c in found.columns[len(key) :]])


@query("""SELECT user_id, round(avg(value), 6) AS mean_confidence, min(value) AS min_confidence, max(value) AS max_confidence, count(*) FILTER (WHERE value < 60) AS low_confidence_words,
    count(*) AS total_words FROM events WHERE value <> -1 GROUP BY user_id""")
def rep_ocr_statistics(spark, sf_dir):
    words = table(spark, sf_dir, "events").select("user_id", F.lit(5).alias("level"), F.col("event_type").alias("text"), F.col("value").alias("conf"))
    found = ocr_statistics(words, ["user_id"])
    counts = {c: F.col(c).cast("bigint") for c in ("low_confidence_words", "total_words")}
    return found.withColumns(counts | {"mean_confidence": F.round("mean_confidence", 6)})


def ocr_band(confidence: Column) -> Column:
    return F.when(confidence >= 80, "good").when(confidence >= 60, "acceptable").when(confidence.isNotNull(), "poor")


def score_label(score: Column) -> Column:
    """How far an assignment can be trusted at sight; the best need no label."""
    return F.when(score >= 0.6, "").when(score >= 0.5, "medium").otherwise("low")


@query("""SELECT r_name AS parent, count(n_nationkey) AS children, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def dim_children(spark, sf_dir):
    """Children of each parent of a two-level dimension; parents without any stay."""
    return children_of(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), "r_regionkey", "r_name", "n_name")


def children_of(parents: DataFrame, children: DataFrame, key: str, parent: str, child: str) -> DataFrame:
    found = children.groupBy(key).agg(F.count("*").alias("children"), F.array_join(F.sort_array(F.collect_list(child)), ",").alias("names"))
    return parents.join(found, key, "left").select(F.col(parent).alias("parent"), F.coalesce("children", F.lit(0)).cast("bigint").alias("children"), F.coalesce("names", F.lit("")).alias("names"))


@query("""SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10""")
def dim_value_counts(spark, sf_dir):
    """The most frequent values with their mean and share."""
    found = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))
    found = found.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))
    return found.orderBy(F.desc("n"), "p_brand").limit(10)


@query("""SELECT event_type, user_id, count(*) AS results, count(*) FILTER (WHERE value < 20) AS needs_review, CASE WHEN count(*) FILTER (WHERE value < 20) > 0 THEN 'manual' ELSE 'keyword' END AS route,
    10 - count(*) FILTER (WHERE value >= 20) AS open FROM events GROUP BY event_type, user_id""")
def review_routing(spark, sf_dir):
    """Reviews that people must do, and those that keywords settle."""
    needs = F.count_if(F.col("value") < 20)
    rows = table(spark, sf_dir, "events").groupBy("event_type", "user_id")
    return rows.agg(F.count("*").alias("results"), needs.alias("needs_review"), F.when(needs > 0, "manual").otherwise("keyword").alias("route"), (10 - F.count_if(F.col("value") >= 20)).alias("open"))


@query("""SELECT CASE WHEN d.doc_id IS NULL THEN 'only_in_table' WHEN l.doc_id IS NULL THEN 'only_in_files' WHEN (d.n_chars > 1000) <> (l.quality = 1) THEN 'method_differs' ELSE 'same' END AS issue,
    CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND (d.n_chars > 1000) = (l.quality = 1) THEN 'none' WHEN l.doc_id IS NULL THEN 'warning' ELSE 'error' END AS severity, count(*) AS n
    FROM documents AS d FULL JOIN labels AS l ON d.doc_id = l.doc_id GROUP BY 1, 2""")
def dq_reconcile(spark, sf_dir):
    """Files against table rows: missing on one side, or different in a field."""
    files = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("a"), F.lit(True).alias("f"))
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("b"), F.lit(True).alias("t"))
    issue = F.when(F.col("f").isNull(), "only_in_table").when(F.col("t").isNull(), "only_in_files").when(F.col("a") != F.col("b"), "method_differs").otherwise("same")
    severity = F.when(F.col("t").isNull(), "warning").when(F.col("f").isNull() | (F.col("a") != F.col("b")), "error").otherwise("none")
    return files.join(rows, "doc_id", "full").groupBy(issue.alias("issue"), severity.alias("severity")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id % 4 AS version, event_type AS metric, avg(value) AS v FROM events GROUP BY ALL)
    SELECT metric, arg_max(version, v) AS best_version, round(max(v), 6) AS best, round(max(v) - min(v), 6) AS spread FROM r GROUP BY metric""")
def ir_versions(spark, sf_dir):
    """The best of several runs by metric, and how far they lie apart."""
    means = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("version"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("v"))
    return means.groupBy("metric").agg(F.max_by("version", "v").alias("best_version"), F.round(F.max("v"), 6).alias("best"), F.round(F.max("v") - F.min("v"), 6).alias("spread"))


GOLD = """id string, query string, difficulty string, intent string, category string, ground_truth struct<verification_sql:string, expected_report_ids:array<string>,
    relevance_signals:array<string>, primary_sections:array<string>, min_relevant_reports:int>"""


#: Largest file of gold queries.
GOLD_BYTES = 16 << 20


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold queries of a YAML file on any file system that Spark reads. The tree is parsed on the
    driver, so a file of over ``GOLD_BYTES`` is refused before its content is read."""
    import json

    import yaml

    file = spark.read.format("binaryFile").load(path)
    if (size := file.agg(F.sum("length")).first()[0] or 0) > GOLD_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than {GOLD_BYTES}")
    found = yaml.safe_load(file.select("content").first().content.decode("utf-8"))
    rows = found["queries"] if isinstance(found, dict) else found
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string").select(F.from_json("raw", GOLD).alias("x")).select("x.*")


def gold_issues(gold: DataFrame) -> DataFrame:
    """(id, issue) of gold queries that cannot be evaluated."""
    truth = F.col("ground_truth")
    nothing = (F.coalesce(F.size(truth["expected_report_ids"]), F.lit(0)) <= 0) & (F.coalesce(F.size(truth["relevance_signals"]), F.lit(0)) <= 0) & (F.coalesce(F.size(truth["primary_sections"]), F.lit(0)) <= 0)
    checks = {
        "missing id": F.col("id").isNull(), "missing query": F.coalesce(F.trim("query"), F.lit("")) == "",
        "unknown difficulty": ~F.coalesce(F.col("difficulty").isin("easy", "medium", "hard"), F.lit(False)), "no ground truth": truth.isNull() | nothing,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return gold.select("id", F.explode(found).alias("issue"))


def write_collection(vectors: DataFrame, path: str, key: str) -> int:
    """Replace a vector collection (one row a key) and check that all keys arrived."""
    write_parquet(vectors.dropDuplicates([key]), path)
    there, sent = vectors.sparkSession.read.parquet(path).count(), vectors.select(key).distinct().count()
    if there != sent:
        raise ValueError(f"{sent} keys sent, {there} stored")
    return there


def enrich_collection(collection: DataFrame, arrays: DataFrame, key: str) -> DataFrame:
    """Arrays put into a collection by key; keys without any get empty ones."""
    out = collection.join(arrays, key, "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(arrays.schema[c].dataType)) for c in arrays.columns if c != key})


#: Fields that a page document must have, at the top and nested.
PAGE_FIELDS = ("report_id", "page_number", "extraction_method", "extraction_pass", "text", "quality_metrics", "metadata")
QUALITY_FIELDS = ("char_count", "alphabetic_ratio", "garbage_ratio", "word_count", "passes_threshold")
METADATA_FIELDS = ("extracted_at", "extraction_time_ms", "pdf_source")
CONFIDENCE_FIELDS = ("mean_confidence", "min_confidence", "max_confidence", "low_confidence_words", "total_words")


def page_issues(pages: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, severity, issue) of page documents given as JSON text. The first error ends the
    tests of a page, in the order: not JSON, a field missing, a quality field missing, no
    confidence for recognised text, a confidence field missing. Each missing metadata field
    is a warning, unless an earlier field is missing."""
    part = lambda name: F.get_json_object(raw, f"$.{name}")
    lacking = lambda keys, fields: F.filter(F.array(*[F.lit(f) for f in fields]), lambda f: ~F.coalesce(F.array_contains(keys, f), F.lit(False)))
    tests = pages.select(
        F.col(key), F.json_object_keys(raw).isNull().alias("broken"), lacking(F.json_object_keys(raw), PAGE_FIELDS).alias("top"),
        lacking(F.json_object_keys(part("quality_metrics")), QUALITY_FIELDS).alias("quality"), lacking(F.json_object_keys(part("metadata")), METADATA_FIELDS).alias("metadata"),
        (part("extraction_method") == "ocr").alias("ocr"), part("ocr_confidence").isNull().alias("unsure"), lacking(F.json_object_keys(part("ocr_confidence")), CONFIDENCE_FIELDS).alias("confidence"),
    )
    first = lambda c, text: F.when(F.size(c) > 0, F.concat(F.lit(text), F.get(c, F.lit(0))))
    ocr = F.coalesce("ocr", F.lit(False))
    early = F.coalesce(F.when(F.col("broken"), "invalid JSON"), first(F.col("top"), "missing field: "), first(F.col("quality"), "missing quality_metrics field: "))
    late = F.when(ocr, F.coalesce(F.when(F.col("unsure"), "missing ocr_confidence"), first(F.col("confidence"), "missing ocr_confidence field: ")))
    issue = lambda severity, text: F.struct(F.lit(severity).alias("severity"), text.alias("issue"))
    warnings = F.transform("metadata", lambda f: issue("WARNING", F.concat(F.lit("missing metadata field: "), f)))
    none = F.slice(warnings, 1, 0)
    found = F.concat(
        F.when(early.isNotNull(), F.array(issue("ERROR", early))).otherwise(none), F.when(early.isNull(), warnings).otherwise(none),
        F.when(early.isNull() & late.isNotNull(), F.array(issue("ERROR", late))).otherwise(none),
    )
    return tests.select(key, F.explode(found).alias("x")).select(key, "x.severity", "x.issue")


@query("""WITH p AS (SELECT doc_id, doc_id % 3 = 0 AS ocr, doc_id % 5 = 1 AS no_pass, doc_id % 7 = 2 AS no_words, doc_id % 4 = 3 AS no_source, CASE WHEN doc_id % 6 = 0 THEN 0 WHEN doc_id % 6 = 3 THEN 1 ELSE 2 END AS sure, doc_id % 11 = 0 AS broken FROM documents),
    e AS (SELECT *, CASE WHEN broken THEN 'invalid JSON' WHEN no_pass THEN 'missing field: extraction_pass' WHEN no_words THEN 'missing quality_metrics field: word_count' END AS early FROM p)
    SELECT doc_id, 'ERROR' AS severity, early AS issue FROM e WHERE early IS NOT NULL UNION ALL SELECT doc_id, 'WARNING', 'missing metadata field: pdf_source' FROM e WHERE early IS NULL AND no_source
    UNION ALL SELECT doc_id, 'ERROR', CASE WHEN sure = 0 THEN 'missing ocr_confidence' ELSE 'missing ocr_confidence field: total_words' END FROM e WHERE early IS NULL AND ocr AND sure < 2""")
def dq_page_schema(spark, sf_dir):
    """Documents as page documents, some of them faulty, and what is wrong with these."""
    lit, d = F.lit, F.col("doc_id")
    without = lambda cond, names: F.when(cond, lit(None)).otherwise(names)
    sure = F.struct(*[lit(50).alias(f) for f in CONFIDENCE_FIELDS[:4]], F.when(d % 6 != 3, 10).alias("total_words"))
    body = F.to_json(F.struct(
        F.coalesce("source", lit("")).alias("report_id"), d.alias("page_number"), F.when(d % 3 == 0, "ocr").otherwise("embedded").alias("extraction_method"), without(d % 5 == 1, lit(1)).alias("extraction_pass"),
        F.coalesce("text", lit("")).alias("text"),
        F.struct(*[lit(1).alias(f) for f in QUALITY_FIELDS if f != "word_count"], without(d % 7 == 2, lit(1)).alias("word_count")).alias("quality_metrics"),
        F.struct(lit("now").alias("extracted_at"), lit(3).alias("extraction_time_ms"), without(d % 4 == 3, lit("x.pdf")).alias("pdf_source")).alias("metadata"),
        F.when(d % 6 != 0, sure).alias("ocr_confidence"),
    ))
    raw = F.when(d % 11 == 0, F.concat(lit("x"), body)).otherwise(body)
    return page_issues(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw")


def exists(df: DataFrame, where: Column) -> DataFrame:
    """One row: whether any row meets a condition; the scan ends at the first."""
    return df.where(where).limit(1).agg((F.count("*") > 0).alias("found"))


@query("SELECT count(*) > 0 AS found FROM (SELECT 1 FROM documents WHERE lang IS NOT NULL AND lang <> '' LIMIT 1)")
def dq_exists(spark, sf_dir):
    return exists(table(spark, sf_dir, "documents"), F.col("lang").isNotNull() & (F.col("lang") != ""))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 17 LIMIT 1")
def scan_point_lookup(spark, sf_dir):
    """One document by its id; the filter reaches the scan."""
    return table(spark, sf_dir, "documents").where("doc_id = 17").limit(1).select("doc_id", "lang", "n_chars")


@query("""SELECT doc_id, yy, CASE WHEN yy GLOB '[6-9][0-9]' THEN '19' || yy WHEN yy GLOB '[0-5][0-9]' THEN '20' || yy ELSE '2099' END AS year
    FROM (SELECT doc_id, substr('AIR' || lpad((doc_id % 130)::VARCHAR, 2, '0'), 4, 2) AS yy FROM documents) ORDER BY year, doc_id""")
def rep_century_order(spark, sf_dir):
    """Two digits of a name as a year, and rows in that order."""
    yy = F.substr(F.concat(F.lit("AIR"), F.lpad((F.col("doc_id") % 130).cast("string"), 2, "0")), F.lit(4), F.lit(2))
    rows = table(spark, sf_dir, "documents").select("doc_id", yy.alias("yy"))
    return rows.withColumn("year", century(F.col("yy"))).orderBy("year", "doc_id")


def century(digits: Column) -> Column:
    """60 to 99 as 19xx, 00 to 59 as 20xx, anything else as 2099."""
    return F.when(digits.rlike("^[6-9][0-9]$"), F.concat(F.lit("19"), digits)).when(digits.rlike("^[0-5][0-9]$"), F.concat(F.lit("20"), digits)).otherwise("2099")


@query("""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '-5'), doc_id) AS n FROM (SELECT doc_id, coalesce(lang, '') AS lang FROM documents)),
    q AS (SELECT *, n > greatest(1, 40 // (SELECT count(DISTINCT lang) FROM h)) AS late FROM h WHERE n <= 40) SELECT doc_id, lang FROM q ORDER BY late, md5(doc_id || '-5'), doc_id LIMIT 40""")
def smp_top_up(spark, sf_dir):
    """40 documents: a quota of each language, filled up from the rest."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return stratified_sample(rows, "lang", "doc_id", 40, "5")
