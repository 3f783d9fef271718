"""Lookups, ledgers, small maps and text helpers around the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.assemble import BOUNDARIES, page_starts
from tessera.operators.percentiles import exact_percentiles
from tessera.operators.vectors import ASSIGNED, TOP_REPORT, level_one, level_one_score, roll_up
from tessera.plans.registry import query
from tessera.sources.tables import table


def read_run(spark: SparkSession, path: str, run_id: int) -> DataFrame | None:
    """The rows of one run in a table partitioned by run, or None if it was never written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run_id}")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id")


@query("""SELECT user_id AS run_id, arg_max(event_type, event_id) AS status, min(ts) AS started_at, max(ts) FILTER (WHERE event_type = 'purchase') AS completed_at, count(*) AS n_events FROM events GROUP BY user_id""")
def run_latest_state(spark, sf_dir):
    """Runs as their events tell: the last state, the start, and the end if there is one."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.max_by("event_type", "event_id").alias("status"), F.min("ts").alias("started_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("completed_at"), F.count("*").alias("n_events"),
    )


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 1")
def run_latest_of_kind(spark, sf_dir):
    """The newest run of a kind: a top one, no full sort."""
    return table(spark, sf_dir, "events").where("event_type = 'click'").orderBy(F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) ORDER BY l_linenumber")
def scan_one_entity_ordered(spark, sf_dir):
    """All rows of one entity in their order, by a bound parameter."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    first = rows.agg(F.min("l_orderkey")).first()[0]
    return spark.sql("SELECT * FROM {rows} WHERE l_orderkey = :key ORDER BY l_linenumber", args={"key": first}, rows=rows)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '1997-06-30' AND o_orderpriority LIKE '1-%T'")
def filter_text_date(spark, sf_dir):
    """ISO dates compare as text; LIKE on a name."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").where((iso > "1997-06-30") & F.col("o_orderpriority").like("1-%T")).select("o_orderkey", "o_totalprice")


@query("""SELECT decision AS level, count(*) AS reviewed, count(*) FILTER (WHERE value >= 50) AS approved, round(100.0::DOUBLE * count(*) FILTER (WHERE value >= 50) / count(*), 1) AS precision_pct
    FROM (SELECT upper(event_type) AS decision, value FROM events WHERE event_type IS NOT NULL AND event_type <> '') GROUP BY decision""")
def review_precision(spark, sf_dir):
    """Approved share of reviewed rows by level; rows without a decision don't count."""
    rows = table(spark, sf_dir, "events").where("event_type is not null and event_type <> ''").groupBy(F.upper("event_type").alias("level"))
    approved = F.count_if(F.col("value") >= 50)
    return rows.agg(F.count("*").alias("reviewed"), approved.alias("approved"), F.round(100.0 * approved / F.count("*"), 1).alias("precision_pct"))


def with_names(rows: DataFrame, code: str, names: dict[str, str], out: str) -> DataFrame:
    """Names of codes from a map that is part of the plan; unknown codes name themselves."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.withColumn(out, F.coalesce(F.try_element_at(known, F.col(code)), F.col(code)))


@query("""SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS name, count(*) AS n FROM orders GROUP BY o_orderstatus""")
def dim_code_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return with_names(rows, "o_orderstatus", {"F": "finished", "O": "open"}, "name")


@query("""SELECT o_custkey, count(*) AS n, string_agg(o_orderstatus || ':' || c, ',' ORDER BY o_orderstatus) AS states, sum(c) FILTER (WHERE o_orderstatus = 'F') AS finished
    FROM (SELECT o_custkey, o_orderstatus, count(*) AS c FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def rep_states_by_key(spark, sf_dir):
    """States of each key in one row: counted first, so a list has one entry a state."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("c"))
    shown = F.transform(F.sort_array(F.collect_list(F.struct("o_orderstatus", "c"))), lambda x: F.concat_ws(":", x["o_orderstatus"], x["c"].cast("string")))
    return counts.groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(shown, ",").alias("states"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("c"))).alias("finished"))


@query(f"""WITH g AS (SELECT vec_id % 50 AS report_id, category::BIGINT AS category, avg(similarity) AS a, max(similarity) AS m, count(*) AS n FROM {ASSIGNED} GROUP BY 1, 2),
    s AS (SELECT *, 0.4::DOUBLE * a + 0.4::DOUBLE * m + 0.2::DOUBLE * least(n / 5.0::DOUBLE, 1) AS score FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY round(score, 9) DESC, category) AS rank FROM s),
    p AS (SELECT *, round_even(100.0::DOUBLE * score / sum(score) OVER (PARTITION BY report_id), 1) AS pct FROM r WHERE rank <= {TOP_REPORT})
    SELECT category, count(*) AS reports, round(avg(pct), 4) AS mean_pct FROM p GROUP BY category""")
def vec_category_distribution(spark, sf_dir):
    """How many reports have a category, and its mean share."""
    rows = roll_up(level_one(spark, sf_dir).withColumn("report_id", F.col("vec_id") % 50), "report_id", "category", level_one_score(), TOP_REPORT)
    return rows.groupBy("category").agg(F.count("*").alias("reports"), F.round(F.avg("pct_contribution"), 4).alias("mean_pct"))


@query("""SELECT coalesce(source, 'unknown') AS source, count(*) AS documents, sum(greatest(1, n_chars // 4))::BIGINT AS tokens, count(*) FILTER (WHERE lang = 'en') AS english,
    CASE WHEN count(*) FILTER (WHERE lang = 'en') = 0 THEN 'other' WHEN count(*) FILTER (WHERE lang = 'en') = count(*) THEN 'en' ELSE 'mixed' END AS label FROM documents GROUP BY 1""")
def rep_counters(spark, sf_dir):
    """Counters by source, and the label of what a source holds."""
    english, n = F.count_if(F.col("lang") == "en"), F.count("*")
    tokens = F.sum(F.greatest(F.lit(1).cast("bigint"), F.expr("n_chars div 4")))
    label = F.when(english == 0, "other").when(english == n, "en").otherwise("mixed")
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(n.alias("documents"), tokens.alias("tokens"), english.alias("english"), label.alias("label"))


@query("""SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type""")
def stat_percentiles(spark, sf_dir):
    """Exact percentiles, of groups of any size."""
    found = exact_percentiles(table(spark, sf_dir, "events"), {"event_type": "event_type"}, "value", {"p95": 0.95, "low": 0.025, "high": 0.975})
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("p95", "low", "high")])


@query("""SELECT year, doc_id FROM (SELECT (n_chars // 1000) % 10 AS year, doc_id, row_number() OVER (PARTITION BY (n_chars // 1000) % 10 ORDER BY md5(doc_id || '-9'), doc_id) AS n FROM documents) WHERE n <= 4""")
def smp_per_group(spark, sf_dir):
    """Up to four rows a group in the order of a seeded hash; partitions pass on four at most."""
    rows = table(spark, sf_dir, "documents").select(F.expr("(n_chars div 1000) % 10").alias("year"), "doc_id")
    w = Window.partitionBy("year").orderBy(F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit("9"))), "doc_id")
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 4").drop("n")


@query("""SELECT 'embeddings' AS collection, (SELECT count(*) FROM embeddings) AS stored, (SELECT count(DISTINCT vec_id) FROM embeddings) AS keys, (SELECT count(*) FROM documents) AS expected,
    (SELECT count(*) FROM embeddings) = (SELECT count(DISTINCT vec_id) FROM embeddings) AS unique_keys, (SELECT count(*) FROM embeddings) >= (SELECT count(*) FROM documents) AS complete""")
def dq_vector_counts(spark, sf_dir):
    """Stored vectors against their keys and what should be there."""
    stored = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("stored"), F.countDistinct("vec_id").alias("keys"))
    both = stored.crossJoin(table(spark, sf_dir, "documents").agg(F.count("*").alias("expected")))  # one row each
    return both.select(F.lit("embeddings").alias("collection"), "stored", "keys", "expected", (F.col("stored") == F.col("keys")).alias("unique_keys"), (F.col("stored") >= F.col("expected")).alias("complete"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS empty_texts, count(*) FILTER (WHERE abs(length(text) // 4 - n_chars // 4) > n_chars // 8) AS odd_counts,
    round(100.0::DOUBLE * count(*) FILTER (WHERE n_chars // 4 BETWEEN 500 AND 700) / count(*), 2) AS pct_500_700, count(*) FILTER (WHERE source IS NULL) AS no_source FROM documents""")
def dq_document_summary(spark, sf_dir):
    """Empty texts, counts that don't fit, and the share of usual lengths, in one pass."""
    tokens = F.expr("n_chars div 4")
    odd = F.abs(F.expr("length(text) div 4") - tokens) > F.expr("n_chars div 8")
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty_texts"), F.count_if(odd).alias("odd_counts"),
        F.round(100.0 * F.count_if(tokens.between(500, 700)) / F.count("*"), 2).alias("pct_500_700"), F.count_if(F.col("source").isNull()).alias("no_source"),
    )


@query("SELECT doc_id, sha256(text) AS digest, strpos(lower(text), 'the') AS first_the, substr(text, 11, 20) AS slice, lpad((doc_id % 10000)::VARCHAR, 4, '0') AS code FROM documents")
def txt_digests(spark, sf_dir):
    """Hashes, positions, slices and padded numbers of texts."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        "doc_id", F.sha2("text", 256).alias("digest"), F.instr(F.lower("text"), "the").cast("bigint").alias("first_the"), F.substring("text", 11, 20).alias("slice"),
        F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0").alias("code"),
    )


def fixed_chunks(rows: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, n, chunk): every ``size`` words, each beginning with the last ``overlap`` of the one
    before. Blank texts have none."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - F.lit(overlap) - 1), F.lit(step))
    found = rows.select(key, words.alias("w")).where(F.size("w") > 0).select(key, "w", F.posexplode(starts).alias("n", "at"))
    return found.select(key, F.col("n").cast("bigint").alias("n"), F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ").alias("chunk"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, E' \n\t\r'), '\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, p // 300 AS n, md5(array_to_string(w[p + 1:p + 400], ' ')) AS digest FROM w, unnest(range(0, greatest(1, len(w) - 100), 300)) AS u(p) WHERE len(w) > 0""")
def txt_fixed_chunks(spark, sf_dir):
    """Windows of 400 words that share 100 with the one before."""
    return fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 400, 100).select("doc_id", "n", F.md5("chunk").alias("digest"))


@query(f"""SELECT conv_id, turn, start, coalesce(lead(start) OVER w, stop) AS until, coalesce(lead(start) OVER w - stop, 0) AS gap, lag(role) OVER w = role AS same_role,
    row_number() OVER w - 1 AS sequence FROM ({BOUNDARIES}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def win_neighbouring_rows(spark, sf_dir):
    """Each page up to the next one's start, the gap between them, and whether the source is
    that of the one before."""
    rows = page_starts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    following = F.lead("start").over(w)
    return rows.select(
        "conv_id", "turn", "start", F.coalesce(following, "stop").alias("until"), F.coalesce(following - F.col("stop"), F.lit(0)).alias("gap"),
        (F.lag("role").over(w) == F.col("role")).alias("same_role"), (F.row_number().over(w) - 1).cast("bigint").alias("sequence"),
    )


@query("""SELECT event_id, json_extract_string(j, '$.kind') AS kind, json_extract_string(j, '$.detail.value')::DOUBLE AS value FROM (SELECT event_id,
    json_object('kind', event_type, 'detail', json_object('user', user_id, 'value', value)) AS j FROM events)""")
def json_nested_access(spark, sf_dir):
    """Records written as JSON and read back with a schema."""
    packed = F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user"), F.col("value")).alias("detail")))
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json(packed, "kind string, detail struct<user: bigint, value: double>").alias("j"))
    return rows.select("event_id", "j.kind", "j.detail.value")
