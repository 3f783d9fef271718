"""Data-quality checks, key sets, full-outer comparison, payloads, upserts and resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.tables import table, upsert


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other side lacks."""
    return left.join(right.select(key).distinct(), key, "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dq_missing(spark, sf_dir):
    return missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def dq_orphans(spark, sf_dir):
    """Customers without a pending order."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return missing(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey")


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def dq_dupes(spark, sf_dir):
    found = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return found.where("n > 1")


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys are on both sides, on the left alone and on the right alone."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matching"),
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
    )


@query("""SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS matching, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right
    FROM (SELECT DISTINCT doc_id AS k FROM documents WHERE lang = 'en') AS a FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels) AS b ON a.k = b.k""")
def dq_sets(spark, sf_dir):
    return key_sets(table(spark, sf_dir, "documents").where("lang = 'en'"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT conv_id, count(*) AS turns, max(turn) + 1 - count(*) AS gaps, min(turn) AS first_turn, count(*) - count(DISTINCT turn) AS repeats FROM conversations GROUP BY conv_id""")
def dq_sequences(spark, sf_dir):
    """Gaps, starts and repeats of numbering within each key."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return rows.agg(
        F.count("*").alias("turns"), (F.max("turn") + 1 - F.count("*")).alias("gaps"), F.min("turn").alias("first_turn"), (F.count("*") - F.countDistinct("turn")).alias("repeats")
    )


@query("""SELECT 'error' AS severity, 'empty_text' AS category, count(*) AS n FROM documents WHERE text IS NULL OR length(trim(text)) = 0
    UNION ALL SELECT 'warning', 'length_mismatch', count(*) FROM documents WHERE n_chars <> length(text)
    UNION ALL SELECT 'error', 'unknown_language', count(*) FROM documents WHERE lang NOT IN ('en', 'fr', 'de', 'es')
    UNION ALL SELECT 'error', 'missing_field', count(*) FROM documents WHERE doc_id IS NULL OR source IS NULL""")
def dq_issues(spark, sf_dir):
    """All row checks in one scan."""
    checks = {
        ("error", "empty_text"): F.col("text").isNull() | (F.length(F.trim("text")) == 0),
        ("warning", "length_mismatch"): F.col("n_chars") != F.length("text"),
        ("error", "unknown_language"): ~F.col("lang").isin("en", "fr", "de", "es"),
        ("error", "missing_field"): F.col("doc_id").isNull() | F.col("source").isNull(),
    }
    counted = table(spark, sf_dir, "documents").agg(*[F.count_if(c).alias(name) for (_, name), c in checks.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(name).alias("category"), F.col(name).alias("n")) for s, name in checks])
    return counted.select(F.inline(rows))


@query("""SELECT coalesce(d.lang, 'none') AS lang, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matching,
    count(*) FILTER (WHERE l.doc_id IS NULL) AS only_in_1, count(*) FILTER (WHERE d.doc_id IS NULL) AS only_in_2
    FROM (SELECT doc_id, lang FROM documents WHERE n_chars > 1000) AS d FULL JOIN (SELECT doc_id FROM labels WHERE quality = 1) AS l ON d.doc_id = l.doc_id GROUP BY 1""")
def cmp_full_outer(spark, sf_dir):
    """Agreement of two runs: matching rows and those of one run alone, by group."""
    one = table(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id", "lang").withColumn("one", F.lit(True))
    two = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").withColumn("two", F.lit(True))
    return one.join(two, "doc_id", "full").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(
        F.count_if(F.col("one") & F.col("two")).alias("matching"), F.count_if(F.col("two").isNull()).alias("only_in_1"), F.count_if(F.col("one").isNull()).alias("only_in_2")
    )


@query("""SELECT doc_id, coalesce(a.kinds, []::VARCHAR[]) AS kinds, coalesce(b.marks, []::VARCHAR[]) AS marks FROM
    (SELECT doc_id, list_sort(list(DISTINCT lang)) AS kinds FROM documents WHERE n_chars > 1500 GROUP BY doc_id) AS a FULL JOIN
    (SELECT doc_id, list_sort(list(DISTINCT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END)) AS marks FROM labels GROUP BY doc_id) AS b USING (doc_id)""")
def enrich_payload_arrays(spark, sf_dir):
    """Sorted arrays of several sources by key; a source without the key gives an empty one."""
    arrays = lambda df, c, name: df.groupBy("doc_id").agg(F.sort_array(F.collect_set(c)).alias(name))
    kinds = arrays(table(spark, sf_dir, "documents").where("n_chars > 1500"), F.col("lang"), "kinds")
    marks = arrays(table(spark, sf_dir, "labels"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"), "marks")
    empty = F.array().cast("array<string>")
    return kinds.join(marks, "doc_id", "full").select("doc_id", F.coalesce("kinds", empty).alias("kinds"), F.coalesce("marks", empty).alias("marks"))


@query("""SELECT user_id, coalesce(n.value, o.value) AS value, CASE WHEN o.user_id IS NULL THEN n.event_type ELSE o.event_type END AS event_type FROM
    (SELECT user_id, max(value) AS value, min(event_type) AS event_type FROM events WHERE event_id % 2 = 0 GROUP BY user_id) AS o FULL JOIN
    (SELECT user_id, max(value) AS value, max(event_type) AS event_type FROM events WHERE event_id % 2 = 1 GROUP BY user_id) AS n USING (user_id)""")
def upsert_latest(spark, sf_dir):
    """New rows put into old ones by key; one column keeps its old value."""
    events = table(spark, sf_dir, "events")
    old = events.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("value").alias("value"), F.min("event_type").alias("event_type"))
    new = events.where("event_id % 2 = 1").groupBy("user_id").agg(F.max("value").alias("value"), F.max("event_type").alias("event_type"))
    return upsert(old, new, ["user_id"], keep=["event_type"])


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def resume_anti(spark, sf_dir):
    """Work that is left: items without those done before."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return missing(events.where("event_type <> 'error'"), events.where("event_type = 'click'"), "event_id")


@query("""SELECT event_type, count(*) AS reviewed, count(*) FILTER (WHERE quality = 1) AS approved, round(100.0::DOUBLE * count(*) FILTER (WHERE quality = 1) / count(*), 2) AS precision_pct,
    count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS lift FROM labels JOIN events ON event_id = doc_id GROUP BY ROLLUP (event_type)""")
def review_tally(spark, sf_dir):
    """Judgments by query and in total, with precision."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type"), "doc_id")
    good = F.col("quality") == 1
    return rows.rollup("event_type").agg(
        F.count("*").alias("reviewed"), F.count_if(good).alias("approved"), F.round(100.0 * F.count_if(good) / F.count("*"), 2).alias("precision_pct"),
        F.count_if(good & (F.col("toxic") == 1)).alias("lift"),
    )
