"""Operational reports: quality, status, runs, lists of the worst, the newest and the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import iso_date, signals_found, token_estimate
from tessera.operators.percentiles import exact_percentiles
from tessera.plans.registry import query
from tessera.sources.tables import last_by_key, table

#: Score bands: good from the first bound on, acceptable from the second, else poor.
GOOD, ACCEPTABLE = 2000, 500


def band_counts(score: Column, good: float = GOOD, acceptable: float = ACCEPTABLE) -> list[Column]:
    return [
        F.count_if(score >= good).alias("good_count"),
        F.count_if((score >= acceptable) & (score < good)).alias("acceptable_count"),
        F.count_if(score < acceptable).alias("poor_count"),
    ]


@query("""SELECT count(*) AS total_pages, count(DISTINCT source) AS total_reports, count(*) FILTER (WHERE quality = 1) AS passed_count,
    count(*) FILTER (WHERE quality = 0) AS failed_count, count(*) FILTER (WHERE lang = 'en') AS embedded_count, count(*) FILTER (WHERE lang <> 'en') AS ocr_count,
    round(avg(n_chars), 3) AS avg_chars, round(avg(CASE WHEN lang <> 'en' THEN n_chars END), 3) AS avg_other_chars,
    count(*) FILTER (WHERE n_chars >= 2000) AS good_count, count(*) FILTER (WHERE n_chars >= 500 AND n_chars < 2000) AS acceptable_count,
    count(*) FILTER (WHERE n_chars < 500) AS poor_count FROM documents LEFT JOIN labels USING (doc_id)""")
def rep_quality_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    other = F.col("lang") != "en"
    return rows.agg(
        F.count("*").alias("total_pages"), F.countDistinct("source").alias("total_reports"),
        F.count_if(F.col("quality") == 1).alias("passed_count"), F.count_if(F.col("quality") == 0).alias("failed_count"),
        F.count_if(~other).alias("embedded_count"), F.count_if(other).alias("ocr_count"),
        F.round(F.avg("n_chars"), 3).alias("avg_chars"), F.round(F.avg(F.when(other, F.col("n_chars"))), 3).alias("avg_other_chars"),
        *band_counts(F.col("n_chars")),
    )


@query("""SELECT substr(source, 4, 1) AS prefix, count(*) AS total_pages, count(*) FILTER (WHERE lang = 'en') AS embedded_count,
    round(avg(n_chars), 3) AS avg_quality FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY 1""")
def rep_by_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr", "de"))
    return rows.groupBy(F.substring("source", 4, 1).alias("prefix")).agg(
        F.count("*").alias("total_pages"), F.count_if(F.col("lang") == "en").alias("embedded_count"), F.round(F.avg("n_chars"), 3).alias("avg_quality")
    )


def lowest(df: DataFrame, score: str, below: float, tie: str, limit: int | None = 100) -> DataFrame:
    """Rows under a threshold, worst first; no limit means all."""
    out = df.where(F.col(score) < below).orderBy(F.col(score).asc_nulls_last(), tie)
    return out.limit(limit) if limit else out


@query("""SELECT doc_id, source, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE n_chars < 2000 ORDER BY n_chars NULLS LAST, doc_id LIMIT 100""")
def rep_low_confidence_topn(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return lowest(rows, "n_chars", 2000, "doc_id")


@query("SELECT coalesce(event_type, 'total') AS status, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def rep_status_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("event_type", F.lit("total")).alias("status"), "n")


@query("""SELECT event_type, user_id % 7 AS collection, count(*) AS runs, count(*) FILTER (WHERE value >= 50) AS completed, round(sum(value), 3) AS total,
    round(avg(value), 4) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1, 2""")
def rep_run_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("collection", F.col("user_id") % 7)
    keys = ["event_type", "collection"]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.count_if(F.col("value") >= 50).alias("completed"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 4).alias("mean"),
    )
    p95 = exact_percentiles(rows, {k: k for k in keys}, "value", {"p95": 0.95}).withColumnsRenamed({k: f"of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return sums.join(p95, same[0] & same[1]).select(*keys, "runs", "completed", "total", "mean", F.round("p95", 6).alias("p95"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def rep_latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id")
    return rows.agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
    string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS details FROM orders GROUP BY o_custkey""")
def rep_status_by_key(spark, sf_dir):
    detail = F.struct("o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("text"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.array_join(F.transform(F.sort_array(F.collect_list(detail)), lambda x: x["text"]), ",").alias("details"),
    )


@query("""SELECT count(*) AS documents, count(DISTINCT source) AS sources, sum(greatest(1, n_chars // 4))::BIGINT AS tokens, min(n_chars) AS least, max(n_chars) AS most,
    round(median(n_chars), 1) AS middle, count(*) FILTER (WHERE greatest(1, n_chars // 4) BETWEEN 400 AND 800) AS in_range,
    count(*) FILTER (WHERE greatest(1, n_chars // 4) < 400) AS under, count(*) FILTER (WHERE greatest(1, n_chars // 4) > 800) AS over FROM documents""")
def rep_chunk_statistics(spark, sf_dir):
    tokens = token_estimate(F.col("n_chars"))
    rows = table(spark, sf_dir, "documents").select("source", "n_chars")
    sums = rows.agg(
        F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum(tokens).alias("tokens"), F.min("n_chars").alias("least"),
        F.max("n_chars").alias("most"), F.count_if(tokens.between(400, 800)).alias("in_range"),
        F.count_if(tokens < 400).alias("under"), F.count_if(tokens > 800).alias("over"), F.lit(0).alias("one"),
    )
    middle = exact_percentiles(rows, {}, "n_chars", {"middle": 0.5}).select(F.round("middle", 1).alias("middle"), F.lit(0).alias("one"))
    return sums.join(middle, "one", "left").select("documents", "sources", "tokens", "least", "most", "middle", "in_range", "under", "over")


@query("""SELECT lang, round(avg(n_chars), 1) AS mean, count(*) AS n, count(DISTINCT source) AS reports, sum(n_chars)::BIGINT AS total FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def rep_section_statistics(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(
        F.round(F.avg("n_chars"), 1).alias("mean"), F.count("*").alias("n"), F.countDistinct("source").alias("reports"), F.sum("n_chars").alias("total")
    )


@query("""SELECT s.n AS processed, t.n - s.n AS remaining, round(100.0::DOUBLE * s.n / t.n, 1) AS pct, (t.n - s.n) * 5 AS eta_seconds
    FROM (SELECT count(DISTINCT doc_id) AS n FROM labels) AS s, (SELECT count(*) AS n FROM documents) AS t""")
def rep_progress(spark, sf_dir):
    done = table(spark, sf_dir, "labels").agg(F.countDistinct("doc_id").alias("processed"), F.lit(1).alias("one"))
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("total"), F.lit(1).alias("one"))
    left = F.col("total") - F.col("processed")
    return done.join(total, "one").select("processed", left.alias("remaining"), F.round(100.0 * F.col("processed") / F.col("total"), 1).alias("pct"), (left * 5).alias("eta_seconds"))


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 5""")
def topn_per_group(spark, sf_dir):
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 5")
    return rows.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


def first_entities(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of the first ``n`` keys in order."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 25)""")
def limit_by_entity(spark, sf_dir):
    return first_entities(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", 25)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "7") -> DataFrame:
    """At most ``n`` rows: n // strata of each stratum (one at least), filled up from the
    rest, all in the order of a seeded hash of the key. Only rows that can be chosen leave
    a partition: the first n of each stratum."""
    order = [F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed))), F.col(key)]
    w = Window.partitionBy(stratum).orderBy(*order)
    first = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    strata = F.size(F.collect_set(F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))).over(Window.partitionBy()))
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / strata))
    return first.withColumn("__late", F.col("__n") > quota).orderBy("__late", *order).limit(n).drop("__n", "__late")


@query("""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '-7'), doc_id) AS n FROM documents),
    q AS (SELECT *, n > greatest(1, 100 // (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM documents)) AS late FROM h WHERE n <= 100)
    SELECT doc_id, lang FROM q ORDER BY late, md5(doc_id || '-7'), doc_id LIMIT 100""")
def stratified_sample_hash(spark, sf_dir):
    return stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 100)


@query("""SELECT p_partkey, p_type, p_size FROM part WHERE regexp_matches(upper(p_type), 'STANDARD|ECONOMY|LARGE') AND NOT regexp_matches(upper(p_type), 'MY$') AND p_size >= 10""")
def filter_include_exclude(spark, sf_dir):
    kind = F.upper("p_type")
    keep = F.coalesce(kind.rlike("STANDARD|ECONOMY|LARGE"), F.lit(False)) & ~F.coalesce(kind.rlike("MY$"), F.lit(False))
    return table(spark, sf_dir, "part").where(keep & (F.col("p_size") >= 10)).select("p_partkey", "p_type", "p_size")


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%license%' OR (lower(text) LIKE '%mail%' AND lower(text) LIKE '%token%')")
def search_ilike(spark, sf_dir):
    low = F.lower("text")
    hit = F.col("text").ilike("%license%") | (low.like("%mail%") & low.like("%token%"))
    return table(spark, sf_dir, "documents").where(hit).select("doc_id", "lang")


SIGNALS = ["license", "mail", "token", "http", "password"]


@query(f"""SELECT doc_id FROM documents WHERE {' + '.join(f"(contains(lower(text), '{s}'))::INTEGER" for s in SIGNALS)} >= 2""")
def search_signals(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(signals_found(F.col("text"), SIGNALS)).select("doc_id")


LIKE_TREE = "SELECT 1 FROM t WHERE body LIKE '%the%' AND (body LIKE '%token%' OR body LIKE '%mail%') OR body LIKE '%licensed%'"


def like_literals(sql: str) -> list[str]:
    """The words that a predicate looks for."""
    import re

    return [x.lower() for x in re.findall(r"LIKE\s+'%([^%']+)%'", sql, re.IGNORECASE)]


@query("""SELECT doc_id, hits FROM (SELECT doc_id, contains(lower(text), 'the')::INTEGER + contains(lower(text), 'token')::INTEGER + contains(lower(text), 'mail')::INTEGER
    + contains(lower(text), 'licensed')::INTEGER AS hits FROM documents) WHERE hits >= 2""")
def search_like_tree(spark, sf_dir):
    """Judged relevant if at least half of the literals of the query's predicate occur."""
    words = like_literals(LIKE_TREE)
    hits = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits")).where(F.col("hits") >= (len(words) + 1) // 2)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, (EXTRACT(YEAR FROM o_orderdate)::INTEGER // 10) * 10 AS decade FROM orders""")
def date_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("raw"))
    iso = iso_date(F.col("raw"))
    return rows.select("o_orderkey", iso.alias("iso"), (F.floor(F.year(iso.try_cast("date")) / 10) * 10).cast("int").alias("decade"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
    len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages""")
def html_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    part = lambda c, p: F.regexp_extract(c, p, 1)
    return rows.select(
        "page_id", part("html", "<title>([^<]*)</title>").alias("title"), F.nullif(part("html", '<html lang="([^"]*)"'), F.lit("")).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("bigint").alias("links"), part("url", "^[a-z]+://([^/]+)").alias("host"),
    )


@query("""SELECT doc_id, text AS chosen FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, doc_id) AS n
    FROM documents) WHERE n = 1""")
def dedupe_prefer(spark, sf_dir):
    """One row of each text, by preference of language, then id."""
    preference = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.col("text").alias("chosen"), preference.alias("preference"))
    return last_by_key(rows, ["digest"], F.col("preference"), F.col("doc_id")).select("doc_id", "chosen")
