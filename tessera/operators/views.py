"""Summary views over chunks, pages and dated reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import letters, share, token_estimate
from tessera.plans.registry import query
from tessera.sources.tables import table


def chunks_of(docs: DataFrame) -> DataFrame:
    """The provided documents in the role of chunks."""
    return docs.select("doc_id", "text", F.col("source").alias("report_id"), F.col("lang").alias("section_name"), token_estimate(F.col("n_chars")).alias("token_count"))


CHUNKS = "(SELECT doc_id, text, source AS report_id, lang AS section_name, greatest(1, n_chars // 4)::BIGINT AS token_count FROM documents)"


def counts_with_share(df: DataFrame, key: Column, **sums: Column) -> DataFrame:
    """Rows a key with their percentage of all rows, and sums; one pass over the rows."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    return counted.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def token_bucket(tokens: Column, low: int, high: int, names: tuple[str, str, str]) -> Column:
    return F.when(tokens < low, names[0]).when(tokens <= high, names[1]).otherwise(names[2])


#: Three bucketings that reports use side by side.
BUCKETS = {
    "view": (500, 700, ("under_500", "500-700", "over_700")),
    "docs": (400, 800, ("under_400", "400-800", "over_800")),
}
REPORT_BUCKETS = ((500, "under_500"), (600, "500-600"), (700, "600-700"))


@query(f"""SELECT (SELECT count(*) FROM conversations) AS total_pages, (SELECT count(DISTINCT conv_id) FROM conversations) AS total_documents,
    count(*) AS total_chunks, sum(token_count)::BIGINT AS total_tokens, round(avg(token_count), 1) AS avg_tokens_per_chunk FROM {CHUNKS}""")
def v_data_summary(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").agg(F.count("*").alias("total_pages"), F.countDistinct("conv_id").alias("total_documents"))
    chunks = chunks_of(table(spark, sf_dir, "documents")).agg(
        F.count("*").alias("total_chunks"), F.sum("token_count").alias("total_tokens"), F.round(F.avg("token_count"), 1).alias("avg_tokens_per_chunk")
    )
    one = F.lit(1).alias("one")  # two one-row frames
    return pages.select("*", one).join(chunks.select("*", one), "one").drop("one")


@query(r"""SELECT lang AS source, count(*) AS page_count, round(avg(n_chars), 0)::INTEGER AS avg_chars,
    round(avg(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\pL]', '', 'g'))::DOUBLE / length(text) ELSE 0 END), 3) AS avg_alpha_ratio
    FROM documents GROUP BY lang""")
def v_extraction_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ratio = share(letters(F.col("text")), F.length("text"))
    return docs.groupBy(F.col("lang").alias("source")).agg(
        F.count("*").alias("page_count"), F.round(F.avg("n_chars"), 0).cast("int").alias("avg_chars"), F.round(F.avg(ratio), 3).alias("avg_alpha_ratio")
    )


@query(f"""SELECT coalesce(section_name, 'NO_SECTION') AS section_name, count(*) AS chunk_count, round(avg(token_count), 0)::INTEGER AS avg_tokens,
    sum(token_count)::BIGINT AS total_tokens FROM {CHUNKS} AS c GROUP BY c.section_name""")
def v_chunks_by_section(spark, sf_dir):
    chunks = chunks_of(table(spark, sf_dir, "documents"))
    found = chunks.groupBy("section_name").agg(
        F.count("*").alias("chunk_count"), F.round(F.avg("token_count"), 0).cast("int").alias("avg_tokens"), F.sum("token_count").alias("total_tokens")
    )
    return found.withColumn("section_name", F.coalesce("section_name", F.lit("NO_SECTION"))).orderBy(F.desc("chunk_count"), "section_name")


@query(f"""WITH c AS (SELECT unnest([
      {{'scheme': 'view', 'bucket': CASE WHEN token_count < 500 THEN 'under_500' WHEN token_count <= 700 THEN '500-700' ELSE 'over_700' END}},
      {{'scheme': 'docs', 'bucket': CASE WHEN token_count < 400 THEN 'under_400' WHEN token_count <= 800 THEN '400-800' ELSE 'over_800' END}},
      {{'scheme': 'report', 'bucket': CASE WHEN token_count < 500 THEN 'under_500' WHEN token_count <= 600 THEN '500-600' WHEN token_count <= 700 THEN '600-700' ELSE 'over_700' END}}
    ]) AS x FROM {CHUNKS})
    SELECT x.scheme AS scheme, x.bucket AS bucket, count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY x.scheme), 1) AS pct FROM c GROUP BY 1, 2""")
def v_token_distribution(spark, sf_dir):
    tokens = F.col("token_count")
    report = F.lit("over_700")
    for most, label in reversed(REPORT_BUCKETS):
        report = F.when(tokens <= most if most != 500 else tokens < most, label).otherwise(report)
    schemes = [F.struct(F.lit(k).alias("scheme"), token_bucket(tokens, *v).alias("bucket")) for k, v in BUCKETS.items()]
    schemes.append(F.struct(F.lit("report").alias("scheme"), report.alias("bucket")))
    rows = chunks_of(table(spark, sf_dir, "documents")).select(F.inline(F.array(*schemes)))
    counted = rows.groupBy("scheme", "bucket").agg(F.count("*").alias("count"))
    return counted.withColumn("pct", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("scheme")), 1))


@query(f"""SELECT report_id, count(*) AS chunk_count, sum(token_count)::BIGINT AS total_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens
    FROM {CHUNKS} GROUP BY report_id""")
def v_chunks_per_report(spark, sf_dir):
    t = "token_count"
    found = chunks_of(table(spark, sf_dir, "documents")).groupBy("report_id")
    return found.agg(F.count("*").alias("chunk_count"), F.sum(t).alias("total_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"))


@query("SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM events GROUP BY event_type")
def v_share_by_method(spark, sf_dir):
    return counts_with_share(table(spark, sf_dir, "events"), F.col("event_type"))


@query(f"""SELECT section_name, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct, sum(token_count)::BIGINT AS total_tokens
    FROM {CHUNKS} GROUP BY section_name""")
def v_share_by_source(spark, sf_dir):
    return counts_with_share(chunks_of(table(spark, sf_dir, "documents")), F.col("section_name"), total_tokens=F.col("token_count"))


@query(f"SELECT c.*, l.quality, l.toxic FROM {CHUNKS} AS c JOIN labels AS l USING (doc_id)")
def v_chunks_enriched(spark, sf_dir):
    chunks = chunks_of(table(spark, sf_dir, "documents"))
    return chunks.join(table(spark, sf_dir, "labels"), "doc_id").select(*chunks.columns, "quality", "toxic")


def timeline(facts: DataFrame, dated: DataFrame, key: str, fact_key: str, date: str, amount: str, bucket) -> DataFrame:
    """Distinct dated entities, their facts and amounts by bucket of the date. Facts are
    summed by entity before the join, so the entities are counted without a distinct."""
    by_key = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias("facts"), F.sum(amount).alias("amount"))
    dated = dated.where(F.col(date).isNotNull()).groupBy(key).agg(F.min(date).alias(date))
    return by_key.join(dated, key).groupBy(bucket(F.year(F.col(date).cast("date")))).agg(
        F.count("*").alias("reports"), F.sum("facts").alias("chunks"), F.sum("amount").cast("bigint").alias("total_tokens")
    )


TIMELINE = """SELECT {bucket} AS {name}, count(DISTINCT l_orderkey) AS reports, count(*) AS chunks, sum(l_quantity)::BIGINT AS total_tokens
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate IS NOT NULL GROUP BY 1"""


@query(TIMELINE.format(bucket="EXTRACT(YEAR FROM o_orderdate)::INTEGER", name="year"))
def v_timeline_year(spark, sf_dir):
    return timeline(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), "o_orderkey", "l_orderkey", "o_orderdate", "l_quantity", lambda y: y.alias("year"))


@query(TIMELINE.format(bucket="EXTRACT(YEAR FROM o_orderdate)::INTEGER // 10 * 10", name="decade"))
def v_timeline_decade(spark, sf_dir):
    decade = lambda y: (F.floor(y / 10) * 10).cast("int").alias("decade")
    return timeline(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), "o_orderkey", "l_orderkey", "o_orderdate", "l_quantity", decade)
