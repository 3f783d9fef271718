"""From files to files: a tree of page documents becomes documents, sections, chunks and a summary.

Each stage is written under the output folder and the summary is computed from what was written, so
a stage can be read, or run again, by itself. Defined cases: unreadable files and those without a
report or page number are counted in the summary and left out; pages without text, covers and
contents pages are no part of documents; an empty tree gives empty tables and a summary of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalized, skip_reason
from tessera.operators.assemble import documents_of
from tessera.operators.chunking import Counter, page_chunks, section_table, token_count
from tessera.sources.tables import read_page_tree, stored

PAGES = """report_id string, page_number bigint, extraction_method string, text string, quality_metrics struct<alphabetic_ratio: double>,
    ocr_confidence struct<mean_confidence: double>"""
STAGES = ("documents", "sections", "chunks", "summary")


def _write(df: DataFrame, path: str, kind: str) -> DataFrame:
    """Write a stage and read it back under its own schema."""
    df.write.mode("overwrite").format(kind).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).load(path)


def chunk_files(spark: SparkSession, root: str, out: str, count: Counter = token_count, kind: str = "parquet") -> DataFrame:
    """Write all STAGES for the page tree ``root`` below ``out``; returns the summary."""
    out = out.rstrip("/")
    read = read_page_tree(spark, root, PAGES)
    whole = F.col("report_id").isNotNull() & F.col("page_number").isNotNull()
    pages = stored(read.select("report_id", "page_number", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("extraction_method", F.lit("unknown")).alias("method"), F.col("quality_metrics.alphabetic_ratio").alias("share"), F.col("ocr_confidence.mean_confidence").alias("sure"), whole.alias("whole")), "pages")
    good = pages.where("whole").drop("whole")

    kept = good.where(skip_reason(F.col("text")).isNull()).withColumn("text", normalized(F.col("text")))
    docs = documents_of(kept, "report_id", "page_number", "text", "method").select("report_id", "n_pages", "primary_source", "full_text")
    docs = _write(docs, f"{out}/documents", kind)
    sections = _write(section_table(docs, "report_id", "full_text"), f"{out}/sections", kind)
    chunks = page_chunks(good, "report_id", "page_number", "text", "method", F.col("share"), F.col("sure"), count)
    chunks = _write(chunks, f"{out}/chunks", kind)

    one = F.lit(1).alias("one")
    n = F.col("token_count")
    parts = (
        pages.agg(F.count("*").alias("pages"), F.count_if(~F.col("whole")).alias("unreadable_pages"), one),
        docs.agg(F.count("*").alias("documents"), one),
        sections.agg(F.count("*").alias("sections"), one),
        chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.min(n).alias("least_tokens"), F.max(n).alias("most_tokens"), F.countDistinct("report_id").alias("chunked_documents"), one),
    )
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.join(part, "one")  # one row each
    return _write(summary.drop("one").coalesce(1), f"{out}/summary", kind)
