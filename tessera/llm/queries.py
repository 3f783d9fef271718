"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.common import table
from tessera.llm.decontaminate import contaminated
from tessera.llm.language_id import identify, train
from tessera.llm.licenses import license_scan
from tessera.llm.line_dedup import line_report
from tessera.llm.media import media_features, to_media
from tessera.llm.merkle import SQL as MERKLE_SQL
from tessera.llm.merkle import manifest
from tessera.llm.packing import pack
from tessera.llm.simhash import near_duplicates
from tessera.llm.suffix_dedup import dedup_report
from tessera.llm.token_counts import token_counts
from tessera.llm.url_filters import SQL as URL_SQL
from tessera.llm.url_filters import judge_urls
from tessera.llm.whitening import whitened

TOKENIZER = "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def id_crc32(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc32() % 4 == 2, F.lit(False))
    found = identify(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_crc32() % 5 == 0, F.lit(False))
    weights = quality.train(docs, quality.sample(labels.where(~held_out), F.col("quality")))
    return quality.quality_scores(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_suffix_dedup, op2_url_filters, op3_media_columns, op4_language_id, op5_license_scans, op6_quality_classifier, op7_packing,
    op8_decontamination, op9_simhash_near_dedup, op10_token_counts, op11_line_dedup, op12_merkle_manifest, op13_embedding_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": URL_SQL, "op12_merkle_manifest": MERKLE_SQL}
