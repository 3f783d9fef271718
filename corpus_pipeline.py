"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. Between stages the table is written to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, unused, written
from tessera.llm.decontaminate import contaminated
from tessera.llm.language_id import keep_identified, train
from tessera.llm.packing import pack
from tessera.llm.simhash import without_near_duplicates
from tessera.llm.suffix_dedup import without_repeats

#: Documents whose language scores less are rejected, as are those without any letter.
LEAST_LANGUAGE_SCORE = 0.3
#: Words of a shingle in near-duplicate detection.
SHINGLE = 5
TOKENIZER, WINDOW, END_ID = "byte_bpe_50k.json", 1024, 0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, learned from the documents' own labels. Null and empty
    texts, and those without letters, are rejected; rows without a label are judged but not
    learned from; repeated rows are judged alike; an empty table stays empty; texts of any
    length count whole."""
    return keep_identified(docs, train(docs), LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of texts alike by 0.8 or more in five-word
    shingles. Fingerprints that meet at a Golay key give the first groups, minimum hashes what
    is too far apart for them; the shingle sets of all pairs are compared. Rows without an id stay; null, empty and blank texts are alike; rows that repeat
    id and words become one, rows of one id with unlike texts are documents of their own; an
    empty table stays empty; texts of any length count whole."""
    return without_near_duplicates(docs, SHINGLE)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat a document of smaller id; ``n_chars`` is
    set anew. Null texts become empty; rows without an id, and texts under fifty bytes, lose
    nothing; rows that repeat an id never cut each other; an empty table stays empty."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A row is told by its id and its text, so rows of
    one id, or without one, are judged each by its own text; null, empty and blank texts hold
    nothing and stay; texts are searched whole; without items, or rows, all stay as they are."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    name = unused(docs, "#key")
    keyed = docs.withColumn(name, key)
    leaks = contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=name).select(F.col(f"`{name}`")).distinct()
    return keyed.join(leaks, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as ``op7_packing`` gives them: a null or empty text is one
    end id, repeated rows are packed one by one, an empty table gives no rows."""
    return pack(docs, public_tokenizers.path(TOKENIZER), WINDOW, END_ID)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
