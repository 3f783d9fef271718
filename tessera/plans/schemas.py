"""Tables of the pipeline: their columns, empty ones on disk, and the version of the schema."""

from __future__ import annotations

from pyspark.sql import SparkSession

VERSION = 2
#: Column types of each table.
SCHEMAS = {
    "reports": "filename string, title string, location string, accident_date string, report_date string, url string, status string, local_path string",
    "pages": "report_id string, page_number int, extraction_method string, extraction_pass string, text string, char_count int, alphabetic_ratio double, mean_confidence double, status string",
    "documents": "report_id string, full_text string, n_pages int, token_count int, primary_source string, pages array<struct<page int, start bigint, stop bigint>>",
    "chunks": "chunk_id string, report_id string, chunk_sequence int, section_name string, section_number string, page_start int, page_end int, char_start bigint, char_end bigint, token_count int, chunk_text string",
    "runs": "run_id string, run_type string, status string, at timestamp, detail map<string, string>",
    "errors": "run_id string, item string, error_type string, message string, at timestamp",
}


def create_tables(spark: SparkSession, root: str) -> list[str]:
    """Write each table that is missing, empty, and the schema's version; tables that are there
    stay. Returns the names of those made."""
    made = []
    for name, kinds in SCHEMAS.items():
        if not _there(spark, f"{root}/{name}"):
            spark.createDataFrame([], kinds).write.parquet(f"{root}/{name}")
            made.append(name)
    if schema_version(spark, root) != VERSION:
        spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{root}/schema_version")
    return made


def schema_version(spark: SparkSession, root: str) -> int:
    """The version that tables were made with, 0 if there are none."""
    return spark.read.parquet(f"{root}/schema_version").first().version if _there(spark, f"{root}/schema_version") else 0


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
