"""Sources and sinks: Parquet, JSON lines, CSV, page JSON trees, HTML, keyed upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import delete_at_exit, shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, bad: str = "_corrupt_record") -> DataFrame:
    """JSON lines; unreadable ones are kept in column ``bad``, blank ones skipped."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if bad not in kind.names:
        kind = StructType([*kind.fields]).add(bad, "string")
    return spark.read.schema(kind).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)


def good_rows(df: DataFrame, bad: str = "_corrupt_record") -> DataFrame:
    return df.where(F.col(bad).isNull()).drop(bad)


def read_page_tree(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """A tree of JSON documents, one a file, with the file each came from."""
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    return read.option("pathGlobFilter", "*.json").json(root).withColumn("file", F.col("_metadata.file_path"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The last path, by name, that a glob matches on any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((f.getPath().toString() for f in found or []), default=None)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_run(df: DataFrame, path: str, run_id: int) -> None:
    """Replace one run's rows in a table partitioned by run_id; other runs stay."""
    rows = df.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: its lineage ends there, and values
    that depend on task order are fixed. Deleted when the application ends."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    delete_at_exit(df.sparkSession, path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def row_and_byte_counts(spark: SparkSession, path: str) -> DataFrame:
    """(files, rows, bytes) of a Parquet table, from a scan without columns."""
    rows = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
    files = rows.groupBy("file_path").agg(F.count("*").alias("rows"), F.max("file_size").alias("bytes"))
    return files.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def last_by_key(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row a key, the first in ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; columns in ``keep`` retain old values."""
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("__there", F.lit(True)).alias("o").join(new.withColumn("__there", F.lit(True)).alias("n"), list(key), "full")

    def pick(c: str) -> Column:
        if c in keep or c not in new.columns:
            return F.when(F.col("o.__there"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}") if c in new.columns else F.lit(None)).alias(c)
        return F.when(F.col("n.__there"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*key, *[pick(c) for c in rest])


def delete_where(df: DataFrame, gone: Column) -> tuple[DataFrame, int]:
    """What stays, and how many rows go."""
    return df.where(~F.coalesce(gone, F.lit(False))), df.where(gone).count()


def files_under(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length) of files anywhere below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return files.load(root).select("path", "modificationTime", "length")


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return files.load(root).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_with_metadata(df: DataFrame, path: str, **metadata: str) -> None:
    """Parquet (snappy) in ``path/data``, with one row of facts about it in ``path/metadata``."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/data")
    facts = df.sparkSession.createDataFrame([(metadata,)], "facts map<string, string>").withColumn("written_at", F.current_timestamp())
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def read_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    return dict(spark.read.parquet(f"{path}/metadata").first().facts)


def in_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 100) -> DataFrame:
    """``fn`` over Arrow batches of at most ``rows`` rows, whatever the session's batch size."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)
