"""Incremental runs: a file stream taken as it is now, idempotent writes, a run ledger."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessera.plans.registry import query
from tessera.session import delete_at_exit, shared_root
from tessera.sources.keyed import KeyedTable
from tessera.sources.sqlite import read_sqlite, write_sqlite
from tessera.sources.tables import table

LEDGER = "run_id string, run_type string, status string, at timestamp, detail map<string, string>"
#: States after which a run has an end time.
TERMINAL = ("completed", "failed", "interrupted")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, deleted when the application ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def ingest_available(spark: SparkSession, source: str, target: str, checkpoint: str, key: str, where: str = "true") -> None:
    """Bring what is new in a Parquet folder into ``target``, one folder a batch.

    The checkpoint remembers the files taken, so a second call adds nothing twice; a batch
    that is run again replaces its own folder. Of a key's rows the one that came first stays.
    """
    schema = spark.read.parquet(source).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*")
    there = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.where(where).dropDuplicates([key])
        before = [f"{target}/{n}" for n in (f.getPath().getName() for f in there.globStatus(place) or []) if int(n[6:]) < number]
        if before:
            rows = rows.join(spark.read.schema(schema).parquet(*before).select(key), key, "left_anti").select(batch.columns)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_event(spark: SparkSession, ledger: str, run_id: str, run_type: str, status: str, **detail: str) -> None:
    """A run is what its events say: states are appended, never changed in place."""
    row = spark.createDataFrame([(run_id, run_type, status, None, detail)], LEDGER).withColumn("at", F.current_timestamp())
    row.write.mode("append").parquet(ledger)


def runs(events: DataFrame) -> DataFrame:
    """One row a run: latest state, start, end (of terminal states) and latest details."""
    order = F.struct("at", F.col("status").isin(*TERMINAL))
    return events.groupBy("run_id", "run_type").agg(
        F.max_by("status", order).alias("status"), F.min("at").alias("started_at"),
        F.max(F.when(F.col("status").isin(*TERMINAL), F.col("at"))).alias("completed_at"), F.max_by("detail", order).alias("detail"),
    )


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE event_type <> 'view' GROUP BY event_type")
def stream_available_now(spark, sf_dir):
    """Events through a file stream, twice; the second run finds nothing new."""
    source = scratch(spark, "stream-source")
    target, checkpoint = scratch(spark, "stream-target"), scratch(spark, "stream-state")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(source)
    for _ in range(2):
        ingest_available(spark, source, target, checkpoint, "event_id", "event_type <> 'view'")
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def ingest_keyed(spark: SparkSession, source: str, target: KeyedTable, checkpoint: str, order: Sequence[str] = (), where: str = "true", files: int = 1) -> None:
    """Merge what is new in a Parquet folder into a keyed table, ``files`` files a batch: a key that
    comes again replaces its row unless it is older in ``order``. A batch that is run again
    after a stop changes nothing."""
    stream = spark.readStream.schema(target.schema).option("maxFilesPerTrigger", files).parquet(source).where(where)
    writer = stream.writeStream.foreachBatch(lambda batch, _: target.merge(batch, order)).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


@query("""SELECT event_type, count(*) AS n, round(sum(value + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END), 3) AS total FROM events GROUP BY event_type""")
def stream_keyed_merge(spark, sf_dir):
    """Events through a file stream into a keyed table; a later file brings a third of the keys
    again with other values, between two runs that find nothing new."""
    source, checkpoint = scratch(spark, "keyed-source"), scratch(spark, "keyed-state")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    target = KeyedTable(spark, scratch(spark, "keyed-target"), ["event_id"], events.withColumn("version", F.lit(1)).schema)
    again = events.where("event_id % 3 = 0").withColumns({"value": F.col("value") + 1, "version": F.lit(2)})
    for rows in (events.withColumn("version", F.lit(1)), again):
        rows.coalesce(4).write.mode("append").parquet(source)
        for _ in range(2):
            ingest_keyed(spark, source, target, checkpoint, ["version"], files=2)
    return target.read().groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P' GROUP BY o_orderstatus")
def src_sqlite_orders(spark, sf_dir):
    """Orders written to SQLite files and read back as a table, with pushed comparisons."""
    folder = scratch(spark, "sqlite")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    write_sqlite(orders, folder, "orders")
    rows = read_sqlite(spark, folder, "orders", "o_orderstatus string, o_totalprice double")
    return rows.where("o_totalprice > 100000 and o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


CURSOR = "name string, page bigint, at_index bigint, at timestamp, cleared boolean"


def save_cursor(spark: SparkSession, path: str, name: str, page: int | None = None, index: int | None = None) -> None:
    """Remember where a run has come to; without a page it has nothing left to resume."""
    row = spark.createDataFrame([(name, page, index, None, page is None)], CURSOR).withColumn("at", F.current_timestamp())
    row.write.mode("append").parquet(path)


def cursor(events: DataFrame, name: str) -> tuple[int, int] | None:
    """The last place saved, or None if there is none or it was cleared."""
    last = events.where(F.col("name") == name).agg(F.max_by(F.struct("page", "at_index", "cleared"), "at").alias("x")).first().x
    return None if last is None or last.cleared else (last.page, last.at_index)


def retried(first: DataFrame, again: Callable[[DataFrame], DataFrame], failed: str = "status = 'failed'") -> DataFrame:
    """Rows of a first pass, those that failed replaced by a second pass over them alone."""
    return first.where(f"not coalesce({failed}, false)").unionByName(again(first.where(failed)).select(first.columns))


@query("""SELECT doc_id, CASE WHEN n >= 2000 THEN 'passed' WHEN n * 1.5 >= 2000 THEN 'retried' ELSE 'failed' END AS status, CASE WHEN n >= 2000 THEN 1 ELSE 2 END AS pass
    FROM (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents)""")
def run_retry_failed(spark, sf_dir):
    """A second, more lenient pass over what failed."""
    n = F.coalesce("n_chars", F.lit(0))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", n.alias("n"))
    first = docs.select("doc_id", "n", F.when(F.col("n") >= 2000, "passed").otherwise("failed").alias("status"), F.lit(1).alias("pass"))
    again = lambda rows: rows.withColumns({"status": F.when(F.col("n") * 1.5 >= 2000, "retried").otherwise("failed"), "pass": F.lit(2)})
    return retried(first, again).drop("n")


def observed_write(df: DataFrame, path: str, mode: str = "overwrite", **counters: Column) -> dict:
    """Write ``df`` as Parquet and count while it is written: ``rows`` and any named aggregates, without
    a second pass."""
    seen = Observation(f"write-{uuid.uuid4().hex}")
    df.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in counters.items()]).write.mode(mode).parquet(path)
    return seen.get


class LedgerListener(StreamingQueryListener):
    """Appends a stream's start, its batches' rows and its end to a ledger (``append_event``). A stream
    that ends with an error is a failed run."""

    def __init__(self, spark: SparkSession, ledger: str, run_type: str) -> None:
        self.spark, self.ledger, self.run_type, self.rows = spark, ledger, run_type, {}

    def onQueryStarted(self, event) -> None:
        append_event(self.spark, self.ledger, str(event.runId), self.run_type, "running")

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        append_event(self.spark, self.ledger, run, self.run_type, "failed" if event.exception else "completed", rows=str(self.rows.pop(run, 0)))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE value >= 50) AS large, max(event_id) AS last_id, count(*) AS written FROM events WHERE event_type <> 'view'")
def run_observed_counts(spark, sf_dir):
    """What a write counted as it went, beside the rows that it wrote."""
    path = scratch(spark, "observed")
    rows = table(spark, sf_dir, "events").where("event_type <> 'view'")
    seen = observed_write(rows, path, large=F.count_if(F.col("value") >= 50), last_id=F.max("event_id"))
    counted = [F.lit(seen[c]).cast("bigint").alias(c) for c in ("rows", "large", "last_id")]
    return spark.read.parquet(path).agg(F.count("*").alias("written")).select(*counted, "written")
