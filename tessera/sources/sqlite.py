"""SQLite files as a Spark data source: one file or a folder of them, on a path that all machines see.

Each file is read in ranges of row ids, one task a range; only the columns of the schema asked for are
read, and comparisons of them with constants are made by the database. Values are as stored:
integers, reals, texts and blobs.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Row ids of one range, rows of one batch.
RANGE, BATCH = 250_000, 8_192
_KINDS = {"INTEGER": LongType(), "REAL": DoubleType(), "TEXT": StringType(), "BLOB": BinaryType()}
_ARROW = {LongType: pa.int64(), DoubleType: pa.float64(), StringType: pa.string(), BinaryType: pa.binary()}
_COMPARED = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def local(path: str) -> str:
    """The plain path of a file:// one."""
    return path.removeprefix("file://").removeprefix("file:")


def files(path: str) -> list[str]:
    return sorted(glob.glob(f"{local(path)}/*.db")) if os.path.isdir(local(path)) else [local(path)]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class Range(D.InputPartition):
    path: str
    low: int
    high: int


class Reader(D.DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.range = int(options.get("range", RANGE))
        self.conditions: list[tuple[str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Take comparisons of a column with a number or text; yield the others back."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if isinstance(f, D.IsNotNull):
                self.conditions.append((f"{quoted(name)} IS NOT NULL", None))
            elif type(f) in _COMPARED and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.conditions.append((f"{quoted(name)} {_COMPARED[type(f)]} ?", f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for path in files(self.path):
            db = opened(path)
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            db.close()
            if low is not None:
                out += [Range(path, at, min(high, at + self.range - 1)) for at in range(low, high + 1, self.range)]
        return out or [Range("", 0, -1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        db = opened(part.path)
        names = ", ".join(quoted(c) for c in self.schema.names) or "1"
        where = " AND ".join(["rowid BETWEEN ? AND ?", *[c for c, _ in self.conditions]])
        rows = db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {where}", [part.low, part.high, *[v for _, v in self.conditions if v is not None]])
        kinds = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in self.schema])
        while found := rows.fetchmany(BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)
        db.close()


class SqliteSource(D.DataSource):
    """Format ``sqlite`` with options ``path`` and ``table``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        db = opened(files(self.options["path"])[0])
        columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        db.close()
        return StructType([StructField(c[1], _KINDS.get(c[2].upper(), StringType())) for c in columns])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, columns: str | None = None) -> DataFrame:
    """A table of one file or a folder of files; ``columns`` is a schema of those to read."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").option("path", path).option("table", table)
    return (reader.schema(columns) if columns else reader).load()


_STORED = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "binary": "BLOB"}


def write_sqlite(df: DataFrame, folder: str, table: str) -> int:
    """Rows into a folder of SQLite files, one a task; returns how many. A task that runs again
    replaces its own file. Types that the database lacks are to be cast first."""
    kinds = ", ".join(f"{quoted(f.name)} {_STORED.get(f.dataType.simpleString(), 'TEXT')}" for f in df.schema)
    marks = ", ".join("?" * len(df.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.makedirs(local(folder), exist_ok=True)
        task = TaskContext.get()
        path = f"{local(folder)}/part-{task.partitionId():05d}.db"
        own, n = f"{path}.{task.taskAttemptId()}", 0
        db = sqlite3.connect(own)
        db.execute(f"CREATE TABLE {quoted(table)} ({kinds})")
        for batch in batches:
            db.executemany(f"INSERT INTO {quoted(table)} VALUES ({marks})", zip(*[c.to_pylist() for c in batch.columns], strict=True))
            n += batch.num_rows
        db.commit()
        db.close()
        os.replace(own, path)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return sum(r.n for r in df.mapInArrow(run, "n bigint").collect())  # a row a task
