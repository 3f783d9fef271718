"""What the corpus operators share: the shared folder, written tables, hot Arrow loops."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tessera.session import delete_at_exit, shared_root

#: Rows of one Arrow batch; documents are long, so batches hold few of them.
ARROW_ROWS = 2000

_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """State that a Python worker keeps from task to task, of one operator at a time: what
    another one has kept is let go first."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Let go of what earlier tasks of this worker have kept."""
    _kept.clear()


def written(df: DataFrame, label: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, under another ``schema``
    of the same stored types if one is given.

    This cuts the lineage: executors lost later cost no recomputation, and values that
    depend on task order (row positions, partition numbers) are fixed once. The file system
    deletes it when the application ends.
    """
    path = f"{shared_root(df.sparkSession)}/tessera-{uuid.uuid4().hex}-{label}"
    delete_at_exit(df.sparkSession, path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch of long documents can hold in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, keep: bool = False) -> DataFrame:
    """``fn`` over Arrow batches; it may return a dict of columns in the schema's order.
    ``keep``: it uses state that the worker has ``kept``."""
    small_batches(df.sparkSession)
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            release()
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield as_batch(out, kinds) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(columns.values(), kinds, strict=True)],
        schema=kinds,
    )


_KINDS = {
    "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "double": pa.float64(), "float": pa.float32(),
    "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
}


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow types of a plain ``name type, ...`` list; needs no session, so tasks can call it."""

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else _KINDS[name]

    return pa.schema([(n, kind(k)) for n, k in (part.split() for part in schema.split(","))])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def ranges_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def dealt(rows: DataFrame, tasks: int, *columns: str):
    """``rows`` grouped by ``columns``, over at least ``tasks`` tasks."""
    if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, *columns)
    return rows.groupBy(*columns)


def slices(column: pa.Array, most: int) -> list[tuple[int, int]]:
    """(first row, end) of neighbouring values of some ``most`` bytes together."""
    group = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64)) // most
    edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(column)].tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def binary_of(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` bytes, laid end to end in ``data``."""
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "#"
    return name
