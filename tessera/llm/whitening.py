"""Embedding whitening with MLlib's distributed block matrices.

1. Vectors become whole numbers; one pass sums them up. Each task centres its rows and lays
   them down as dense blocks of BLOCK rows, numbered by task and place, in a written table
   together with the rows' ids.
2. The scatter matrix is the product of the transposed block matrix with itself, dealt over
   tasks along the rows; the driver gets its one small block and finds its eigenvectors.
3. The block matrix times the whitening matrix projects all rows. Products meet the ids of
   their blocks in a join by block number.

Blocks are multiplied in groups of GROUP, so what the driver hears of blocks is bounded, and
so are the tasks of one product.

Defined cases: null vectors and those with null or non-finite entries (or of 2^46 and more)
go, and so do vectors of another length than most (of equally many, the longer stay); rows
that repeat an id, or have none, are rows of their own; components whose variance is zero but
for rounding can't be whitened and give no rows, so a single vector or equal ones give none;
a deviation beyond a long is null; an empty table gives no rows; other columns are neither
read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tessera.llm.common import small_batches, written

#: Whole number of an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block, blocks of one product, tasks of a product, components of a result.
BLOCK, GROUP, TASKS, COMPONENTS = 1024, 4096, 16, 32
#: Blocks of an Arrow batch.
ARROW_BLOCKS = 16
#: Entries from here on are no longer told apart.
LARGEST = float(1 << 46)

_MATRIX = MatrixUDT.sqlType()
#: Blocks as MLlib takes them.
_BLOCKS = StructType([StructField("at", StructType([StructField("row", LongType(), False), StructField("column", LongType(), False)]), False), StructField("block", MatrixUDT(), False)])
_ARROW = pa.struct([
    ("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
    ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_()),
])


def whole(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(SCALE * c).cast("bigint") + SHIFT)


def comparable(vectors: DataFrame, id_col: str, embedding: str) -> tuple[DataFrame, int]:
    """(id, x) of the vectors that stay, as whole numbers, and their length."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    good = rows.where(F.coalesce(F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))), F.lit(False)))
    most = good.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first().m
    if most is None:
        return good.where("false").select("id", whole(F.col("v")).alias("x")), 0
    return good.where(F.size("v") == most.d).select("id", whole(F.col("v")).alias("x")), most.d


def _summed(rows: DataFrame, schema: str, run) -> np.ndarray:
    """Sums, place by place, of the arrays that tasks make of their rows."""
    parts = rows.mapInArrow(run, schema)
    kind = "decimal(38,0)" if "bigint" in schema else "double"
    cells = parts.select(F.posexplode("s").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast(kind)).alias("x")).orderBy("at")
    return [r.x for r in cells.collect()]  # as many as a vector has places


def sums_of(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each place."""

    def run(batches):
        total = np.zeros(width + 1, dtype=np.int64)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            total += np.r_[batch.num_rows, x.sum(0)]
        yield pa.RecordBatch.from_pydict({"s": [total]})

    n, *sums = map(int, _summed(rows, "s array<bigint>", run))
    return n, sums


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over places of (n x - S)^2, exact; None where it is beyond a long."""
    largest = n * (max(map(abs, x.ravel().tolist()), default=0) + 1) + max(map(abs, sums), default=0)
    if largest < 1 << 62:
        apart = n * x - np.array(sums, dtype=np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return (apart * apart).sum(1).tolist()
    exact = (sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def blocks_of(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """Written (number, ids, deviations, block): centred rows in dense blocks of BLOCK rows; the
    last of a task is filled up with zeros, which add nothing to a product."""
    width, mean = len(sums), np.array([s / n for s in sums])
    kind = ArrayType(rows.schema["id"].dataType)
    schema = StructType([StructField("part", IntegerType()), StructField("place", IntegerType()), StructField("ids", kind), StructField("deviations", ArrayType(LongType())), StructField("block", _MATRIX)])
    small_batches(rows.sparkSession)

    def made(part: int, place: int, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        centred = np.zeros((BLOCK, width))
        centred[: len(x)] = x - mean
        block = {"type": 1, "numRows": BLOCK, "numCols": width, "colPtrs": None, "rowIndices": None, "values": centred.T.ravel(), "isTransposed": False}
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([deviations(x, n, sums)], pa.list_(pa.int64())), pa.array([block], _ARROW),
        ], names=schema.names)

    def run(batches):
        part, place, held, count = TaskContext.get().partitionId(), 0, [], 0

        def flush(end: bool):
            nonlocal held, count, place
            table = pa.Table.from_batches(held).combine_chunks()
            while count >= BLOCK or (end and count):
                now = table.slice(0, BLOCK)
                ids, x = (now.column(i).combine_chunks() for i in (0, 1))
                yield made(part, place, ids, x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width))
                table, place = table.slice(BLOCK), place + 1
                count = table.num_rows
            held = table.to_batches()

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK:
                yield from flush(False)
        if count:
            yield from flush(True)

    typed = StructType([*schema.fields[:4], StructField("block", MatrixUDT())])  # what the matrix is read as
    found = written(rows.mapInArrow(run, schema), "blocks", typed)
    most = found.agg(F.max("place")).first()[0] + 1
    return found.select((F.col("part") * most + F.col("place")).alias("number"), "ids", "deviations", "block")


def _groups(blocks: DataFrame) -> list[tuple[int, int]]:
    """(number, blocks) of the groups of GROUP block numbers that have any."""
    found = blocks.groupBy(F.expr(f"number div {GROUP}").alias("g")).count().orderBy("g").collect()
    return [(r.g, r["count"]) for r in found]


def block_matrix(blocks: DataFrame, group: int, width: int) -> BlockMatrix:
    """Blocks of a group as one block matrix; the blocks stay in the JVM."""
    at = F.struct((F.col("number") - group * GROUP).cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("column"))
    own = blocks.where(F.expr(f"number div {GROUP} = {group}")).select(at.alias("at"), "block")
    return BlockMatrix(callMLlibFunc("createBlockMatrix", own, BLOCK, width, GROUP * BLOCK, width), BLOCK, width)


def scatter(blocks: DataFrame, width: int) -> np.ndarray:
    """Transposed block matrix times itself, summed over groups; each product is split along
    the rows into up to TASKS tasks."""
    total = np.zeros((width, width))
    for group, n in _groups(blocks):
        own = block_matrix(blocks, group, width)._java_matrix_wrapper._java_model
        product = own.transpose().multiply(own, min(n, TASKS))
        total += BlockMatrix(product, width, width).toLocalMatrix().toArray()
    return total


@dataclass(frozen=True)
class Components:
    """Vectors that take centred rows to unit variance (columns), and their eigenvalues."""

    matrix: np.ndarray
    values: np.ndarray
    trace: float


def components_of(covariance: np.ndarray, most: int = COMPONENTS) -> Components:
    """By falling eigenvalue, those that aren't zero but for rounding."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    enough = values > max(values.max(initial=0.0), 0.0) * len(values) * np.finfo(float).eps * 16
    kept = np.flatnonzero(enough)[:most]
    return Components(vectors[:, kept] / np.sqrt(values[kept]), values[kept], float(np.trace(covariance)))


def projected(blocks: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Written (number, matrix): blocks times ``matrix``."""
    width, k = matrix.shape
    one = blocks.sparkSession.createDataFrame([((0, 0), DenseMatrix(width, k, matrix.T.ravel()))], _BLOCKS)
    out = None
    for group, n in _groups(blocks):
        # a product along one dimension has as many tasks as the root of its factors' partitions
        right = BlockMatrix(callMLlibFunc("createBlockMatrix", one.repartition(min(n, TASKS * TASKS)), width, k, width, k), width, k)
        product = block_matrix(blocks, group, width).multiply(right)
        part = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).toDF("at", "matrix")
        part = part.select((F.col("at").getField("_1") + group * GROUP).cast("int").alias("number"), "matrix")
        out = part if out is None else out.unionByName(part)
    return written(out, "projected")


def _values(column: pa.Array, k: int) -> np.ndarray:
    """Dense matrices of k columns, as (block, row, component)."""
    values = column.field("values").flatten().to_numpy().reshape(len(column), k, -1)
    return values.transpose(0, 2, 1)


def covariance_error(met: DataFrame, n: int, k: int) -> float:
    """Largest difference of the projections' covariance from the identity; ``met`` has the
    number of a block's rows and its projections."""
    rows = met.select("rows", "matrix")

    def each(batches):
        for batch in batches:
            for rows, y in zip(batch.column(0).to_pylist(), _values(batch.column(1), k), strict=True):
                yield y[:rows]

    def first(batches):
        yield pa.RecordBatch.from_pydict({"s": [sum((y.sum(0) for y in each(batches)), np.zeros(k))]})

    mean = np.array(_summed(rows, "s array<double>", first)) / n

    def second(batches):
        total = np.zeros((k, k))
        for y in each(batches):
            total += (y - mean).T @ (y - mean)
        yield pa.RecordBatch.from_pydict({"s": [total.ravel()]})

    covariance = np.array(_summed(rows, "s array<double>", second)).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): the first ``most``
    components of each vector. The fit list is all vectors that stay."""
    kind = vectors.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    none = vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows, width = comparable(vectors, id_col, embedding)
    if not width:
        return none
    n, sums = sums_of(rows, width)
    blocks = blocks_of(rows, n, sums)
    found = components_of(scatter(blocks, width) / n, most)
    k = len(found.values)
    if not k:
        return none
    met = projected(blocks, found.matrix).join(blocks.select("number", "ids", "deviations", F.size("ids").alias("rows")), "number")
    met = written(met.select("rows", "matrix", "ids", "deviations"), "met", StructType([StructField("rows", IntegerType()), StructField("matrix", MatrixUDT()), StructField("ids", ArrayType(kind)), StructField("deviations", ArrayType(LongType()))]))
    error, explained = covariance_error(met, n, k), found.values / found.trace
    small_batches(vectors.sparkSession, ARROW_BLOCKS)

    def run(batches):
        for batch in batches:
            for i, y in enumerate(_values(batch.column(1), k)):
                rows = batch.column(0)[i].as_py()
                at = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(2)[i].values.take(at), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n)),
                    batch.column(3)[i].values.take(at), pa.array(y[:rows].ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return met.mapInArrow(run, schema).withColumnRenamed("id", id_col)
