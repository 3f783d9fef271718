"""Fewer dimensions before clustering: a spectral embedding of the graph of nearest neighbours.

Edges weigh what their distances say about both ends' neighbourhoods. The leading vectors of the
normalised weights are found by power iterations of a whole subspace, filtered by Chebyshev
polynomials. Nodes lie in blocks, with their edges. In a turn each block sends every other one the
sums that its nodes give to that one's, all columns at once, and adds up what it hears; after
DEGREE turns small matrices of products (one a block) give the best vectors within the columns
and the bound below which the next turns damp. The driver sees those matrices alone.

Nodes without an edge have no place in the embedding; an empty graph gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import stored

#: Dimensions kept, columns more that speed the turns up, turns of one filter, and filters.
DIMENSIONS, SPARE, DEGREE, FILTERS = 5, 6, 6, 3
#: Nodes of a block if there are few and if there are many, least blocks, and blocks that are few.
FEW_NODES, BLOCK_NODES, LEAST_BLOCKS, FEW_BLOCKS = 1_024, 8_192, 8, 128


def fuzzy_edges(neighbours: DataFrame) -> DataFrame:
    """(a, b, w), both ways: 1 for a node's nearest, falling with the distance beyond it on the
    scale of its neighbourhood; the two ways of an edge are joined as chances are."""
    per = neighbours.groupBy("query").agg(F.min("distance").alias("least"), F.avg("distance").alias("mean"))
    near = neighbours.join(per, "query")
    scale = F.greatest(F.col("mean") - F.col("least"), F.lit(1e-9))
    near = near.select(F.col("query").alias("a"), F.col("id").alias("b"), F.exp(-(F.col("distance") - F.col("least")) / scale).alias("w")).where("a != b")
    both = near.withColumn("v", F.lit(0.0)).unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.0).alias("w"), F.col("w").alias("v")))
    both = both.groupBy("a", "b").agg(F.max("w").alias("w"), F.max("v").alias("v"))
    return both.select("a", "b", (F.col("w") + F.col("v") - F.col("w") * F.col("v")).alias("w"))


def _normalised(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (a, b, w) with w over the root of both ends' sums, with an edge of no weight from each
    node to itself, and (node, degree)."""
    degree = stored(edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree")), "degree")
    ends = [degree.withColumnsRenamed({"node": c, "degree": f"d{c}"}) for c in ("a", "b")]
    joined = edges.join(ends[0], "a").join(ends[1], "b")
    own = degree.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w"))
    return stored(joined.select("a", "b", (F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("w")).unionByName(own), "edges"), degree


def _whitener(gram: np.ndarray) -> np.ndarray:
    """Columns that make a basis orthonormal; directions that have vanished stay zero."""
    e, u = np.linalg.eigh(gram)
    return u * np.where(e > max(e.max(), 0) * 1e-14, 1 / np.sqrt(np.maximum(e, 1e-300)), 0.0)


def _multiplied(edges: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """``values`` with columns n.. of the weights times the columns ``names``: a turn by one join, which
    that of blocks is tested against. A node hears its own values over its edge to itself."""
    kept = [c for c in values.columns if c != "node"]
    heard = edges.join(values.withColumnRenamed("node", "b"), "b")
    own = F.col("a") == F.col("b")
    return heard.groupBy(F.col("a").alias("node")).agg(*[F.sum(F.col("w") * F.col(n)).alias(f"n{n}") for n in names], *[F.max(F.when(own, F.col(c))).alias(c) for c in kept])


_HELD = pa.schema([("block", pa.int32()), *((n, pa.binary()) for n in ("nodes", "scale", "at", "w", "begin", "to", "start")), ("target", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
_VALUES = pa.schema([("block", pa.int32()), ("source", pa.int32()), ("ids", pa.binary()), ("v", pa.binary())])


def _sql(kinds: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'array<int>' if pa.types.is_list(f.type) else 'binary' if pa.types.is_binary(f.type) else 'int'}" for f in kinds)


def blocked(edges: DataFrame, columns: int) -> DataFrame:
    """Stored _HELD of (a, b, w), both ways: of each block the nodes in order, one over the root of their
    sums, their start, and edges by the block and node that they lead to, with where each
    begins and where each block ends."""
    degree = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))
    start = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5 for i in range(columns)]
    n = edges.agg(F.count_distinct("a")).first()[0]
    blocks = max(LEAST_BLOCKS, min(-(-n // FEW_NODES), max(FEW_BLOCKS, -(-n // BLOCK_NODES))))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    nodes = degree.select(place("node").alias("block"), "node", "degree", F.array(*start).alias("start"))
    edges = edges.select(place("a").alias("block"), "a", "b", "w", place("b").alias("target"))

    def pack(own: pa.Table, out: pa.Table) -> pa.Table:
        own = own.sort_by("node")
        block, nodes, degree = own.column("block")[0].as_py(), own.column("node").to_numpy(), own.column("degree").to_numpy()
        to, target, w = (out.column(c).to_numpy() for c in ("b", "target", "w"))
        at = np.searchsorted(nodes, out.column("a").to_numpy())
        order = np.lexsort((at, to, target))
        to, target, at, w = to[order], target[order], at[order], w[order]
        begin = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        targets, first = np.unique(target[begin], return_index=True)
        parts = (nodes, 1 / np.sqrt(degree), at.astype(np.int32), w, begin, to[begin], own.column("start").combine_chunks().flatten().to_numpy())
        row = [[block], *([x.tobytes()] for x in parts), [targets.tolist()], [[*first[1:].tolist(), len(begin)]]]
        return pa.table(dict(zip(_HELD.names, row, strict=True)), schema=_HELD)

    return stored(nodes.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(pack, _sql(_HELD)), "held")


#: From a block's own columns and what it hears: its own columns, and those that it sends.
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]]


def _turn(held: DataFrame, values: DataFrame, columns: int, step: Step) -> DataFrame:
    """_VALUES after a turn. A block's own columns come from itself, as source -1."""

    def run(there: pa.Table, told: pa.Table) -> pa.Table:
        block, nodes, scale, at, w, begin, to, _, target, ends = (c[0].as_py() for c in there.columns)
        nodes, scale, w = np.frombuffer(nodes, np.int64), np.frombuffer(scale, np.float64)[:, None], np.frombuffer(w, np.float64)
        heard, own = np.zeros((len(nodes), columns)), None
        told = told.sort_by("source")  # sums of one order
        for i in range(told.num_rows):
            v = np.frombuffer(told.column("v")[i].as_py(), np.float64)
            if told.column("source")[i].as_py() < 0:
                own = v.reshape(len(nodes), -1)
            else:
                heard[np.searchsorted(nodes, np.frombuffer(told.column("ids")[i].as_py(), np.int64))] += v.reshape(-1, columns)
        own, sent = step(own, heard * scale)
        rows = [(block, -1, None, own.tobytes())]
        if sent is not None:
            sums = np.add.reduceat((sent * scale)[np.frombuffer(at, np.int32)] * w[:, None], np.frombuffer(begin, np.int64), 0)
            names = np.frombuffer(to, np.int64)
            rows += [(t, block, names[a:b].tobytes(), sums[a:b].tobytes()) for t, a, b in zip(target, [0, *ends], ends, strict=False)]
        return pa.table(dict(zip(_VALUES.names, zip(*rows, strict=True), strict=True)), schema=_VALUES)

    return held.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, _sql(_VALUES))


def _summed(values: DataFrame, columns: int, product: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of small matrices, one a block, of the first and the other columns."""

    def run(batches):
        for batch in batches:
            for block, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both = np.frombuffer(v, np.float64).reshape(-1, 2 * columns)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "m": [product(both[:, :columns], both[:, columns:]).tobytes()]})

    rows = values.select("block", "v").mapInArrow(run, "block int, m binary").collect()  # a row a block
    return sum((np.frombuffer(r.m, np.float64) for r in sorted(rows, key=lambda r: r.block)), np.zeros(columns * columns)).reshape(columns, columns)


def embedded(neighbours: DataFrame, dimensions: int = DIMENSIONS, filters: int = FILTERS) -> DataFrame:
    """Stored (node, v): leading vectors of the graph of (query, id, distance, rank), without the
    first (degrees alone), over the root of the nodes' degrees."""
    columns = dimensions + 1 + SPARE
    held = blocked(stored(fuzzy_edges(neighbours), "edges"), columns)
    values = held.select("block", F.lit(-1).alias("source"), F.lit(None).cast("binary").alias("ids"), F.col("start").alias("v"))
    bound, keep = 0.0, np.zeros((columns, dimensions))
    for _ in range(filters):
        half, middle = (1 + bound) / 2, (bound - 1) / 2
        # under the polynomial of DEGREE that stays small on [-1, bound]
        turn = _turn(held, values, columns, lambda y, _: (y[:, -columns:], y[:, -columns:]))
        for i in range(DEGREE):
            turn = _turn(held, turn, columns, _chebyshev(columns, half, middle, i))
        values = stored(turn, "values")
        basis = _whitener(_summed(values, columns, lambda y, _: y.T @ y))
        turn = _turn(held, values, columns, lambda y, _, basis=basis: (y[:, :columns] @ basis, y[:, :columns] @ basis))
        values = stored(_turn(held, turn, columns, lambda y, heard: (np.concatenate([heard, y], 1), None)), "values")
        e, u = np.linalg.eigh(_symmetric(_summed(values, columns, lambda n, y: n.T @ y)))
        bound = float(np.clip(e.min(), 0.0, 0.999))
        keep = u[:, np.argsort(-e)[1 : dimensions + 1]]

    def placed(batches):
        for batch in batches:
            for nodes, scale, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(v, np.float64).reshape(-1, 2 * columns)[:, columns:] @ keep * np.frombuffer(scale, np.float64)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(nodes, np.int64)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["node", "v"])

    return stored(held.join(values, "block").select("nodes", "scale", "v").mapInArrow(placed, "node bigint, v array<double>"), "embedded")


def _chebyshev(columns: int, half: float, middle: float, turn: int) -> Step:
    """The next columns, beside the last, which are sent but for the last turn."""

    def step(y: np.ndarray, heard: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        last, before = y[:, :columns], y[:, columns:]
        new = (heard - middle * last) / half if not turn else 2 * (heard - middle * last) / half - before
        return np.concatenate([new, last], 1), new if turn < DEGREE - 1 else None

    return step


def _symmetric(matrix: np.ndarray) -> np.ndarray:
    return (matrix + matrix.T) / 2


def kept_neighbours(before: DataFrame, after: DataFrame) -> float:
    """Mean share of each point's neighbours (query, id) that are its neighbours after, too."""
    both = before.select("query", "id").join(after.select("query", "id", F.lit(1).alias("there")), ["query", "id"], "left")
    shares = both.groupBy("query").agg(F.avg(F.coalesce("there", F.lit(0))).alias("share"))
    return shares.agg(F.avg("share")).first()[0] or 0.0
