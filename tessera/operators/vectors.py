"""Vectors: centroids, cosine assignment to categories on two levels, roll-ups, neighbours.

Categories and query vectors are small sides: they are collected behind a check of their
size, in blocks where there may be many, and multiplied inside Arrow batches. Each task
keeps only the best of its rows for each query before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.tables import table

GUARD = 1e-8
#: Numbers that one side of a multiplication may hold when it is sent to all tasks.
SMALL_SIDE = 4_000_000
#: Queries and rows that a task multiplies at once.
MULTIPLIED_QUERIES, MULTIPLIED_ROWS = 512, 2_048


#: Keys whose sums a task holds before it sends them.
HELD_KEYS = 4_096


def centroids(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(key, vector): the mean of each position. Tasks add up whole vectors and send one sum a
    key; null vectors don't count, and vectors of one key must be of one length."""
    rows = vectors.select(F.col(key).alias("k"), F.col(embedding).cast("array<double>").alias("v")).where("k is not null and v is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        sums: dict = {}

        def sent():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), keys), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["k", "n", "v"]
            )

        keys = pa.null()
        for batch in batches:
            keys = batch.schema.field(0).type
            lengths = pc.list_value_length(batch.column(1)).to_numpy()
            flat, begin = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            coded = batch.column(0).dictionary_encode()
            for c, name in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(coded.indices.to_numpy() == c)
                total = flat[begin[own][:, None] + np.arange(lengths[own[0]])].sum(0)
                n, before = sums.get(name, (0, 0.0))
                sums[name] = n + len(own), before + total
            if len(sums) > HELD_KEYS:
                yield sent()
                sums.clear()
        if sums:
            yield sent()

    parts = rows.mapInArrow(run, f"k {kind}, n bigint, v array<double>")
    cells = parts.select("k", "n", F.posexplode("v").alias("at", "x")).groupBy("k", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    return cells.groupBy(F.col("k").alias(key)).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("vector"))


def small_matrix(df: DataFrame, key: str, embedding: str) -> tuple[list, np.ndarray]:
    """Keys and vectors of a side of bounded size, ordered by key."""
    first = df.select(F.size(embedding).alias("d")).first()
    rows = df.count()
    if rows * (first.d if first else 0) > SMALL_SIDE:
        raise ValueError(f"{rows} vectors of {first.d} are more than a task should hold; use blocks")
    found = df.select(key, F.col(embedding).cast("array<double>").alias("v")).orderBy(key).toArrow().combine_chunks()
    if found.num_rows and pc.any(pc.not_equal(pc.fill_null(pc.list_value_length(found.column("v")), -1), first.d)).as_py():
        raise ValueError(f"vectors must have {first.d} numbers each")
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in found.column("v").chunks]
    return found.column(0).to_pylist(), np.concatenate([np.zeros(0), *flat]).reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, 0))


def _guarded(v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt((v * v).sum(1, keepdims=True)) + GUARD)


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


def of_width(rows: DataFrame, embedding: str, width: int) -> DataFrame:
    """Rows whose vector can be compared: null ones, those of another length and those with a
    null inside are near nothing."""
    good = (F.size(embedding) == width) & F.forall(embedding, lambda x: x.isNotNull())
    return rows.where(F.coalesce(good, F.lit(False)))


def assign(vectors: DataFrame, key: str, embedding: str, names: list, matrix: np.ndarray, k: int, least: float) -> DataFrame:
    """(key, category, similarity, rank): the k most similar categories, ranked before the
    threshold is applied; of equal ones the later category comes first."""
    unit = _guarded(matrix)
    rows = of_width(vectors.select(F.col(key).alias("id"), F.col(embedding).alias("v")), "v", unit.shape[1])
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            similar = _guarded(_vectors(batch, unit.shape[1])) @ unit.T
            order = (len(names) - 1 - np.argsort(-similar[:, ::-1], axis=1, kind="stable"))[:, :k]
            best = np.take_along_axis(similar, order, 1)
            row, rank = np.nonzero(best >= least)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).take(pa.array(row)), "category": pa.array([names[c] for c in order[row, rank]], pa.int64()),
                "similarity": pa.array(best[row, rank]), "rank": pa.array(rank + 1, pa.int64()),
            })

    out = rows.mapInArrow(run, f"id {kind}, category bigint, similarity double, rank bigint")
    return out.withColumnRenamed("id", key)


def roll_up(assigned: DataFrame, report: str, category: str, score, most: int) -> DataFrame:
    """Categories of each report with their score, rank and percentage; the best ``most``."""
    found = assigned.groupBy(report, category).agg(
        F.avg("similarity").alias("avg_similarity"), F.max("similarity").alias("max_similarity"), F.count("*").alias("n_assignments")
    )
    found = found.withColumn("score", score)
    w = Window.partitionBy(report).orderBy(F.round("score", 9).desc(), F.col(category).asc())
    found = found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most)
    whole = F.sum("score").over(Window.partitionBy(report))
    return found.withColumn("pct_contribution", F.bround(100.0 * F.col("score") / whole, 1))


def level_one_score():
    return 0.4 * F.col("avg_similarity") + 0.4 * F.col("max_similarity") + 0.2 * F.least(F.col("n_assignments") / 5.0, F.lit(1.0))


def neighbours(rows: DataFrame, queries: DataFrame, key: str, embedding: str, k: int) -> DataFrame:
    """(query, key, similarity, rank): the exact k nearest of all rows for each query vector.

    Queries are dealt into blocks of bounded size; in a block each task multiplies its rows
    with the queries, some of both at once, and passes on its k best for each, so k rows a query
    and task are shuffled. A row is no neighbour of itself.
    """
    first = queries.select(F.size(embedding).alias("d")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], f"query bigint, {key} bigint, similarity double, rank bigint")
    blocks = max(1, -(-queries.count() * first.d // SMALL_SIDE))
    out = None
    for b in range(blocks):
        names, matrix = small_matrix(queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b), key, embedding)
        part = _block_neighbours(rows, key, embedding, names, matrix, k)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _best(s: np.ndarray, own: np.ndarray, names: np.ndarray, best_s: np.ndarray, best_i: np.ndarray) -> None:
    """Put what is among the best of similarities ``s`` (queries ``names`` by rows ``own``) into the
    lists ``best_s`` and ``best_i`` of k a query, which are ordered by falling similarity and id.
    Only what can come into a list is looked at, so memory is that of ``s``."""
    k = best_s.shape[1]
    # rounding moves a similarity by half of 1e-9 at most
    near = s >= best_s[:, -1:] - 2e-9
    if near.sum() > 4 * k * len(s) and s.shape[1] > k:
        s = np.where(np.isnan(s), -np.inf, s)
        near &= s >= np.partition(s, -k - 1, 1)[:, -k - 1, None] - 2e-9  # one may be the query itself
    q, r = np.nonzero(near)
    value, i = np.round(s[q, r], 9), own[r]
    last_s, last_i = best_s[q, -1], best_i[q, -1]
    good = (i != names[q]) & ((value > last_s) | ((value == last_s) & (i < last_i)))
    q, value, i = q[good], value[good], i[good]
    if not len(q):
        return
    moved, place = np.unique(q, return_inverse=True)
    at = np.concatenate([np.repeat(np.arange(len(moved)), k), place])
    value, i = np.concatenate([best_s[moved].ravel(), value]), np.concatenate([best_i[moved].ravel(), i])
    order = np.lexsort((i, -value, at))
    begin = np.searchsorted(at[order], np.arange(len(moved)))
    kept = order[begin[:, None] + np.arange(k)]
    best_s[moved], best_i[moved] = value[kept], i[kept]


def _nearest_in(batches, key: str, ids: np.ndarray, unit: np.ndarray, k: int):
    """(query, key, similarity): the k best of all rows of ``batches`` for each query."""
    best_s, best_i = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
    blocks = [slice(a, a + MULTIPLIED_QUERIES) for a in range(0, len(ids), MULTIPLIED_QUERIES)]
    for batch in batches:
        for a in range(0, batch.num_rows, MULTIPLIED_ROWS):
            some = batch.slice(a, MULTIPLIED_ROWS)
            own, v = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _guarded(_vectors(some, unit.shape[1]))
            for b in blocks:
                _best(unit[b] @ v.T, own, ids[b], best_s[b], best_i[b])
    for b in blocks:
        q, r = np.nonzero(np.isfinite(best_s[b]))
        yield pa.RecordBatch.from_pydict({"query": pa.array(ids[b][q], pa.int64()), key: pa.array(best_i[b][q, r]), "similarity": pa.array(best_s[b][q, r])})


def _block_neighbours(rows: DataFrame, key: str, embedding: str, names: list, matrix: np.ndarray, k: int) -> DataFrame:
    unit, ids = _guarded(matrix), np.array(names, dtype=np.int64)
    compared = of_width(rows.select(key, embedding), embedding, unit.shape[1])
    return compared.mapInArrow(lambda batches: _nearest_in(batches, key, ids, unit, k), f"query bigint, {key} bigint, similarity double")


CENTROIDS = "SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(pos) GROUP BY label, pos) GROUP BY label"
COSINE = "list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-8) * (sqrt(list_dot_product({b}, {b})) + 1e-8))"
#: Thresholds and numbers kept on both levels, for the provided vectors.
LEAST_ONE, TOP_ONE, TOP_REPORT, LEAST_TWO, TOP_TWO, LEAST_BOTH = 0.10, 3, 5, 0.05, 2, 0.01


@query(f"SELECT label, list_transform(v, lambda x: round(x, 6)) AS vector FROM ({CENTROIDS})")
def vec_centroids(spark, sf_dir):
    return centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


ASSIGNED = f"""(SELECT vec_id, category, s AS similarity, n AS rank FROM (SELECT vec_id, c.label AS category, {COSINE.format(a='embedding::DOUBLE[]', b='c.v')} AS s,
    row_number() OVER (PARTITION BY vec_id ORDER BY {COSINE.format(a='embedding::DOUBLE[]', b='c.v')} DESC, c.label DESC) AS n FROM embeddings, ({CENTROIDS}) AS c) WHERE n <= {TOP_ONE} AND s >= {LEAST_ONE})"""


def level_one(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    names, matrix = small_matrix(centroids(rows, "label", "embedding"), "label", "vector")
    return assign(rows, "vec_id", "embedding", names, matrix, TOP_ONE, LEAST_ONE)


@query(f"SELECT vec_id, category::BIGINT AS category, round(similarity, 6) AS similarity, rank FROM {ASSIGNED}")
def vec_assign_l1(spark, sf_dir):
    return level_one(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH g AS (SELECT vec_id % 50 AS report_id, category::BIGINT AS category, avg(similarity) AS a, max(similarity) AS m, count(*) AS n FROM {ASSIGNED} GROUP BY 1, 2),
    s AS (SELECT *, 0.4::DOUBLE * a + 0.4::DOUBLE * m + 0.2::DOUBLE * least(n / 5.0::DOUBLE, 1) AS score FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY round(score, 9) DESC, category) AS rank FROM s)
    SELECT report_id, category, n AS n_assignments, round(score, 6) AS score, rank, round_even(100.0::DOUBLE * score / sum(score) OVER (PARTITION BY report_id), 1) AS pct_contribution FROM r WHERE rank <= {TOP_REPORT}""")
def vec_rollup_report(spark, sf_dir):
    rows = level_one(spark, sf_dir).withColumn("report_id", F.col("vec_id") % 50)
    found = roll_up(rows, "report_id", "category", level_one_score(), TOP_REPORT)
    return found.select("report_id", "category", "n_assignments", F.round("score", 6).alias("score"), "rank", "pct_contribution")


CHILDREN = "SELECT label, vec_id % 3 AS part, list(x ORDER BY pos) AS v FROM (SELECT label, vec_id % 3 AS vec_id, pos, avg(embedding[pos]::DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(pos) GROUP BY ALL) GROUP BY ALL"


#: Rank of children that cut across parents.
EXTRA_RANK = 99


def assign_children(
    vectors: DataFrame, key: str, embedding: str, parents: tuple[list, np.ndarray], children: tuple[list, list, np.ndarray], bounds: "Bounds", extra: tuple[list, list, np.ndarray] | None = None
) -> DataFrame:
    """(key, parent, child, similarity, combined, rank): for each of a vector's parent
    categories the best of that parent's children, ranked before the thresholds. Both levels
    are small sides, so one pass over the rows does it all, without a join. ``extra`` are
    (parents, children, vectors) that cut across: each of these parents also gets the best of
    the extra children, with rank EXTRA_RANK."""
    unit, kids = _guarded(parents[1]), _guarded(children[2])
    more = (set(extra[0]), np.array(extra[1]), _guarded(extra[2])) if extra else (set(), np.zeros(0), np.zeros((0, 1)))
    own = {p: np.array([i for i, q in enumerate(children[1]) if q == p], dtype=np.int64) for p in parents[0]}
    rows = of_width(vectors.select(F.col(key).alias("id"), F.col(embedding).alias("v")), "v", unit.shape[1])
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            v = _guarded(_vectors(batch, unit.shape[1]))
            above = v @ unit.T
            order = (unit.shape[0] - 1 - np.argsort(-above[:, ::-1], axis=1, kind="stable"))[:, : bounds.parents]
            out = {n: [] for n in ("row", "parent", "child", "similarity", "combined", "rank")}
            for p, name in enumerate(parents[0]):
                at = np.flatnonzero((order == p).any(1) & (above[:, p] >= bounds.parent))
                groups = [(np.array(children[0])[own[name]], kids[own[name]], bounds.children, 0)]
                if name in more[0]:
                    groups.append((more[1], more[2], 1, EXTRA_RANK - 1))
                for codes, matrix, most, above_rank in groups:
                    if not len(at) or not len(codes):
                        continue
                    below = v[at] @ matrix.T
                    best = (len(codes) - 1 - np.argsort(-np.round(below[:, ::-1], 9), axis=1, kind="stable"))[:, :most]
                    similar = np.take_along_axis(below, best, 1)
                    both = similar * above[at, p][:, None]
                    r, c = np.nonzero((similar >= bounds.child) & (both >= bounds.combined))
                    found = (at[r], np.full(len(r), name), codes[best[r, c]], similar[r, c], both[r, c], c + 1 + above_rank)
                    for column, value in zip(out.values(), found, strict=True):
                        column.append(value)
            joined = {n: np.concatenate(x) if x else np.zeros(0) for n, x in out.items()}
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).take(pa.array(joined["row"].astype(np.int64))),
                **{n: pa.array(joined[n].astype(np.int64)) for n in ("parent", "child")},
                **{n: pa.array(joined[n].astype(np.float64)) for n in ("similarity", "combined")}, "rank": pa.array(joined["rank"].astype(np.int64)),
            })

    schema = f"id {kind}, parent bigint, child bigint, similarity double, combined double, rank bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)


@dataclass(frozen=True)
class Bounds:
    """How many of each level are kept, and the least similarities."""

    parents: int
    parent: float
    children: int
    child: float
    combined: float


_CHILDREN_OF = f"""SELECT l1.vec_id, l1.category::BIGINT AS parent, {{code}} AS child, l1.similarity AS p, {COSINE.format(a='e.embedding::DOUBLE[]', b='k.v')} AS c
    FROM l1 JOIN embeddings AS e USING (vec_id) JOIN kids AS k ON {{on}}"""
_OWN, _EXTRA = _CHILDREN_OF.format(code="k.label * 10 + k.part", on="k.label = l1.category"), _CHILDREN_OF.format(code="900 + k.part", on="k.label = 0 AND l1.category % 2 = 0")
_BEST = f"SELECT vec_id, parent, child::BIGINT AS child, c AS similarity, p * c AS combined, {{rank}} AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, parent ORDER BY round(c, 9) DESC, child DESC) AS rank FROM ({{rows}})) WHERE rank <= {{most}} AND c >= {LEAST_TWO} AND p * c >= {LEAST_BOTH}"
ASSIGNED_TWO = f"(WITH l1 AS {ASSIGNED}, kids AS ({CHILDREN}) {_BEST.format(rank='rank', rows=_OWN, most=TOP_TWO)})"
ASSIGNED_EXTRA = f"(WITH l1 AS {ASSIGNED}, kids AS ({CHILDREN}) {_BEST.format(rank='rank', rows=_OWN, most=TOP_TWO)} UNION ALL {_BEST.format(rank=EXTRA_RANK, rows=_EXTRA, most=1)})"


def level_two(spark, sf_dir, extra: bool = False) -> DataFrame:
    """Within each assigned category, the best of its children, combined with the parent; with
    ``extra``, the children of category 0 also serve all even ones."""
    rows = table(spark, sf_dir, "embeddings")
    child = (F.col("label") * 10 + F.col("vec_id") % 3).cast("bigint").alias("child")
    names, matrix = small_matrix(centroids(rows.select(child, "embedding"), "child", "embedding"), "child", "vector")
    parents = small_matrix(centroids(rows, "label", "embedding"), "label", "vector")
    bounds = Bounds(TOP_ONE, LEAST_ONE, TOP_TWO, LEAST_TWO, LEAST_BOTH)
    crossing = [i for i, n in enumerate(names) if n // 10 == 0]
    more = ([p for p in parents[0] if p % 2 == 0], [900 + names[i] for i in crossing], matrix[crossing]) if extra else None
    return assign_children(rows, "vec_id", "embedding", parents, (names, [n // 10 for n in names], matrix), bounds, more)


@query(f"SELECT vec_id, parent, child, round(similarity, 6) AS similarity, round(combined, 6) AS combined, rank FROM {ASSIGNED_TWO}")
def vec_assign_l2(spark, sf_dir):
    return level_two(spark, sf_dir).withColumns({"similarity": F.round("similarity", 6), "combined": F.round("combined", 6)})


@query(f"SELECT vec_id, parent, child, round(similarity, 6) AS similarity, round(combined, 6) AS combined, rank FROM {ASSIGNED_EXTRA}")
def vec_assign_l2_extra(spark, sf_dir):
    """Second level with children that cut across parents."""
    return level_two(spark, sf_dir, True).withColumns({"similarity": F.round("similarity", 6), "combined": F.round("combined", 6)})


#: Children of a parent that a report shows.
TOP_CHILDREN = 3


def roll_up_children(assigned: DataFrame, report: str, most: int = TOP_CHILDREN) -> DataFrame:
    """Children of each report and parent: score, rank, share of the parent and confidence."""
    found = assigned.groupBy(report, "parent", "child").agg(
        *[f(c).alias(f"{n}_{m}") for c, m in (("similarity", "similarity"), ("combined", "confidence")) for n, f in (("avg", F.avg), ("max", F.max))], F.count("*").alias("n_chunks")
    )
    score = 0.3 * F.col("avg_similarity") + 0.3 * F.col("max_similarity") + 0.2 * F.col("avg_confidence") + 0.2 * F.least(F.col("n_chunks") / 3.0, F.lit(1.0))
    of_parent = Window.partitionBy(report, "parent")
    found = found.withColumn("score", score)
    found = found.withColumn("rank", F.row_number().over(of_parent.orderBy(F.round("score", 9).desc(), "child")).cast("bigint")).where(F.col("rank") <= most)
    return found.withColumns({
        "pct_of_parent": F.bround(100.0 * F.col("score") / F.sum("score").over(of_parent), 1), "combined_confidence": (F.col("avg_confidence") + F.col("max_confidence")) / 2,
    })


@query(f"""WITH g AS (SELECT vec_id % 50 AS report_id, parent, child, avg(similarity) AS a, max(similarity) AS m, avg(combined) AS ca, max(combined) AS cm, count(*) AS n_chunks FROM {ASSIGNED_EXTRA} GROUP BY 1, 2, 3),
    s AS (SELECT *, 0.3::DOUBLE * a + 0.3::DOUBLE * m + 0.2::DOUBLE * ca + 0.2::DOUBLE * least(n_chunks / 3.0::DOUBLE, 1) AS score FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY report_id, parent ORDER BY round(score, 9) DESC, child) AS rank FROM s)
    SELECT report_id, parent, child, n_chunks, round(score, 6) AS score, rank, round_even(100.0::DOUBLE * score / sum(score) OVER (PARTITION BY report_id, parent), 1) AS pct_of_parent, round((ca + cm) / 2, 6) AS combined_confidence
    FROM r WHERE rank <= {TOP_CHILDREN}""")
def vec_rollup_l2(spark, sf_dir):
    """Second level by report: the best children of each parent."""
    found = roll_up_children(level_two(spark, sf_dir, True).withColumn("report_id", F.col("vec_id") % 50), "report_id")
    return found.select("report_id", "parent", "child", "n_chunks", F.round("score", 6).alias("score"), "rank", "pct_of_parent", F.round("combined_confidence", 6).alias("combined_confidence"))


NEIGHBOURS = f"""(SELECT query, vec_id, s AS similarity, n AS rank FROM (SELECT q.vec_id AS query, e.vec_id, round({COSINE.format(a='q.embedding::DOUBLE[]', b='e.embedding::DOUBLE[]')}, 9) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE.format(a='q.embedding::DOUBLE[]', b='e.embedding::DOUBLE[]')}, 9) DESC, e.vec_id) AS n
    FROM embeddings AS q JOIN embeddings AS e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) WHERE n <= 20)"""


def nearest(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 20)


@query(f"SELECT query, vec_id, round(similarity, 6) AS similarity, rank FROM {NEIGHBOURS}")
def vec_knn(spark, sf_dir):
    """Queries are the vectors whose id is divisible by 50, against all vectors."""
    return nearest(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))
