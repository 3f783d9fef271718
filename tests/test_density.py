import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells as C
from tessera.operators import density as D
from tessera.operators import spectral as S
from tests import plain_density
from tests.conftest import DATA

GRAPH = "query bigint, id bigint, distance double, rank bigint"


def graph(v, k):
    """(query, id, distance, rank) of the k nearest of each, by brute force."""
    apart = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, 1, kind="stable")[:, :k]
    return [(i, int(j), float(apart[i, j]), r + 1) for i, row in enumerate(near) for r, j in enumerate(row)]


def plain_edges(rows, samples):
    core = {}
    for q, _, d, r in rows:
        if r <= samples:
            core[q] = max(core.get(q, 0.0), d)
    edges = {}
    for q, i, d, _ in rows:
        a, b = min(q, i), max(q, i)
        edges[a, b] = min(edges.get((a, b), np.inf), d)
    return [(max(d, core[a], core[b]), a, b) for (a, b), d in edges.items()]


def blobs(rng, sizes, spread, noise, d=4):
    return np.concatenate([rng.normal(size=(n, d)) * spread + rng.uniform(-8, 8, size=d) for n in sizes] + [rng.uniform(-9, 9, size=(noise, d))])


def same_groups(got, want):
    """Equal up to the numbers of topics of one size."""
    names = {}
    for n in want:
        assert names.setdefault(want[n][0], got[n][0]) == got[n][0] and (want[n][0] < 0) == (got[n][0] < 0)
        assert got[n][1] == pytest.approx(want[n][1], rel=1e-9)
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize(("sizes", "noise", "k", "least"), [([300, 200, 120, 80, 60], 240, 12, 20), ([25, 30], 5, 6, 20)])
def test_labels_equal_plain_version(spark, sizes, noise, k, least):
    rng = np.random.default_rng(sum(sizes))
    v = blobs(rng, sizes, 0.6, noise)
    rows = graph(v, k)
    points = spark.createDataFrame([(i,) for i in range(len(v))], "id bigint")
    got = {r.id: (r.topic, r.probability) for r in D.clusters(points, spark.createDataFrame(rows, GRAPH), "id", 4, least).collect()}
    want = plain_density.clusters(range(len(v)), plain_edges(rows, 4), least)
    same_groups(got, want)
    if len(sizes) == 5:
        assert len({t for t, _ in got.values()} - {-1}) >= 4 and 0 < sum(t < 0 for t, _ in got.values()) < 500


def test_equal_lengths_and_repeated_points(spark):
    """Points on a grid: all edges are of few lengths; and points that lie on each other."""
    grid = np.array([(x, y) for x in range(12) for y in range(5)] + [(x + 40, y) for x in range(6) for y in range(6)] + [(100, 100)] * 12, float)
    rows = graph(grid, 5)
    points = spark.createDataFrame([(i,) for i in range(len(grid))], "id bigint")
    got = {r.id: (r.topic, r.probability) for r in D.clusters(points, spark.createDataFrame(rows, GRAPH), "id", 3, 10).collect()}
    same_groups(got, plain_density.clusters(range(len(grid)), plain_edges(rows, 3), 10))


def test_forest_equals_kruskal(spark):
    rng = np.random.default_rng(5)
    edges = sorted({(float(rng.integers(5)), *sorted(rng.choice(200, 2, replace=False).tolist())) for _ in range(400)})
    got = {(r.e.w, r.e.a, r.e.b) for r in D.spanning_forest(spark.createDataFrame([(a, b, w) for w, a, b in edges], "a bigint, b bigint, w double")).collect()}
    assert got == set(plain_density.spanning(range(200), edges))


def plain_embedding(rows, n, dimensions):
    near = [[(i, d) for q, i, d, _ in rows if q == x] for x in range(n)]
    w = np.zeros((n, n))
    for x, own in enumerate(near):
        least, mean = min(d for _, d in own), np.mean([d for _, d in own])
        for i, d in own:
            w[x, i] = np.exp(-(d - least) / max(mean - least, 1e-9))
    w = w + w.T - w * w.T
    degree = w.sum(1)
    e, u = np.linalg.eigh(w / np.sqrt(np.outer(degree, degree)))
    return u[:, np.argsort(-e)[1 : dimensions + 1]] / np.sqrt(degree)[:, None]


def test_embedding_equals_numpy(spark):
    """The space found is numpy's, and keeps as many neighbours."""
    rng = np.random.default_rng(8)
    t = rng.uniform(0, 3 * np.pi, size=150)
    v = np.stack([t * np.cos(t), t * np.sin(t), rng.normal(size=150) * 0.2], 1)  # a spiral
    rows = graph(v, 8)
    near = spark.createDataFrame(rows, GRAPH)
    got = {r.node: r.v for r in S.embedded(near, 2, filters=4).collect()}
    x, y = np.array([got[i] for i in range(len(v))]), plain_embedding(rows, len(v), 2)
    # angles between the two spaces
    assert np.linalg.svd(np.linalg.qr(x)[0].T @ np.linalg.qr(y)[0], compute_uv=False).min() > 0.999
    share = lambda z: S.kept_neighbours(near, spark.createDataFrame(graph(z, 8), GRAPH))
    assert share(x) > 0.5 and abs(share(x) - share(y)) < 0.05


def test_walks_of_a_star_and_a_falling_chain(spark):
    """A point of many neighbours, and a chain of falling edges, arrive in few turns."""
    star = [(1.0 + i / 100, 0, i) for i in range(1, 61)]
    chain = [(2.0 - i / 1000, i, i + 1) for i in range(100, 180)]
    forest = spark.createDataFrame([(e,) for e in star + chain + [(3.0, 60, 100)]], "e struct<w:double,a:bigint,b:bigint>")
    turns, real = [], D.stored
    D.stored = lambda df, label: turns.append(label) or real(df, label)
    try:
        found = D.arrivals(forest, 20)
    finally:
        D.stored = real
    assert len(turns) < 20  # was one turn of seven tables for each point of a chain
    got = {r.node: (r.region, r.arrival.w) for r in found.points.collect()}
    assert all(got[i] == (0, pytest.approx(1 + max(i, 19) / 100)) for i in range(61))
    assert all(got[i] == (161, pytest.approx(2.0 - min(i, 161) / 1000)) for i in range(101, 181))
    assert [(r.ca, r.cb, r.e.w) for r in found.splits.collect()] == [(0, 161, 3.0)]


def test_turns_of_the_embedding_join_values_once(spark):
    edges, degree = S._normalised(S.fuzzy_edges(spark.createDataFrame(graph(np.random.default_rng(2).normal(size=(40, 3)), 4), GRAPH)))
    values = degree.select("node", F.lit(1.0).alias("y"))
    for _ in range(5):
        values = S._multiplied(edges, values, ["y"]).select("node", F.col("ny").alias("y"), F.col("y").alias("p"))
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 5  # they doubled in each turn


@pytest.mark.parametrize("cosine", [True, False])
def test_nearest_of_all_equals_brute_force(spark, monkeypatch, cosine):
    monkeypatch.setattr(C, "PAIRED_ROWS", 60)
    v = np.random.default_rng(4).normal(size=(301, 5)) * (1 if cosine else 1e-4) + (0 if cosine else 1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [1.0]), (None, v[0].tolist())], "id bigint, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    apart = 1 - unit @ unit.T if cosine else np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    found = C.nearest_of_all(rows, "id", "v", 7, cosine).collect()
    got = {(r.query, r.rank): (r.id, r.distance) for r in found}
    assert len(found) == len(got) == 7 * len(v)
    for i, row in enumerate(np.argsort(apart, 1)[:, :7]):
        assert [got[i, r + 1][0] for r in range(7)] == row.tolist()
        assert np.allclose([got[i, r + 1][1] for r in range(7)], apart[i, row], rtol=1e-4 if cosine else 1e-6, atol=1e-7 if cosine else 0)


def test_nearest_of_all_of_copies_and_few(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "id bigint, v array<double>")
    found = C.nearest_of_all(rows, "id", "v", 5).collect()
    assert len(found) == 150 and all(r.query != r.id and abs(r.distance) < 1e-6 for r in found)
    assert {(r.query, r.id) for r in C.nearest_of_all(rows.where("id < 3"), "id", "v", 5).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert C.nearest_of_all(rows.where("false"), "id", "v", 5).collect() == []


def test_nothing(spark):
    none, points = spark.createDataFrame([], GRAPH), spark.createDataFrame([(1,), (2,)], "id bigint")
    assert sorted(map(tuple, D.clusters(points, none, "id").collect())) == [(1, -1, 0.0), (2, -1, 0.0)]
    assert D.clusters(points.where("false"), none, "id").collect() == []


def test_outlier_share(spark):
    rows = spark.createDataFrame([(1, -1), (2, 0), (3, 0), (4, 1)], "id int, topic int")
    assert tuple(D.outlier_share(rows).first()) == (2, 1, 25.0)


def test_cells_find_nine_tenths(spark):
    from tessera.operators.vectors import neighbours

    rows = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/embeddings.parquet")
    queries = rows.where("vec_id % 50 = 0")
    want = {(r.query, r.vec_id): r.similarity for r in neighbours(rows, queries, "vec_id", "embedding", 20).collect()}
    found = C.nearest(rows, queries, "vec_id", "embedding").collect()
    got = {(r.query, r.id): 1 - r.distance for r in found}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-6 for p in got.keys() & want.keys())
    assert max(r.rank for r in found) == 20


def test_cells_read_a_tenth_where_vectors_lie_in_groups(spark, monkeypatch):
    """Recall, and rows that queries meet; one group is a sixth of all and dealt into blocks."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(n, 8)) + rng.normal(size=8) * 20 for n in [600] + [50] * 60])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    queries = rows.where("id % 50 = 0")
    cells = C.fit(rows, "id", "v", 10, cosine=False)
    index = C.indexed(rows, "id", "v", cells)
    read = C.visits_of(queries, "id", "v", cells).join(index.groupBy("cell").count(), "cell").groupBy().sum("count").first()[0]
    assert read < 0.1 * len(v) * queries.count()
    want = {(i, j) for i, j, _, _ in graph(v, 10) if i % 50 == 0}
    got = {(r.query, r.id) for r in C.nearest(rows, queries, "id", "v", 10, cosine=False, cells=cells, index=index).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_cells_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [1.0]), (5, [None, 1.0]), (None, [1.0, 0.0]), (6, [0.0, 0.0])], "id bigint, v array<double>")
    got = {(r.query, r.id) for r in C.nearest(rows, rows, "id", "v", 5).collect()}
    assert got == {(a, b) for a in (1, 2, 6) for b in (1, 2, 6) if a != b}
    assert C.nearest(rows.where("false"), rows, "id", "v", 5).collect() == []
