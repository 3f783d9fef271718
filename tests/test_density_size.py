"""Density topics on larger inputs: what each step reads, and that it is the same as the plain way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells as C
from tessera.operators import density as D
from tessera.operators import spectral as S
from tests.test_density import GRAPH, graph


def kept_tables(monkeypatch, module):
    found, real = {}, module.stored
    monkeypatch.setattr(module, "stored", lambda df, label: found.setdefault(label, []).append(real(df, label)) or found[label][-1])
    return found


def nearest(v, k):
    return {(q, r): (i, d) for q, i, d, r in graph(v, k)}


def test_neighbours_in_few_dimensions_visit_few_boxes(spark, monkeypatch):
    """Also with 600 equal points, more than a box holds, and a point far from all."""
    monkeypatch.setattr(C, "BOX_ROWS", 100)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=(1200, 3)), np.full((600, 3), 0.5), [[1e3, 0, 0]]])
    tables = kept_tables(monkeypatch, C)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    got = {(r.query, r.rank): (r.id, r.distance) for r in C.nearest_of_all(rows, "id", "v", 6, cosine=False).collect()}
    want = nearest(v, 6)
    assert got.keys() == want.keys() and all(got[x][1] == pytest.approx(want[x][1], rel=1e-9, abs=1e-12) for x in want)
    assert all(got[x][0] == want[x][0] for x in want if want[x][1] > 0)
    first = tables["first"][0]
    boxes = tables["boxes"][0].select("box").distinct().count()
    met = first.where("query < 1200").agg(F.avg(F.size("to"))).first()[0]
    assert boxes > 15 and met < 0.5 * boxes  # all rows met all before


@pytest.mark.parametrize("single", [True, False])
def test_closest_of_many_columns_and_equal_rows(single):
    """Of equal rows those of least id, wherever they lie; and all that is within a distance."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 24))
    v[1000:1400] = v[7]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = rng.permutation(3000)
    there = C.Leaves.of(v, ids, single)
    apart = np.round(1 - v @ v.T if single else np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 12)
    apart[np.arange(3000), np.arange(3000)] = np.inf
    want = ids[np.lexsort((np.broadcast_to(ids, apart.shape), apart))[:, :9]]
    for within in (None, np.sort(apart, 1)[:, 4]):
        for some, got, _ in C._asked(there, there, 9, single, within):
            n = 9 if within is None else 5
            assert (got[:, :n] == want[some][:, :n]).all()
        if single:
            break


def test_cuts_keep_equal_rows_together():
    v = np.concatenate([np.zeros((500, 2)), np.random.default_rng(1).normal(size=(500, 2))])
    box = C.Cuts.of(v, 8).box(v)
    assert len(set(box[:500])) == 1 and 4 <= len(set(box)) <= 8
    assert (C.Cuts.of(np.zeros((9, 2)), 4).box(np.zeros((9, 2))) == 0).all()


def test_turns_by_blocks_equal_turns_by_joins(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BLOCKS", 5)
    rows = spark.createDataFrame(graph(np.random.default_rng(3).normal(size=(90, 3)), 4), GRAPH)
    edges = S.fuzzy_edges(rows)
    held = S.blocked(edges, 2)
    start = held.select("block", F.lit(-1).alias("source"), F.lit(None).cast("binary").alias("ids"), F.col("start").alias("v"))
    sent = S._turn(held, start, 2, lambda y, _: (y, y))
    # a block tells another one a row, not a row an edge
    assert sent.count() <= 5 * 5 + 5
    heard = S._turn(held, sent, 2, lambda y, heard: (heard, None)).join(held, "block").collect()
    got = {int(n): x for r in heard for n, x in zip(np.frombuffer(r.nodes, np.int64), np.frombuffer(r.v).reshape(-1, 2), strict=True)}
    joined, degree = S._normalised(edges)
    values = degree.select("node", *[(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5).alias(f"y{i}") for i in range(2)])
    want = {r.node: (r.ny0, r.ny1) for r in S._multiplied(joined, values, ["y0", "y1"]).collect()}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=1e-12) for n in want)


def test_embedding_of_nothing(spark):
    assert S.embedded(spark.createDataFrame([], GRAPH)).collect() == []


@pytest.mark.parametrize("most", [10_000, 300, 40])
def test_most_walks_end_among_points_that_come_together(spark, monkeypatch, most):
    """A tree of 400 points, in parts that hold it or that cut it: the same walks; they took a
    turn of all points for each doubling."""
    rng = np.random.default_rng(9)
    edges = [(float(rng.uniform()), int(rng.integers(max(0, i - 6), i)), i) for i in range(1, 400)]
    forest = spark.createDataFrame([(e,) for e in edges], "e struct<w:double,a:bigint,b:bigint>")
    monkeypatch.setattr(D, "PART_POINTS", most)
    tables = kept_tables(monkeypatch, D)
    got = {r.node: (r.w, r.to, r.done) for r in D._walks(forest, 20).collect()}
    ahead = D._ahead([e for w, a, b in edges for e in ((w, a, b, True), (w, b, a, True))])
    for node in range(400):
        want, _ = D._walk(node, ahead, 20)
        assert got[node] == ([e[0] for e in want], [e[2] for e in want], True)
    if most == 300:
        assert "parts" in tables
    if most == 10_000:
        assert tables["walks"][0].where("not done").count() == 0
