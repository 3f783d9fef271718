import numpy as np
import pytest

from tessera.llm import whitening as W
from tests.conftest import DATA
from tests.llm.helpers import nothing

SCHEMA = "vec_id bigint, embedding array<float>, id string, number int, x double"


def plain(rows, most=32):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} and eigenvalues, by numpy."""
    good = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    centred = np.array(x, float) - np.array(s) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return good, n, deviation, centred @ u[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


def same(df, most=32):
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    good, n, deviation, y, explained = plain(rows, most)
    got = W.whitened(df, most=most).collect()
    assert len(got) == len(good) * y.shape[1] and {r.n for r in got} == {n}
    found = {(r.vec_id, r.component): r for r in got}
    assert all(found[i, 1].deviation == d for (i, _), d in zip(good, deviation, strict=True))
    whitened = np.array([[found[i, c + 1].whitened for c in range(y.shape[1])] for i, _ in good])
    sign = np.sign((whitened * y).sum(0))
    assert np.allclose(whitened, y * sign, atol=1e-8)
    assert np.allclose([found[good[0][0], c + 1].explained for c in range(y.shape[1])], explained, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_equals_numpy(spark):
    same(spark.read.parquet(f"{DATA}/embeddings.parquet"))


def test_several_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 32)
    monkeypatch.setattr(W, "GROUP", 4)
    same(spark.read.parquet(f"{DATA}/embeddings.parquet").repartition(3), 5)


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), "a", 1, None) for i in range(50)]
    odd = [(90, None, None, None, None), (91, [1.0, None, 2.0, 3.0], "b", 2, 0.0), (92, [float("nan")] * 4, "c", 1, 1.0), (93, [float("inf"), 0.0, 0.0, 0.0], "d", 1, 1.0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    same(df)
    # other lengths go, repeated and missing ids are rows of their own
    more = spark.createDataFrame([*rows, (94, [1.0], "e", 1, 1.0), (95, [], "e", 1, 1.0), (None, rows[0][1], "f", 1, 1.0), (3, rows[3][1], "a", 1, 1.0)], SCHEMA)
    got = W.whitened(more).collect()
    assert len(got) == 52 * 4 and sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 3 for r in got) == 8
    assert W.whitened(nothing(spark).selectExpr("doc_id AS vec_id", "array(score) AS embedding")).collect() == []


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 5, [[0.5, 0.25], [0.1, 0.25], [0.5, 0.25]]])
def test_components_without_variance_give_no_rows(spark, vectors):
    got = W.whitened(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == (3 if len(vectors) == 3 else 0) and all(r.identity_error < 1e-9 for r in got)


def test_deviations_stay_exact():
    x = np.array([[1_000_000, 1 << 40], [-5, 3]])
    n, sums = 1 << 24, [7, -(1 << 60)]
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert W.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in exact]
    assert W.deviations(np.array([[1_000_003, 999_999]]), 3, [3_000_000, 3_000_000]) == [81 + 9]
