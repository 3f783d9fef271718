"""Exact percentiles against numpy, on groups with nulls, ties and one hot group."""

import random

import numpy as np
import pytest

from tessera.operators.percentiles import exact_percentiles

SHARES = {"low": 0.025, "mid": 0.5, "p95": 0.95, "top": 1.0}


def test_percentiles_of_awkward_groups(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([1.0, 2.0, rng.random() * 9])) for _ in range(3000)] + [("one", 4.0), ("none", None), ("none", None), (None, 1.0), (None, 2.0), ("ties", 3.0), ("ties", 3.0), ("ties", None)]
    got = {r.g: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), {"g": "g"}, "v", SHARES).collect()}
    assert set(got) == {"hot", "one", "none", None, "ties"}
    for g, r in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        for name, share in SHARES.items():
            assert r[name] == (pytest.approx(np.quantile(values, share)) if values else None)


def test_percentiles_without_groups(spark):
    df = spark.range(1, 11)
    assert exact_percentiles(df, {}, "id", {"mid": 0.5}).collect()[0].mid == 5.5
    assert exact_percentiles(df.where("id < 0"), {}, "id", {"mid": 0.5}).count() == 0
