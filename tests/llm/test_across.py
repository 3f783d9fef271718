"""Pairs across components: with those that ``_across`` gives, components are those of all pairs."""

import random

import numpy as np
import pytest

from tessera.llm import simhash as H


def joined(component, links):
    """Components after all ``links``, the least of each."""
    of = dict(component)
    for a, b in links:
        x, y = of[a], of[b]
        of = {i: min(x, y) if c in (x, y) else c for i, c in of.items()}
    return of


@pytest.mark.parametrize("trial", range(4))
def test_components_equal_those_of_all_pairs(spark, trial):
    """Copies at all distances, most of them not yet in the main component, so that members alike
    to its node, and pairs that the node alone tells to be alike, occur too."""
    rng = random.Random(100 + trial)
    base = [rng.getrandbits(60) for _ in range(80)]
    pool = [rng.getrandbits(60) for _ in range(20)]
    sets = {0: base}
    for i in range(1, 120):
        own = list(base)
        for _ in range(rng.choice((0, 1, 3, 8, 12, 16, 24))):
            own[rng.randrange(len(own))] = rng.choice(pool) if rng.random() < 0.5 else rng.getrandbits(60)
        if rng.random() < 0.3:
            own = own[: rng.randrange(50, 80)]
        sets[i] = own
    sets = {i: np.unique(np.array(x, dtype=np.uint64)) for i, x in sets.items()}
    alike = {(i, j) for i in sets for j in sets if i < j and H.alike(sets[i], sets[j])}
    component = {i: 0 if (0, i) in alike and rng.random() < 0.3 else i for i in sets}
    split = spark.createDataFrame([(1, 0, i, c) for i, c in component.items()], "key bigint, main bigint, id bigint, component bigint")
    stored = spark.createDataFrame([(i, x.tobytes()) for i, x in sets.items()], "id bigint, hashes binary")
    got = {tuple(sorted((r.a, r.b))) for r in H._across(split, stored).collect()}
    assert all(a != b for a, b in got)
    assert joined(component, got & alike) == joined(component, alike)


def test_copies_changed_in_their_own_ways_meet_none(spark):
    """As many members as asked for, each with changes of its own that part it from all others."""
    rng = random.Random(7)
    base = [rng.getrandbits(60) for _ in range(200)]
    sets = {0: base}
    for i in range(1, 300):
        own, changes = list(base), 10 if i < 150 else 30
        for at in rng.sample(range(200), changes):
            own[at] = rng.getrandbits(60)
        sets[i] = own
    rows = [(1, 0, i, 0 if i < 150 else i) for i in sets]
    split = spark.createDataFrame(rows, "key bigint, main bigint, id bigint, component bigint")
    stored = spark.createDataFrame([(i, np.unique(np.array(x, dtype=np.uint64)).tobytes()) for i, x in sets.items()], "id bigint, hashes binary")
    assert H._across(split, stored).count() == 0


def test_members_are_tallied_before_they_are_dealt_by_key(spark, monkeypatch):
    """Keys that many members of one component share make a row a batch, and only members of
    keys with several components are named by key."""
    rows, component, rng = [], {}, random.Random(3)
    for i in range(2_000):
        component[i] = 0 if i < 1_900 else rng.choice((0, i))
        rows += [(k, i) for k in range(40)] if i < 1_500 else [(100 + i % 7, i), (200 + i % 3, i)]
    members = spark.createDataFrame(rows + rows[:5], "key bigint, id bigint")
    grouped = spark.createDataFrame([(i, c) for i, c in component.items() if i % 50 or c != i], "node bigint, component bigint")
    made, real = [], H.map_rows
    monkeypatch.setattr(H, "map_rows", lambda *x: made.append(real(*x)) or made[-1])
    got = {tuple(r) for r in H._split(members, grouped).collect()}
    assert made and made[0].count() < len(rows) / 10
    by_key = {}
    for k, i in rows:
        by_key.setdefault(k, {}).setdefault(component[i], []).append(i)
    want = set()
    for k, of in by_key.items():
        main = max((len(x), c) for c, x in of.items())[1]
        want |= {(k, main, i, c) for c, x in of.items() for i in x} if len(of) > 1 else set()
    assert got == want and want
