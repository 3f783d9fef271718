import hashlib
import random
import zlib

import pytest

from tessera.llm.merkle import manifest
from tests.conftest import DATA
from tests.llm.helpers import awkward, nothing


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    """Root, and each leaf's runs as (others left, others right) level by level."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 16 * 16 : p // 16 * 16 + 16]
            ways[i].append((run[: p % 16], run[p % 16 + 1 :]))
        level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], ways


def plain(rows):
    leaf = lambda r, text: H(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    of, out = {}, []
    for r in rows:
        of.setdefault(r.source, []).append(r)
    order = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        of[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append(tree([leaf(r, r.text) for r in of[s]]))
    root, above = tree([t[0] for t in trees])
    for s, (subroot, ways), top in zip(order, trees, above, strict=True):
        for r, way in zip(of[s], ways, strict=True):
            way = way + top
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if changed else r.text
            h = leaf(r, text)
            for left, right in way:
                h = H(*left, h, *right)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, H(*[d for left, right in way for d in left + right]), h, h == root))
    return out


def same(docs):
    key = lambda r: tuple(map(str, r))
    got, want = sorted(map(tuple, manifest(docs).collect()), key=key), sorted(plain(docs.collect()), key=key)
    assert got == want
    return got


def test_manifest_equals_brute_force(spark):
    got = same(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert {r[6] for r in got} == {True, False}


def test_awkward_rows(spark):
    assert len(same(awkward(spark))) == awkward(spark).count()
    assert manifest(nothing(spark)).collect() == []
    assert manifest(nothing(spark)).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16], [17], [257], [4200], [1] * 20, [1, 300, 2, 17], [40] * 18])
def test_shapes_of_trees(spark, sizes):
    """Lone leaves, full and ragged runs, many sources, one source over several tasks."""
    rng = random.Random(3)
    rows = [(10_000 * s + i, rng.choice(["Ab", "xyz", None, ""]), "en", f"s{s}" if s else None, i) for s, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    same(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))


def test_a_changed_leaf_is_told(spark):
    """Only rows whose text changes when lower-cased fail, and each of them does."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in manifest(docs).collect():
        tampered = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r.doc_id] or "")
        assert r.verified == (not tampered)
