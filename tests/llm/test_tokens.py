import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing as P
from tessera.llm.token_counts import TokenCounter, token_counts
from tests.conftest import DATA
from tests.llm.helpers import awkward, nothing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = P.Encoder(open(PATH, "rb").read(), 7)
COUNTER = TokenCounter(open(PATH, "rb").read())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_count_equals_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [" a  b ", "x" * 5000, "<|endoftext|>a<|endoftext|>", "\n\n a\n", " it's we'll", "a　 b"])
def test_count_of_awkward_texts(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_counts_of_tables(spark):
    for docs in (awkward(spark), spark.read.parquet(f"{DATA}/documents.parquet")):
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = sorted((str(i), len(t.encode()), n := len(LIBRARY.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()) == want
    assert token_counts(nothing(spark), PATH).count() == 0


def check_packing(pieces, ids, window=1024):
    place, sequences = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == place.get(r.doc_id, 0) and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        place[r.doc_id] = r.start + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert place == {i: len(x) for i, x in ids.items()}
    padding = 0
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    assert padding == 0 and sorted(sequences) == list(range(len(sequences)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.,'’ \n\t\x1c\u3000é日1") , max_size=30), min_size=1, max_size=6))
def test_ids_equal_the_library(texts):
    ids, n = ENCODER.encode(pa.array(texts))
    ends = np.cumsum(n)
    for text, a, b in zip(texts, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 7]


def test_ids_of_special_strings_and_a_full_cache(monkeypatch):
    texts = ["<|endoftext|> a", "b<|endoftext|>", "plain text", "", "two  spaces", "line\nfeed", "\nfirst", "last\n"]
    for bound in (1_000_000, 3):
        monkeypatch.setattr(P.bpe, "CACHE", bound)
        for _ in range(2):
            ids, n = ENCODER.encode(pa.array(texts))
            assert ids.tolist() == [i for t in texts for i in [*LIBRARY.encode(t, add_special_tokens=False).ids, 7]] and n.sum() == len(ids)


def test_residuals_are_packed_greedily():
    left = np.zeros(65, dtype=np.int64)
    left[[40, 24, 30, 34, 50, 63]] = [10, 10, 4, 4, 3, 2]
    fills = P.greedy_fills(left, 64)
    assert sorted((lengths.tolist(), n) for lengths, _, n in fills) == [([24, 40], 10), ([30, 34], 4)]
    assert left[50] == 3 and left[63] == 2 and left.sum() == 5


def ids_of(docs):
    return {r.doc_id: np.array([*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in docs.collect()}


def test_packing_places_every_id_once(spark):
    for docs in (spark.read.parquet(f"{DATA}/documents.parquet"), awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])):
        check_packing(P.pack(docs.repartition(3), PATH).collect(), ids_of(docs))


def test_packing_repeated_rows_and_empty_table(spark):
    docs = awkward(spark)
    pieces = P.pack(docs, PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    assert sum(r.length for r in pieces) == sum(len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert P.pack(nothing(spark), PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=64, max_size=64), st.integers(0, 3))
def test_plans_fill_windows(counts, mode):
    window = 64
    histogram = np.array(counts, dtype=np.int64) * (1 if mode else 0)
    if mode == 2:
        histogram[37] = 5000
    plan = P.make_plan(histogram, window)
    filled = {}
    for length in range(1, window):
        for number in range(histogram[length]):
            got = P.slots(plan, length, number)
            assert sum(n for *_, n in got) == length
            for sequence, offset, n in got:
                filled.setdefault(sequence, []).append((offset, n))
    for parts in filled.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end == window or end & (end - 1) == 0


def test_least_squares_uses_most_rests():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 256, 20_000), minlength=256)
    combos = P.combinations_filling(256)
    repeats = P.whole_repeats(combos, P.solve_repeats(combos, histogram.astype(float)), histogram)
    used = sum(np.bincount(combos[:, j], repeats, 256) for j in range(3))
    assert (used[1:] <= histogram[1:]).all() and used[1:].sum() > 0.95 * histogram[1:].sum()
