"""Token counts, cuts and chunks by a vocabulary file, against the library's own ids."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.functions.tokens import Vocabulary, token_chunks
from tessera.operators.chunking import LEAST_TOKENS, MOST_TOKENS, chunk_table
from tests.conftest import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "one", "  two words ", "añb 日本語 \U0001f642\U0001f643 x\n\n\ty", "word " * 3000, "\U0001f642" * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_windows_hold_all_tokens_and_all_text(text):
    v, ids = Vocabulary(PATH), Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert v(text) == len(ids)
    for size in (1, 7, 600):
        got = list(v.windows(text, size))
        assert "".join(w["chunk_text"] for w in got) == text if ids else not got
        assert [w["n_tokens"] for w in got] == [min(size, len(ids) - i) for i in range(0, len(ids), size)]
    starts = [w["first_token"] for w in v.windows(text, 10, 4)]
    assert starts == [i for i in range(0, len(ids), 6) if i == 0 or i + 4 < len(ids)]


@pytest.mark.parametrize("text", TEXTS)
def test_truncated_texts_have_at_most_as_many_tokens(text):
    v = Vocabulary(PATH)
    for most in (0, 1, 5, 100, 10_000):
        cut = v.truncated(text, most)
        assert text.startswith(cut) and v(cut) <= most
        assert cut == text or v(text) > most


def test_chunks_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    v = Vocabulary(PATH)
    by_id: dict[int, int] = {}
    for r in token_chunks(docs, v, 50, 0).collect():
        by_id[r.doc_id] = by_id.get(r.doc_id, 0) + r.n_tokens
    assert by_id == {r.doc_id: v(r.text) for r in docs.collect() if r.text}
    assert token_chunks(docs.limit(0), v).count() == 0
    with pytest.raises(ValueError):
        token_chunks(docs, v, 50, 50)
    extra = spark.createDataFrame([(1, None, 3), (1, "a b", None), (1, "a b", 4)], "doc_id int, text string, place int")
    assert sorted((r.doc_id, r.chunk_text) for r in token_chunks(extra, v).collect()) == [(1, "a b")] * 2


def test_sentence_chunks_keep_real_token_limits(spark):
    """With a vocabulary as counter, packed tokens are in range but for last chunks and long sentences."""
    text = " ".join(f"Sentence number {i} tells of the flight and of its crew." for i in range(400))
    rows = chunk_table(spark.createDataFrame([(1, text)], "doc_id int, text string"), count=Vocabulary(PATH)).orderBy("chunk_sequence").collect()
    assert len(rows) > 3 and all(LEAST_TOKENS <= r.packed_tokens <= MOST_TOKENS for r in rows[:-1])
    assert all(r.token_count == Vocabulary(PATH)(r.chunk_text) for r in rows)


def test_ends_are_those_of_the_whole_text(spark, monkeypatch):
    """Texts cut at words give the library's own ends, whatever white space, special strings or
    characters of several tokens they hold; a word that comes again is not encoded again."""
    import random

    from tessera.functions import tokens

    rng, asked = random.Random(8), []
    bits = ["word", "Don't", "it's", "12", "x9", "日本語", "\U0001f642", "añb", ",", "...", " ", " ", " ", "\n", "\n", "\t", "\u00a0", "\x1c", "\u2028", "\r\n", "<|endoftext|>", "\x85", "\u0301"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(3_000)]
    texts += [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for t in texts:
        want = tokens._ends(PATH, t)
        assert Vocabulary(PATH).ends(t) == want[:-1] + [len(t)] * bool(want)
    plain = tokens._ends
    monkeypatch.setattr(tokens, "_ends", lambda path, text: asked.append(text) or plain(path, text))
    Vocabulary(PATH).ends("again and again " * 500)
    assert len(asked) <= 4
