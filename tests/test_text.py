import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as C


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


GOOD = "The aircraft was climbing through the clouds when the left engine lost all power without warning. "


@pytest.mark.parametrize(
    ("text", "reason"),
    [(GOOD, None), ("", "empty_text"), (None, "empty_text"), ("ABC", "too_short"), ("�" * 20, "too_short"), ("a" * 100, "few_words"), ("�" * 60, "low_alpha_ratio"), ("é" * 60 + " abc" * 3, "high_garbage_ratio")],
)
def test_page_quality_reasons(spark, text, reason):
    assert one(spark, text, T.page_quality).reason == reason


def test_page_quality_ratios_round_half_even(spark):
    q = one(spark, GOOD, T.page_quality)
    assert q.char_count == len(GOOD)
    assert q.alphabetic_ratio == round(sum(c.isalpha() for c in GOOD) / len(GOOD), 4)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("aero-\nplane", "aeroplane"), ("a   b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("x\n- 17 -\ny", "x\n\ny"), ("l|st", "lIst"), ("  x  ", "x"), (None, "")],
)
def test_normalized(spark, raw, want):
    got = one(spark, raw, T.normalized)
    assert got == want or re.sub(r"\n+", "\n", got) == re.sub(r"\n+", "\n", want)


LEADER, REFERENCE = "Section name ........ 12\n", "History of Flight 12\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [("TABLE OF CONTENTS\n" + "x" * 60, True), (LEADER * 5, True), (REFERENCE * 8, True), (GOOD, False), ("CONTENTS", False), (None, False)],
)
def test_contents_pages(spark, text, want):
    assert one(spark, text, T.is_contents) is want


def test_skip_reasons_keep_their_order(spark):
    assert one(spark, "  ", T.skip_reason) == "empty_page"
    assert one(spark, "short", T.skip_reason) == "cover_page"
    assert one(spark, LEADER * 20, T.skip_reason) == "toc_page"
    assert one(spark, GOOD * 5, T.skip_reason) is None


@pytest.mark.parametrize(
    ("text", "pieces"),
    [("One two. Three four.", 2), ("1. The start", 1), ("1.1. The start", 1), ("See 17. The next", 2), ("Boeing 737. The next", 2), ("In 2000. The next", 2), ("Stop! The next", 2), ("Why? The next", 2)],
)
def test_sentences(spark, text, pieces):
    got = one(spark, text, T.sentences)
    assert len(got) == pieces
    assert got == [p.strip() for p in re.split(T.SENTENCE_BREAK, text) if p.strip()]


@pytest.mark.parametrize(("raw", "want"), [("1/5/1999", "1999-01-05"), ("", ""), ("June 1999", "June 1999"), ("12/31/2001", "2001-12-31")])
def test_iso_date(spark, raw, want):
    assert one(spark, raw, T.iso_date) == want


def test_small_text_functions(spark):
    assert one(spark, "<a>&{b}", T.html_escaped) == "&lt;a&gt;&amp;{{b}}"
    assert one(spark, "x" * 501, T.preview) == "x" * 500 + "..."
    assert one(spark, "see 1/ and crash2/ then 1/ ok */", T.footnote_references) == ["1", "crash2", "*"]
    assert one(spark, "1. 8 .2", T.section_number) == "1.8.2"
    assert one(spark, "TABLE OF CONTENTS\n" + LEADER * 10, T.contents_score) == pytest.approx(0.8)


@pytest.mark.parametrize(("a", "b", "want"), [("1", "1.1", True), ("1", "2.1", False), ("1", "1.1.1", True), ("1.1", "1.2", False), ("1.1", "1.1.1", True), (None, "1", False)])
def test_children(spark, a, b, want):
    assert C.is_child(a, b) is want
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.is_subsection_of(F.col("b"), F.col("a")).alias("x")).first()
    assert row.x is want


def test_parent_header_merges_into_its_child():
    text = "1. THE ACCIDENT\n1.1 HISTORY OF FLIGHT\n" + GOOD * 3 + "\n1.2 INJURIES TO PERSONS\n" + GOOD
    first, second = C.sections_of(text)
    assert (first.name, first.number) == ("THE ACCIDENT > HISTORY OF FLIGHT", "1.1")
    assert (second.name, second.end) == ("INJURIES TO PERSONS", len(text))
    assert first.end == second.start


def test_paragraphs_and_no_structure():
    text = "\n\n".join([GOOD * 2] * 4)
    assert [s.name for s in C.sections_of(text)] == [f"PARAGRAPH_{i}" for i in range(1, 5)]
    assert [s.name for s in C.sections_of(GOOD)] == ["DOCUMENT"]


def test_footnotes():
    text = "Body 1/ here.\n1/ First note\nstill it.\n2/ Second\nword1/ A word note\n"
    notes = C.footnotes_of(text)
    assert ("1", "First note still it.") in notes
    assert C.with_footnotes("t", ["2", "9", "2"], {"2": "n"}) == "t\n\n---\nFootnotes:\n[2/ n]"


def test_chunks_begin_with_their_section():
    chunks = list(C.chunks_of("SYNOPSIS\n" + GOOD * 3))
    assert chunks[0]["chunk_text"].startswith("[SYNOPSIS]")
    assert list(C.chunks_of("")) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 900), min_size=1, max_size=60))
def test_chunks_cover_every_sentence_once(sizes):
    text = " ".join(f"S{i}" + "x" * (4 * n) + "z." for i, n in enumerate(sizes))
    chunks = list(C.chunks_of(text))
    assert [c["chunk_sequence"] for c in chunks] == list(range(len(chunks)))
    assert sum(c["n_sentences"] for c in chunks) == len(sizes)
    assert all(c["packed_tokens"] <= C.MOST_TOKENS or c["n_sentences"] == 1 for c in chunks)
    assert all(c["overlap_tokens"] <= C.OVERLAP_TOKENS + 5 for c in chunks)
