"""Chunks of documents read page by page equal those of whole documents."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators.assemble import SEPARATOR, documents_of

LINES = [
    "The engine was found intact after the fire and nothing else had been moved.", "It stopped. Nobody saw why. The engine was found.", "ANALYSIS", "3.", ". FINDINGS", "2. ANALYSIS", "2.1 FIRE", "2 . 3 WRECKAGE",
    "(a)", "(a) Findings", "(b)", "Probable Cause", "", "", "  ", "\x85", "　", "7/ A note of some words.", "See 7/ there.", "x",
]


def pages_of(rng, n, lines):
    return ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))).strip(" \t\n\x0b\f\r") for _ in range(n)]


def mode_of(text):
    if any(s.method == "pattern_match" for s in C.sections_of(text)):
        return C.HEADERS
    runs = sum(1 for _ in C.BLANK_LINES.finditer(text))
    return C.PARAGRAPHS if len(text) >= C.PARAGRAPH_MEAN * (runs + 1) else C.WHOLE


@pytest.mark.parametrize("lines", [LINES, LINES[:2] + LINES[12:], LINES[:1] * 6 + LINES[12:]])
def test_sections_of_a_stream(lines):
    rng, modes = random.Random(len(lines)), set()
    for _ in range(1500):
        pages = pages_of(rng, rng.randrange(1, 7), lines)
        text = SEPARATOR.join(pages)
        modes.add(mode := mode_of(text))
        assert list(C.section_stream(iter(pages), mode)) == [(s, text[s.start : s.end]) for s in C.sections_of(text)]
    assert modes == ({C.HEADERS, C.PARAGRAPHS, C.WHOLE} if lines is LINES else {C.PARAGRAPHS, C.WHOLE})


@pytest.mark.parametrize("mode", [C.PARAGRAPHS, C.HEADERS])
def test_a_section_comes_before_the_pages_after_it_are_read(mode):
    read = []

    def pages():
        for i in range(1000):
            read.append(i)
            yield "ANALYSIS\n" * (mode == C.HEADERS) + LINES[0] * 3

    found = C.section_stream(pages(), mode)
    for _ in range(3):
        next(found)
    assert len(read) < 8


def test_page_chunks_equal_chunks_of_whole_documents(spark):
    """All kinds of sections, also with a header that a page begins and the next ends; a plan in
    which no texts are put together."""
    rng = random.Random(11)
    pages = []
    for d in range(48):
        lines = [LINES, LINES[:2] + LINES[12:], LINES[:1] * 6 + LINES[12:]][d % 3]
        for n, text in enumerate(pages_of(rng, rng.randrange(1, 9), lines)):
            pages.append((f"r{d}", n, text + "\n" + " ".join(rng.choice(LINES[:2]) for _ in range(rng.randrange(40))), rng.choice(["user", "ocr"]), rng.random(), float(n)))
    pages += [("cross", 0, LINES[0] * 4 + "\n3", "ocr", 0.1, 1.0), ("cross", 1, ". FINDINGS\n" + LINES[0] * 4, "user", 0.2, 2.0)]
    df = spark.createDataFrame(pages, "id string, n int, t string, src string, a double, c double")
    found = C.page_chunks(df, "id", "n", "t", "src", F.col("a"), F.col("c"))
    kept = df.where(C.skip_reason(F.col("t")).isNull()).withColumn("t", C.normalized(F.col("t")))
    docs = documents_of(kept, "id", "n", "t", "src", "a", "c").join(C.footnote_maps(df, "id", "n", "t"), "id", "left")
    whole = C.chunk_table(docs, "id", "full_text", C.token_count, "notes", "pages", "primary_source")
    want = {(r.id, r.chunk_sequence): r for r in whole.collect()}
    got = {(r.id, r.chunk_sequence): r for r in found.collect()}
    assert got.keys() == want.keys() and {r.method for r in want.values()} == {"pattern_match", "paragraph_fallback", "no_structure"}
    for at, r in got.items():
        w = want[at]
        for c in ("chunk_id", "section_name", "section_number", "method", "char_start", "char_end", "token_count", "overlap_tokens", "footnotes", "sections_spanned", "chunk_text"):
            assert r[c] == w[c], (at, c)
        assert r.page_list == ",".join(str(p.n) for p in w.pages)
        sources = {p.src for p in w.pages}
        assert r.text_source == ("mixed" if len(sources) > 1 else [*sources, w.primary_source][0])
    assert any(r.section_number == "3" and r.section_name == "FINDINGS" for r in got.values() if r.id == "cross")
    assert "full_text" not in found._jdf.queryExecution().optimizedPlan().toString()
