"""Chunking tables against the plain versions, on structured texts and on the documents."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators.assemble import documents_of, source_quality
from tessera.plans.all import QUERIES
from tests import plain_chunks as P
from tests.conftest import DATA


def word_count(text):
    return len(text.split())


def structured(seed):
    """A text with headers, lettered headers, empty parents, paragraphs or none of these."""
    rng = random.Random(seed)
    words = ["engine", "the", "flap", "was", "No", "Captain", "at", "07.", "350.", "speed!", "end."]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    kind = rng.randrange(4)
    if kind == 0:
        return rng.choice(["", "  \n ", body(rng.randrange(1, 60))])
    if kind == 1:
        return "\n\n".join(body(rng.randrange(5, 80)) for _ in range(rng.randrange(1, 6)))
    out = [body(20)] if rng.random() < 0.5 else []
    for i in range(rng.randrange(1, 7)):
        name = rng.choice(["Analysis", "CONCLUSIONS", "Probable Cause", "FIRE", "Wreckage and Impact Information", "Synopsis"])
        out.append(rng.choice([name, f"1. {i} {name}", f"{i} {name}", f"{i}.1. {name}", f"({rng.choice('ab')}) Findings"]))
        out.append("" if rng.random() < 0.3 else body(rng.randrange(1, 400)))
    return "\n".join(x for x in out if x)


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect()
    return dict(enumerate([structured(i) for i in range(200)] + [r.text for r in docs]))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)


def by_doc(rows, *columns):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return out


def test_sections_equal_the_plain_ones(docs, texts):
    got = by_doc(C.section_table(docs).orderBy("doc_id", "start").collect(), "name", "number", "start", "end", "method")
    assert got == {i: s for i, t in texts.items() if (s := P.sections(t or ""))}


def test_chunks_equal_the_plain_ones(docs, texts):
    for count in (C.token_count, word_count):
        got = by_doc(C.chunk_table(docs, count=count).orderBy("doc_id", "chunk_sequence").collect(), "char_start", "char_end", "token_count", "overlap_tokens", "chunk_text")
        assert got == {i: c for i, t in texts.items() if (c := P.chunks(t or "", count))}


def test_three_paragraphs_are_sections():
    text = "\n\n".join("x" * 200 for _ in range(3))
    assert [s.name for s in C.sections_of(text)] == ["PARAGRAPH_1", "PARAGRAPH_2", "PARAGRAPH_3"]
    assert C.sections_of(" \n ") == [] and list(C.chunks_of(" \n ")) == []


def test_section_statistics_and_positions(spark, docs, texts):
    sections = C.section_table(docs)
    got = {r.doc_id: r for r in C.section_statistics(sections, "doc_id").collect()}
    for i, t in texts.items():
        want = P.sections(t or "")
        assert (i in got) == bool(want)
        if want:
            lettered = sum(s[0].startswith("(") for s in want)
            numbered = sum(s[1] is not None for s in want)
            assert (got[i].total_sections, got[i].numbered_sections, got[i].subsections, got[i].standalone_sections) == (len(want), numbered, lettered, len(want) - numbered - lettered)
    rng = random.Random(1)
    asked = [(i, rng.randrange(len(t or "") + 2)) for i, t in texts.items()]
    found = C.section_at(sections, spark.createDataFrame(asked, "doc_id bigint, position bigint"), "doc_id", "position").collect()
    want = {(i, p): next((s[0] for s in P.sections(texts[i] or "") if s[2] <= p < s[3]), None) for i, p in asked}
    assert {(r.doc_id, r.position): r.section for r in found} == want


def test_chunks_of_pages(spark):
    filler = "The engine was found intact after the fire. " * 30
    pages = [
        ("r", 1, "cover", "scan", 0.9, None),
        ("r", 2, "ANALYSIS\n" + filler + "See 7/ and 8/ there.", "scan", 0.9, 70.0),
        ("r", 3, filler + "\n7/ First note.\n", "text", 0.0, 90.0),
        ("r", 4, "\n7/ Later note.\n", "text", 0.5, 10.0),
        ("s", 1, "", "text", None, None),
    ]
    df = spark.createDataFrame(pages, "id string, n int, t string, src string, a double, c double")
    rows = C.page_chunks(df, "id", "n", "t", "src", F.col("a"), F.col("c"), word_count).orderBy("chunk_sequence").collect()
    assert {r.id for r in rows} == {"r"} and rows[0].page_start == 2 and rows[-1].page_end == 3
    first = rows[0]
    assert first.section_name == "ANALYSIS" and first.footnotes == "7" and "[7/ First note.]" in first.chunk_text and "Later" not in first.chunk_text
    assert first.text_source == ("mixed" if first.page_end == 3 else "scan")
    assert first.min_alphabetic_ratio == 0.9 and first.avg_confidence == (80.0 if first.page_end == 3 else 70.0)
    assert first.token_count == word_count(first.chunk_text)


def test_source_quality_ignores_nulls_and_zeros(spark):
    rows = spark.createDataFrame([(1, [(0.0, None), (0.4, 0.0), (0.2, 50.0)]), (2, [(0.0, None)]), (3, [])], "id int, p array<struct<ratio: double, confidence: double>>")
    got = {r.id: (r.a, r.b) for r in rows.select("id", *[c.alias(n) for c, n in zip(source_quality(F.col("p")).values(), "ab")]).collect()}
    assert got == {1: (0.2, 50.0), 2: (None, None), 3: (None, None)}


def test_documents_keep_page_order(spark):
    rows = spark.createDataFrame([("r", 2, "bb", "user"), ("r", 1, "a", "bot")], "id string, n int, t string, s string")
    row = documents_of(rows, "id", "n", "t", "s").first()
    assert row.full_text == "a\n\nbb" and row.primary_source == "mixed" and [(p.n, p.start, p.stop) for p in row.pages] == [(1, 0, 1), (2, 1, 5)]


@pytest.mark.parametrize("name", ["txt_page_chunks", "txt_section_at", "txt_section_stats"])
def test_registered_queries_cover_the_documents(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES[name](spark, DATA)
    if name == "txt_page_chunks":
        assert got.where("page_start is null or page_start > page_end or chunk_text is null").count() == 0 < got.count()
    else:
        assert got.select("doc_id").distinct().count() >= docs.where("trim(text) <> ''").count()


def test_footnotes_of_documents(spark):
    rows = QUERIES["txt_footnotes"](spark, DATA).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_references, r.n_definitions) for r in rows} == {i: (len(C.references_in(t)), len(C.footnotes_of(t))) for i, t in texts.items()}


def test_a_chunk_takes_the_pages_that_it_overlaps(spark):
    """Many pages of one document, also with a sentence whose first place is pages before: as by
    comparing each chunk with each page; no page list meets every chunk in a join."""
    rng = random.Random(5)
    again = "The same long sentence stands on many of these pages, and it ends with a stop."
    pages = [("r", n, " ".join(rng.choice([again, f"Sentence {n} of {rng.randrange(99)} words went on for quite some time here."]) for _ in range(rng.randrange(4, 60))), "ab"[n % 7 == 0], 0.5, 1.0) for n in range(60)]
    df = spark.createDataFrame(pages, "id string, n int, t string, src string, a double, c double")
    found = C.page_chunks(df, "id", "n", "t", "src", F.col("a"), F.col("c"))
    rows = found.collect()
    places = documents_of(df.withColumn("t", C.normalized(F.col("t"))), "id", "n", "t", "src").first().pages
    assert len(rows) > 10
    for r in rows:
        want = [p for p in places if p.stop > r.char_start and p.start < r.char_end]
        assert r.page_list == ",".join(str(p.n) for p in want)
        assert r.text_source == ("mixed" if len({p.src for p in want}) > 1 else want[0].src if want else "other")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of documents with their notes
