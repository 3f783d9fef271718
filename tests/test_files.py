"""Page trees to documents, sections, chunks and a summary, by the command line."""

import json

import public_tokenizers
import pytest

from tessera.functions.tokens import Vocabulary
from tessera.plans import cli

SENTENCE = "The crew of flight {} reported that the left engine lost all power soon after the aircraft had left the runway. "


def tree(root, pages):
    for i, page in enumerate(pages):
        folder = root / str(i % 3)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.json").write_text(page if isinstance(page, str) else json.dumps(page))


def page(report, number, text, **more):
    return {"report_id": report, "page_number": number, "extraction_method": "embedded", "text": text, "quality_metrics": {"alphabetic_ratio": 0.8}, **more}


@pytest.fixture(scope="module")
def pages():
    body = lambda a, n: "".join(SENTENCE.format(i) for i in range(a, a + n))
    return [
        page("A", 1, "1. FACTUAL INFORMATION\n" + body(0, 30)), page("A", 2, body(30, 30)), page("A", 3, "TABLE OF CONTENTS\n" + "Scope ........ 3\n" * 30),
        page("B", 1, body(90, 12), ocr_confidence={"mean_confidence": 71.5}), page("C", 1, None), "{broken", {"text": "no report"},
    ]


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_pages_to_chunks(spark, tmp_path, pages, kind):
    tree(tmp_path / "in", pages)
    vocabulary, said = public_tokenizers.path("byte_bpe_50k.json"), []
    args = ["chunk-files", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--vocabulary", vocabulary, "--format", kind]
    assert cli.main(args, spark, said.append) == 0
    read = lambda name: spark.read.format(kind).load(str(tmp_path / "out" / name)).collect()
    docs = {r.report_id: r for r in read("documents")}
    assert set(docs) == {"A", "B"} and docs["A"].n_pages == 2 and "Scope" not in docs["A"].full_text
    chunks = read("chunks")
    for r in chunks:
        assert r.token_count == Vocabulary(vocabulary)(r.chunk_text)
        assert r.chunk_text.endswith(docs[r.report_id].full_text[r.char_start : r.char_end][-40:])
    assert all(400 <= r.token_count <= 950 for r in chunks if r.report_id == "A" and r.chunk_sequence == 0)
    assert {(r.page_start, r.page_end) for r in chunks if r.report_id == "B"} == {(1, 1)}
    [s] = read("summary")
    assert (s.pages, s.unreadable_pages, s.documents, s.chunked_documents) == (7, 2, 2, 2)
    assert (s.chunks, s.tokens, s.most_tokens) == (len(chunks), sum(r.token_count for r in chunks), max(r.token_count for r in chunks))
    assert s.sections == len(read("sections")) and f"chunks: {len(chunks)}" in said[0]


def test_bad_arguments(spark, tmp_path):
    with pytest.raises(SystemExit):
        cli.main(["chunk-files", str(tmp_path)], spark)


def test_trees_without_good_pages(spark, tmp_path):
    tree(tmp_path / "in", ["{broken"])
    assert cli.main(["chunk-files", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark, print) == 0
    [s] = spark.read.parquet(str(tmp_path / "out" / "summary")).collect()
    assert (s.pages, s.unreadable_pages, s.documents, s.chunks, s.tokens) == (1, 1, 0, 0, 0)
