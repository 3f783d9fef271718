import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.helpers import words_text
from tests.llm.test_tokens import check_packing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, starts string"


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(3)
    sentence = lambda n: words_text(rng, n, 3000).replace("w", "en")
    texts = [sentence(120) for _ in range(80)]
    item, passage = sentence(35), sentence(60)
    texts[40] = texts[10]  # exact copy
    texts[41] = texts[11] + " more"  # near copy
    texts[50] += " " + item  # leak
    texts[60], texts[61] = texts[60] + " " + passage, texts[61] + " " + passage  # shared passage
    texts[70] = "12345 %%% 678"  # no language
    texts[71] = None
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema == docs.schema
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    every = set(range(80))
    assert set(seen["language_id"]) == every - {70, 71}
    assert set(seen["simhash_near_dedup"]) == every - {70, 71, 40, 41}
    cut = seen["suffix_dedup"]
    assert passage in cut[60] and passage not in cut[61] and cut[20] == texts[20]
    assert set(seen["decontamination"]) == set(cut) - {50}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for i, t in seen["decontamination"].items()}
    check_packing(corpus_pipeline.packing(spark, docs, str(tmp_path)).collect(), ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == corpus_pipeline.packing(spark, docs, str(tmp_path)).count()


def stages(spark, docs, items, path):
    """The table after each stage but the last, and the pieces."""
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(path)).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out[name] = docs
    return out, corpus_pipeline.packing(spark, docs, str(path))


def test_awkward_rows_pass_through(spark, tmp_path):
    """Repeated ids, missing ids and texts, a very long text, clashing names."""
    rng = random.Random(4)
    prose = lambda n: words_text(rng, n, 3000).replace("w", "en")
    one, other, long, leak = prose(90), prose(90), prose(40_000), prose(40)
    rows = [(1, one), (1, other), (2, one), (3, long), (None, prose(50)), (None, None), (4, ""), (5, "12 34"), (6, prose(60) + " " + leak), (None, prose(20) + " " + leak)]
    rows += [(i, prose(80)) for i in range(10, 40)]
    docs = spark.createDataFrame([(i, t, "en" if i else None, None, len(t or ""), 9) for i, t in rows], SCHEMA.replace("starts string", "component int"))
    found, pieces = stages(spark, docs, [(1, leak), (None, None)], tmp_path)
    texts = {n: sorted((str(r.doc_id), r.text) for r in d.collect()) for n, d in found.items()}
    assert all(d.columns == docs.columns for d in found.values())
    assert texts["language_id"] == sorted((str(i), t) for i, t in rows if t and t != "12 34")
    assert texts["simhash_near_dedup"] == sorted((str(i), t) for i, t in rows if t and t != "12 34" and i != 2)
    assert len(texts["suffix_dedup"]) == len(texts["simhash_near_dedup"]) and ("3", long) in texts["suffix_dedup"]
    assert texts["decontamination"] == [x for x in texts["suffix_dedup"] if leak not in x[1]]
    assert pieces.selectExpr("sum(length)").first()[0] > 40_000 and pieces.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    found, pieces = stages(spark, docs, [(1, "some item text")], tmp_path)
    assert all(d.count() == 0 for d in found.values()) and pieces.count() == 0


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage against a plain version on its own input, over the provided documents."""
    from tessera.llm import language_id as L
    from tests.conftest import DATA
    from tests.llm.test_duplicates import plain_removal, shingles
    from tests.llm.test_scores import plain_words

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found, pieces = stages(spark, docs, items, tmp_path)
    before = {n: {r.doc_id: r.text for r in d.collect()} for n, d in (("all", docs), *found.items())}

    model = L.train(docs)
    judged = {i: L.verdict(model, *L.Labeller(model).label([t or ""])[0]) for i, t in before["all"].items()}
    assert set(before["language_id"]) == {i for i, (lang, score) in judged.items() if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}

    left = sorted(before["language_id"].items())
    sets, group = [shingles(t) for _, t in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert set(before["simhash_near_dedup"]) == {left[g][0] for g in set(group)}

    raw = [(i, t.encode()) for i, t in before["simhash_near_dedup"].items()]
    removed = plain_removal(raw)
    for i, text in raw:
        cut = before["suffix_dedup"][i]
        if removed[i][1] == 0:
            assert cut.encode() == text
        assert len(text) - removed[i][1] - 8 * removed[i][2] <= len(cut.encode()) <= len(text) - removed[i][1]

    joined = lambda t: f" {' '.join(plain_words(t))} "
    bench = [joined(t) for _, t in items]
    holding = {i for i, t in before["suffix_dedup"].items() if any(b in joined(t) for b in bench)}
    assert not holding & set(before["decontamination"]) and len(before["suffix_dedup"]) - len(before["decontamination"]) <= len(holding) + 2

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(pieces.collect(), {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for i, t in before["decontamination"].items()})


def test_columns_named_like_internal_ones(spark):
    """Stages keep columns that are called like those they work with."""
    odd = ["#id", "#hash", "#own", "#key", "id", "hash", "rest", "words", "node", "keys", "part"]
    rows = [(i, " ".join(f"w{(i // 2) * 7 + k}" for k in range(60)) if i % 2 else f"one text {i}", "en", "s", 1, *range(len(odd))) for i in range(8)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in odd)
    docs = spark.createDataFrame(rows + rows[:2], schema)
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.suffix_dedup, corpus_pipeline.decontamination):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.select("`#key`").distinct().collect() == [(3,)]
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
