import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate as B
from tessera.llm import language_id as L
from tessera.llm import licenses as S
from tessera.llm import quality as Q
from tessera.llm import queries
from tests.conftest import DATA
from tests.llm.helpers import awkward, nothing, words_text

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    found = queries.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert found.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(found.doc_id, found.held_out, strict=True))


@pytest.fixture(scope="module")
def model(spark):
    rows = [("en", words_text(random.Random(i), 60).replace("w", "the ")) for i in range(20)]
    rows += [("fr", "été forêt où garçon naïf leçon déjà élève " * 8)] * 20 + [("ru", "это простой русский текст для проверки модели " * 8)] * 20
    rows += [(None, "skipped"), ("en", None)]
    return L.train(spark.createDataFrame(rows, "lang string, text string"))


def test_spans_of_mixed_text(spark, model):
    text = "the the w the " * 10 + "leçon déjà élève forêt " * 10 + "простой русский текст " * 10
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    got = [(r.lang, r.n_words) for r in L.language_spans(docs, model).orderBy("first_word").collect()]
    assert [g[0] for g in got] == ["en", "fr", "ru"] and got[2][1] == 30


def plain_viterbi(scores, switch):
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        top = int(best.argmax())
        came = [top if best[top] - switch > best[k] else k for k in range(len(best))]
        back.append(came)
        best = np.array([max(best[k], best[top] - switch) for k in range(len(best))]) + row
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_viterbi_by_stretches(monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 64)
    test_viterbi_side_by_side_equals_one_by_one()


def plain_verdict(model, text):
    """The verdict from the definition, word by word."""
    rows, letters = [], []
    for word in text.lower().split():
        plain = "".join(c for c in word if c.isalpha())
        letters.append(len(plain))
        if not plain:
            rows.append(np.zeros(len(model.languages)))
            continue
        seen = model.scripts[L.scripts_of([plain])[0]]
        mean = model.logp[L.trigrams([plain])[0]].astype(np.float64).mean(0) * min(len(plain) + 1, 8) / 2
        rows.append(np.where(seen, mean - mean[seen].max() - 1e-6, -60.0) if seen.any() else np.zeros(len(model.languages)))
    if not sum(letters):
        return "und", 0.0
    if not np.any(rows):
        return model.languages[model.common], 0.0
    path = plain_viterbi(np.array(rows), L.SWITCH)
    held = [sum(n for n, p in zip(letters, path, strict=True) if p == k) for k in range(len(model.languages))]
    best = held.index(max(held))
    sure = sum(n * math.exp(r[best]) / np.exp(r).sum() for n, r, p in zip(letters, rows, path, strict=True) if p == best) / held[best]
    return model.languages[best], held[best] / sum(letters) * sure


def test_verdicts_equal_the_definition(spark, model):
    rng = random.Random(4)
    words = ["the", "w", "leçon", "forêt", "простой", "текст", "12", "!!", "ελλ", "x1y", "garçon-naïf"]
    texts = ["", "12 !!", "ελληνικά", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(60))]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    for i, text in enumerate(texts):
        lang, score = plain_verdict(model, text)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4), text


def test_viterbi_side_by_side_equals_one_by_one():
    rng = np.random.default_rng(3)
    table = np.vstack([np.zeros(3), -rng.random((50, 3)) * 12]).astype(np.float32)
    numbers = [rng.integers(1, 51, n) for n in (1, 5, 40, 90, 200)]
    for x, got in zip(numbers, L.viterbi(numbers, table), strict=True):
        assert got.tolist() == plain_viterbi(table[x].astype(np.float64), L.SWITCH)


def test_languages_of_awkward_rows(spark, model):
    got = {(r.doc_id, r.lang_pred, r.score) for r in L.identify(awkward(spark), model).collect()}
    by_id = {i: (lang, score) for i, lang, score in got}
    assert by_id[0] == by_id[1] == by_id[2] == by_id[8] == ("und", 0.0)
    assert by_id[4][0] in model.languages
    assert L.identify(nothing(spark), model).count() == 0
    empty = L.train(nothing(spark))
    assert {r.lang_pred for r in L.identify(awkward(spark), empty).collect()} == {"und"}
    kept = L.keep_identified(awkward(spark), model, 0.0)
    assert kept.columns == awkward(spark).columns and kept.where("doc_id in (0, 1, 2, 8)").count() == 0


def test_one_language_is_told_from_unknown_scripts(spark):
    rows = [("en", "only one language is known here")]
    only = L.train(spark.createDataFrame(rows, "lang string, text string"))
    docs = spark.createDataFrame([(1, "language here"), (2, "это простой"), (3, "12")], "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, only).collect()}
    assert got[1][0] == "en" and got[1][1] > 0.99 and got[2] == ("en", 0.0) and got[3] == ("und", 0.0)


def test_quality_of_held_out_documents(spark):
    found = queries.op6_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert ((found.score >= 0.3).astype(int) == found.predicted).all()


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (6, None), (None, 1)], "doc_id bigint, quality int")
    from pyspark.sql import functions as F

    weights = Q.train(docs, Q.sample(labels, F.col("quality")))
    got = Q.quality_scores(docs, weights).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert Q.quality_scores(nothing(spark), weights).count() == 0
    none = Q.train(docs, Q.sample(labels.where("false"), F.col("quality")))
    assert {r.score for r in Q.quality_scores(docs, none).collect()} == {0.5}


def plain_ftrl(rows, passes):
    """Scores by follow the regularised leader, one number at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= Q.L1:
            return 0.0
        return -(z[i] - math.copysign(Q.L1, z[i])) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    for order in passes:
        for r in order:
            x, label = rows[r]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / Q.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return lambda x: 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))


def test_quality_scores_equal_plain_updates(spark, monkeypatch):
    """One shard of all rows, in the order of the passes, against dictionaries of numbers."""
    monkeypatch.setattr(Q, "SHARDS", 1)
    rng = random.Random(5)
    texts = [words_text(rng, rng.randrange(0, 40), 60) + (" good" if i % 2 else " BAD!!") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    from pyspark.sql import functions as F

    got = {r.doc_id: r.score for r in Q.quality_scores(docs, Q.train(docs, Q.sample(labels, F.col("quality")))).collect()}
    rows = []
    for i, t in enumerate(texts):
        buckets = next(iter(Q.Features().of([t]))).tolist()
        x = {b: buckets.count(b) / max(1, len(buckets)) * Q.SCALE for b in set(buckets)}
        rows.append((x | {Q.BUCKETS: 1.0}, i % 2))
    order = np.random.default_rng(7)
    score = plain_ftrl(rows, [order.permutation(60) for _ in range(Q.PASSES)])
    assert all(abs(got[i] - score(x)) < 1e-6 for i, (x, _) in enumerate(rows))


def test_shapes_of_words():
    assert [Q.shape(w) for w in ("Word", "WORD!!", "word", "a1b22", "%%%", "...")] == ["Aa", "AA!!", "a", "a9a9", "%%", ".."]


def test_all_characters_of_long_words_count():
    rng = random.Random(3)
    a = "".join(rng.choice("abcXYZ012+/") for _ in range(5000))
    b = a[:4990] + "%%%%%%%%%%"
    one, two = (set(f.tolist()) for f in Q.Features().of([a, b]))
    assert one != two and len(one) > 100
    left, right = (Q.Features().of(["x" * 64 + tail]) for tail in ("", "99"))
    assert len(next(left)) < len(next(right))
    assert Q.words_of("ab " + "日" * 130) == ["ab", "日" * 64, "日" * 64, "日" * 2]


def plain_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(k, label) for k in range(len(w)) for p, label in S.BASE if w[k : k + len(p.split())] == p.split()]
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at}))


def test_license_places_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: plain_places(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in S.license_scan(docs).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("CC-BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
        ("mit   License; Apache license", "apache,mit"),
        ("permit license, cc bye", ""),
        ("Apache License, Version 2.0. This is released under the MIT License", "apache,apache-2.0,mit"),
        (None, ""),
    ],
)
def test_license_labels(text, labels):
    assert S.scan(text or "")["labels"] == labels


def test_contained_detections_are_suppressed():
    found = S.scan("It is licensed under the Mozilla Public License 2.0 or the BSD license")
    assert [d[2] for d in found["detections"]] == ["mpl-2.0", "bsd"]
    assert len(S.rules()) > 300


def test_licenses_of_awkward_rows(spark):
    got = S.license_scan(awkward(spark)).collect()
    assert len(got) == awkward(spark).count() and all(r.score == 0 and r.n_base == 0 for r in got)
    assert S.license_scan(nothing(spark)).count() == S.license_detections(nothing(spark)).count() == 0


def plain_words(text):
    return [x for x in (re.sub(r"[\W_]+", "", w) for w in (text or "").lower().split()) if x]


def test_leaks_of_whole_items(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    joined = lambda t: f" {' '.join(plain_words(t))} "
    bench = [(r.item_id, joined(r.text)) for r in items.collect()]
    texts = [(r.doc_id, joined(r.text)) for r in docs.collect()]
    want = {(d, i) for d, text in texts for i, t in bench if t in text}
    assert {(r.doc_id, r.item_id) for r in B.contaminated(docs, items).collect()} == want


def test_paraphrased_leak(spark):
    rng = random.Random(8)
    corpus = [words_text(rng, 150, 5000) for _ in range(300)]
    item = words_text(rng, 40, 5000).split()
    changed = [("other" if i % 8 == 3 else w) for i, w in enumerate(item)]
    corpus[17] += " " + " ".join(changed)
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, words_text(rng, 40, 5000)), (3, None), (4, "")], "item_id bigint, text string")
    got = [(r.doc_id, r.item_id, r.share) for r in B.contaminated(docs, bench).collect()]
    assert [g[:2] for g in got] == [(17, 1)] and 0.8 < got[0][2] < 1


@pytest.mark.parametrize(("share", "spared", "least"), [(0.1, 0, 1.0), (0.2, 0, 0.97), (0.3, 10, 0.9)])
def test_recall_of_edited_items(spark, share, spared, least):
    """Items of 40 words with a share of them changed, each in a text of its own. With 30 %,
    the answer (the last quarter) is spared, as it must be found where so much has changed."""
    rng = random.Random(int(share * 10))
    bench, texts = [], []
    for i in range(100):
        words = words_text(rng, 40, 5000).split()
        bench.append((i, " ".join(words)))
        for at in rng.sample(range(40 - spared), int(share * 40)):
            words[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join([words_text(rng, 100, 5000), *words, words_text(rng, 60, 5000)]))
    texts += [words_text(rng, 200, 5000) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in B.contaminated(docs, spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert all(d == i for d, i in got) and len(got) >= least * 100


def test_words_of_texts():
    texts = ["The don't  CAT_a %% \n été", "", " % ", "日本 x"]
    flat, n = B.word_hashes(pa.array(texts))
    plain = [plain_words(t) for t in texts]
    assert n.tolist() == [len(w) for w in plain]
    word = {}
    for w, h in zip([w for p in plain for w in p], flat.tolist(), strict=True):
        assert word.setdefault(w, h) == h
    assert len(set(word.values())) == len(word) and 0 not in word.values()


def test_leaks_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, words_text(random.Random(1), 30))], "item_id bigint, text string")
    assert B.contaminated(awkward(spark), bench).count() == 0
    assert B.contaminated(nothing(spark), bench).count() == 0
    assert B.contaminated(awkward(spark), bench.where("false")).count() == 0


def test_short_and_very_long_items(spark):
    rng = random.Random(21)
    corpus = [words_text(rng, 300, 3000).split() for _ in range(200)]
    bench, want = [], set()
    for n in range(3, 16):
        for common in (False, True):  # words of their own, or words that many documents have
            item = words_text(rng, n, 10**6).split() if not common else [rng.choice(corpus[rng.randrange(200)]) for _ in range(n)]
            d = rng.randrange(200)
            at = rng.randrange(300)
            corpus[d][at:at] = item
            bench.append((len(bench), " ".join(item)))
    bench.append((len(bench), words_text(rng, 21_000, 10**6)))
    corpus.append(words_text(rng, 50).split() + bench[-1][1].split())
    texts = [" ".join(w) for w in corpus]
    want = {(d, i) for d, t in enumerate(texts) for i, item in bench if f" {item} " in f" {t} "}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in B.contaminated(docs, spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert got == want


def test_subsequences_equal_dynamic_programming():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert B.subsequence(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) == table[-1][-1]


def test_data_is_there():
    assert DATA.startswith("/root/testdata")


@pytest.mark.parametrize("n", [1, 5, 49])
def test_verbatim_leaks_in_few_documents(spark, n):
    """In few passages all words are common; items of 16 to 40 words are found nevertheless."""
    rng = random.Random(n)
    words = [f"w{k}" for k in range(6000)]
    items = [(i, " ".join(rng.sample(words, 16 + i % 25))) for i in range(n)]
    docs = [(i, " ".join([*rng.choices(words, k=30), items[i][1], *rng.choices(words, k=30)])) for i in range(n)]
    docs += [(1000 + i, " ".join(rng.choices(words, k=90))) for i in range(n // 2)]
    got = {(r.doc_id, r.item_id) for r in B.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i) for i in range(n)}
