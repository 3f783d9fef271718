"""Small tables with every awkward case, and plain reference versions."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score double, part int"


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, and
    extra columns with names that operators use."""
    random.seed(5)
    words = ["the", "of", "engine", "Flug", "été", "niño", "x" * 40, "42", "don't", "%%%", "日本語", "a|b"]
    long = " ".join(random.choice(words) for _ in range(30_000))
    base = " ".join(random.choice(words) for _ in range(120))
    texts = [None, "", "   \n\t ", "a", long, base, base, base + " end", "!!! ???", "tab\tand  two spaces ", "<|endoftext|> in text", "\x00\x01 control"]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), "z", 0.5, 3) for i, t in enumerate(texts)]
    rows += [(5, base, "fr", "s", 1, "z", 0.5, 3), (None, base, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{chr(97 + rng.randrange(26))}" for _ in range(n))
