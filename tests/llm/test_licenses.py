"""License scans of texts made of license lines: places, labels and score against a plain version
that tries every rule, without keywords, and compares every pair of detections."""

import random
import re
import time

from tessera.llm import licenses as S

LINES = [
    "Licensed under the GNU General Public License, version 3 or later", "Apache License, Version 2.0", "the MIT License", "CC BY-SA 4.0",
    "Creative Commons Attribution NonCommercial 4.0", "Mozilla Public License 2.0", "BSD license", "GNU Lesser General Public License v2.1 only",
    "All rights reserved", "without warranty of any kind", "copyright 2019", "proprietary and confidential", "permission is hereby granted",
    "cc by", "for research purposes only", "released under the Apache License", "SPDX-License-Identifier: MIT", "license", "gnu", "version 2",
]


def mixed(rng, n):
    return "; ".join(rng.choice(LINES) if rng.random() < 0.6 else "filler words of no kind" for _ in range(n))


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    joined = " ".join(words)
    found = [(m.start(), m.end(), r) for r in S.rules() for m in r.regex.finditer(joined)]
    order = lambda d: (d[0], -d[1], -d[2].priority, S.rules().index(d[2]))
    found.sort(key=order)
    kept = [d for i, d in enumerate(found) if not any(e[1] >= d[1] and e[2].priority >= d[2].priority for e in found[:i])]
    base = {r.label for _, _, r in found if r in S.rules()[: len(S.BASE)]}
    rows = [(joined[:a].count(" "), joined[a:b].count(" ") + 1, r.label) for a, b, r in kept]
    labels = base | {r.label for _, _, r in kept}
    return ",".join(sorted(labels)), max((r.weight for _, _, r in kept), default=0.0), rows


def test_labels_score_and_detections_equal_a_plain_version():
    rng = random.Random(5)
    for n in [0, 1, 2, *[rng.randrange(3, 14) for _ in range(60)]]:
        text = mixed(rng, n)
        got, (labels, score, rows) = S.scan(text), plain_scan(text)
        assert (got["labels"], got["score"]) == (labels, score), text
        assert [d[:3] for d in got["detections"]] == rows, text


def test_work_is_linear_in_the_text():
    """Eight times the text takes some eight times as long, not sixty-four."""
    rng, took = random.Random(6), []
    for n in (5_000, 40_000):
        text, began = mixed(rng, n), time.process_time()
        S.scan(text)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02), took
