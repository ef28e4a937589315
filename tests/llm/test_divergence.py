"""Divergence of sources against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from plantlists.llm import divergence
from tests.oracle import rows_of_spark

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs: list[tuple]) -> Counter:
    count: dict = defaultdict(Counter)
    held: dict = defaultdict(Counter)
    groups = set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, k in held[lang].items() if k >= 3]
        sources = {s for g, s in groups if g == lang}
        total = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})

        def ps(c: Counter, kept: list = kept) -> dict:
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // n for t in kept}

        p, whole = ps(count[lang, source]), ps(total)
        found = {"pair": [], "term": [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[lang, source][t] and p[t] > whole[t]]}
        for s in sources - {source}:
            q = ps(count[lang, s])
            found["pair"].append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), s))
        for part, rows in found.items():
            rows = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
            out += [(item, lang, part, k, source, value) for k, (value, item) in enumerate(rows, 1) if part == "pair" or k <= 200]
    return Counter(out)


@pytest.mark.parametrize("size", [1, 16_000_000])
def test_source_divergence(spark, monkeypatch, size: int) -> None:
    monkeypatch.setattr(divergence, "BLOCK_BYTES", size)
    rng = random.Random(size)
    words = ["".join(rng.choice("abcXYé日") for _ in range(rng.randrange(1, 4))) for _ in range(700)]
    docs: list[tuple] = [(None, None, "null null"), (None, "x", "NULL, a null"), ("", "y", None), ("zz", "alone", "a b"), ("yy", "p", "never kept"), ("yy", "q", ""), ("xx", "only", "b b"), ("xx", "only", "b"), ("xx", "only", "(b)")]
    for k in range(300):
        text = rng.choice([" ", "\t\n", " "]).join(rng.choice(words) + rng.choice(["", "", ",", "-x", "\x00q", "."]) for _ in range(rng.randrange(60)))
        docs.append((rng.choice(["de", "en"]), f"s{k % 7}" if k % 3 else "hot", rng.choice(["", "  "]) + text + rng.choice(["", " \n"])))
    docs += docs[-30:] + [("en", "long", "tick " * 400_000 + "x" * 1_000_000)] * 3
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "lang string, source string, text string, term string, n int").repartition(3)
    found = rows_of_spark(divergence.source_divergence(df))
    assert found == expected(docs)
    assert divergence.source_divergence(df.limit(0)).count() == 0
