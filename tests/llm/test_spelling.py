"""Spelling variants against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from plantlists.llm import spelling
from tests.oracle import rows_of_spark


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def expected(docs: list[tuple]) -> Counter:
    n: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = Counter({w: k for w, k in n.items() if len(w) >= 6 and k >= 5})
    beside = {w: [v for v in n if near(v, w)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in beside.items()}
    form = {w: v if v is not None and n[v] >= 5 * n[w] else None for w, v in form.items()}

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    names = ("word", "form", "root", "n", "n_near", "form_n")
    rows = [(w, form[w], root(w), n[w], len(beside[w]), n[form[w]] if form[w] else None) for w in n]
    order = sorted(range(6), key=lambda k: names[k])
    return Counter(tuple(r[k] for k in order) for r in rows)


def test_spelling_variants(spark) -> None:
    rng = random.Random(3)
    stems = ["".join(rng.choice("abeéÀ×ÿn") for _ in range(rng.randrange(6, 10))) for _ in range(30)]
    docs: list[tuple] = [(1, None), (2, ""), (3, "12 34 --"), (None, "kleiner " * 9), (-4, "Kleiner KLEINEN kleinen kleinens " * 6), (5, "straßenbahn straßenbahnen Straßenbahn " * 7)]
    docs += [(6, "x" * 5000 + " " + "ab" * 3_000_000), (7, "ab" * 3_000_000), *[(8, "ab" * 3_000_000)] * 4]
    for k in range(400):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.15:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "q", w[i] + "q"]) + w[i + 1 :]
            words.append(rng.choice([w, w.upper() if w.isascii() else w, w + "日本", "Ā" + w]))
        docs.append((100 + k, rng.choice([" ", "-", "\n"]).join(words)))
    docs += docs[-20:]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    found = rows_of_spark(spelling.spelling_variants(df))
    assert found == expected(docs)
    assert any(r[0] is not None for r in found) and spelling.spelling_variants(df.limit(0)).count() == 0


@pytest.mark.parametrize(("share", "longest"), [(1, 2), (4, 3), (16, 5), (100_000, 6)])
def test_near_words(spark, monkeypatch, share: int, longest: int) -> None:
    """Whatever the dictionary, no pair is lost."""
    monkeypatch.setattr(spelling, "FREQUENT_SHARE", share)
    monkeypatch.setattr(spelling, "GRAM_MAX", longest)
    rng = random.Random(share)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(6, 11))) for _ in range(500)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa"}
    found = {(r.a, r.b) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert found == {(a, b) for a in words for b in words if a < b and near(a, b)} and len(found) > 100


def test_bounds_hold() -> None:
    """An edit never destroys more grams than affected() says."""
    rng = random.Random(5)
    for share in range(40):
        pool = ["".join(rng.choice("ab") for _ in range(rng.randrange(3, 6))) for _ in range(share)]
        grams = spelling.Grams(pool)
        for _ in range(60):
            word = "^" + "".join(rng.choice("ab") for _ in range(rng.randrange(6, 10))) + "$"
            own = grams.of(word)
            k = rng.randrange(1, len(word) - 1)
            other = rng.choice([word[:k] + rng.choice("abz") + word[k:], word[:k] + word[k + 1 :], word[:k] + "z" + word[k + 1 :]])
            shift = len(other) - len(word)
            there = {(p, other[p:e]) for p, e in grams.of(other)}
            kept = sum((p, word[p:e]) in there or (p + shift, word[p:e]) in there for p, e in own)
            assert kept >= len(own) - grams.affected(word, own)
