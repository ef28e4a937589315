"""Rows that share an id but not a text, vector or label; and long texts that nearly link."""

from __future__ import annotations

import random

import numpy as np

from plantlists.llm import embedding_duplicates, near_duplicates


def components(items: list, linked) -> list[int]:  # noqa: ANN001
    """For each item the least id of those that links reach; items are (id, value)."""
    top = list(range(len(items)))

    def root(k: int) -> int:
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i][1], items[j][1]):
                top[root(i)] = root(j)
    least: dict[int, int] = {}
    for k, (own, _) in enumerate(items):
        least[root(k)] = min(own, least.get(root(k), own))
    return [least[root(k)] for k in range(len(items))]


def test_vectors_under_one_id(spark) -> None:
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 16))
    rows = []
    for _ in range(160):
        v = base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.08])
        rows.append((int(rng.integers(60)), [float(x) for x in v], int(rng.integers(3))))
    rows += [(1, rows[0][1], 1), (1, rows[0][1], 2), (2, rows[0][1], 1), (1, rows[0][1], 1)]
    found = embedding_duplicates.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()

    def linked(x: tuple, y: tuple) -> bool:
        a, b = np.array(x[0]), np.array(y[0])
        return x[1] == y[1] and (x[0] == y[0] or a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98)

    items = [(k, (v, label)) for k, v, label in rows]
    least = components(items, linked)
    expected = sorted((k, sum(linked(x, y) for n, (_, y) in enumerate(items) if n != m), least[m], least[m] == k) for m, (k, x) in enumerate(items))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == expected


def test_one_id_under_two_labels(spark) -> None:
    x, y, near_x = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.01, 0.0]
    df = spark.createDataFrame([(1, x, 0), (1, y, 1), (2, near_x, 1), (3, near_x, 0)], "vec_id long, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_duplicates.embedding_classes(df).collect())
    assert found == [(1, 0, 1), (1, 1, 1), (2, 0, 2), (3, 1, 1)]


def test_texts_under_one_id(spark) -> None:
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    a, b, c = text(90), text(90), text(4)
    rows = [(1, a), (1, b), (2, b + " word"), (3, a + " Word"), (4, c), (4, text(60)), (0, c), (5, None), (5, a)]
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())

    def shingles(t: str | None) -> frozenset:
        w = (t or "").lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()

    items = [(k, shingles(t)) for k, t in rows]
    least = components(items, lambda x, y: 100 * len(x & y) >= 85 * len(x | y) > 0)
    assert found == sorted((k, len(s), m, m == k) for (k, s), m in zip(items, least, strict=True))


def test_long_texts_that_nearly_link(spark) -> None:
    """Work on what does not link grows with the length of texts and not with its square."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(1_000_000)}" for _ in range(250_000)]
    other = [w if k % 46 else "changed" for k, w in enumerate(words)]
    found = near_duplicates.near_duplicate_classes(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(other[:-1]))], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2, 3: 2}
