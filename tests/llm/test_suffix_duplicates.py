"""Repeated byte strings against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from plantlists.llm import suffix_duplicates as sd


def expected(docs: list[tuple]) -> Counter:
    first: dict = {}
    texts = [(d, (t or "").encode()) for d, t in docs]
    for d, x in texts:
        if d is not None:
            for s in range(len(x) - 99):
                w = x[s : s + 100]
                first[w] = min(first.get(w, (d, s)), (d, s))
    out: Counter = Counter()
    for d, x in texts:
        gone = np.zeros(len(x) + 1, np.int64)
        if d is not None:
            for s in range(len(x) - 99):
                if first[x[s : s + 100]] < (d, s):
                    gone[s : s + 100] = 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
        spans = tuple(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        out[d, len(x), int(gone.sum()), spans, bytes(b for b, g in zip(x, gone, strict=False) if not g)] += 1
    return out


def some_docs(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé日 \n") for _ in range(rng.randrange(1, 9))) for _ in range(300)]

    def text(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    passages = [text(30) for _ in range(12)]
    head = "x" * 16 + "the same anchor of many contexts " * 2  # one anchor, many different strings
    docs: list[tuple] = [(900, None), (901, ""), (902, "short"), (None, passages[0]), (None, passages[0]), (903, "a" * 700), (904, "ab" * 300 + "a" * 200), (905, passages[1] * 3)]
    for k in range(60):
        parts = [text(rng.randrange(40)), rng.choice(passages)[rng.randrange(40) :], text(rng.randrange(30)), rng.choice(passages), head + text(12)]
        rng.shuffle(parts)
        docs.append((rng.choice([k, 1000 - k, -k]), "".join(parts[: rng.randrange(1, 6)])))
    docs += docs[20:26] + [(2000, docs[30][1]), (2000, docs[31][1]), (2000, docs[32][1] + "!")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "block", "collection", "piece"), [(1, 16_000_000, 1 << 16, 1 << 17), (2, 3000, 40, 512), (3, 1, 2, 300)])
def test_without_repeated_bytes(spark, monkeypatch, seed: int, block: int, collection: int, piece: int) -> None:
    """With small bounds texts are cut in pieces, blocks hold few texts and frequent anchors are taken apart."""
    for name, value in (("BLOCK_BYTES", block), ("COLLECTION", collection), ("APART", collection), ("_PIECE", piece)):
        monkeypatch.setattr(sd, name, value)
    docs = some_docs(seed)
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, segments string, block int").repartition(5)
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, tuple((s.begin, s.stop) for s in r.spans), bytes(r.kept)) for r in sd.without_repeated_bytes(df).collect())
    assert found == expected(docs)
    assert sum(k[2] > 0 for k in found) > 20


def test_long_and_empty(spark) -> None:
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    docs = [(1, long), (2, long[1_000_000:2_000_000] + "new end" * 30), (3, long)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in sd.without_repeated_bytes(df).collect()}
    assert (found[1].n_removed, found[2].n_removed, found[3].n_removed) == (0, 1_000_000 + 210 - 7, 3_000_000)  # the end repeats itself from its eighth byte on
    assert found[2].spans[0].begin == 0 and found[2].spans[0].stop == 1_000_000 and found[3].kept == b""
    assert sd.byte_digest(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_spans) for r in sd.byte_digest(nothing).collect()) == [(1, 0, 0), (2, 0, 0)]


def test_suffix_rounds() -> None:
    """Each round's order and common prefixes are those of sorted suffixes."""
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"\x00ab") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    distance = np.array([rng.randrange(len(s)) for s in strings])
    group = np.sort(np.array([rng.randrange(6) for _ in strings]))
    edges = np.append(0, np.cumsum([len(s) for s in strings]))
    for column, order, prefix in sd.suffix_rounds(np.frombuffer(b"".join(strings), np.uint8), edges, distance, group):
        here = [(k, strings[k][column + distance[k] :]) for k in order.tolist() if 0 <= column + distance[k] < len(strings[k])]
        assert [(group[k], s) for k, s in here] == sorted((group[k], s) for k, s in here)
        place = {k: n for n, k in enumerate(order.tolist())}
        for (i, x), (j, y) in zip(here, here[1:], strict=False):
            common = next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert prefix[place[j]] == (common if group[i] == group[j] else 0)
