"""Chat, embeddings, components, the pipeline and the queries of the subpackage."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from plantlists.llm import chat, components, embedding_duplicates, registry
from tests.llm.test_text_operators import WORD, base, corpus, shingles
from tests.oracle import FOLDER, rows_of_spark, rows_of_sql


def test_components(spark) -> None:
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(200, 200 + k) for k in range(1, 50)] + [(None, 3)]
    top: dict[int, int] = {}

    def root(k: int) -> int:
        while top.setdefault(k, k) != k:
            k = top[k]
        return k

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: root(k) for k in top}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_perspectives(spark) -> None:
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello é"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (3, 0, None, "who"), (3, 700, "x|y", "far")]
    df = spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, view string")
    found = {(r.conv_id, r.view): r for r in chat.dialogues(df).collect()}
    assert set(found) == {(1, "ann"), (1, "bob"), (3, "unknown"), (3, "x|y")}
    ann = found[1, "ann"]
    assert ann.text == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user name=bob|>\nHello é<|end|>\n<|assistant|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert [ann.text[m.begin : m.stop] for m in ann.masks] == ["Hi<|end|>", "<|end|>", "<|end|>"]
    assert [found[1, "bob"].text[m.begin : m.stop] for m in found[1, "bob"].masks] == ["Hello é<|end|>"]
    far = found[3, "unknown"]
    assert far.text == "<|assistant|>\nwho<|end|>\n<|user name=x%7Cy|>\nfar<|end|>\n" and [far.text[m.begin : m.stop] for m in far.masks] == ["who<|end|>"]
    assert chat.perspectives(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, 0, "a|b", "x<|end|>\n<|assistant|>"), (1, 1, "a_b", "y" * 300_000), (1, 2, "a%7Cb", "")], "conv_id long, turn long, role string, text string")
    views = {r.view: r.text for r in chat.dialogues(odd).collect()}
    assert views["a_b"].startswith("<|user name=a%7Cb|>\nx<&#124;end|>\n<&#124;assistant|><|end|>\n<|assistant|>\nyyy") and views["a_b"].endswith("<|user name=a%257Cb|>\n<|end|>\n")


def test_embeddings(spark) -> None:
    rng = np.random.default_rng(4)
    rows: list[tuple] = []
    for k in range(400):
        label = int(k % 3)
        v = rng.normal(size=24) if k % 4 else np.array(rows[k - 4][1]) + rng.normal(size=24) * 0.05 if k else rng.normal(size=24)
        rows.append((k, [float(x) for x in np.float32(v)], label))
    rows += [(1000, rows[5][1], rows[5][2]), (1001, rows[5][1], rows[5][2]), (1002, None, 1), (1003, [0.0] * 24, 1), (1004, [float("nan")] * 24, 1), (1005, rows[5][1], None), (1006, [], 1), (1007, [1.0, None], 1), (1008, rows[5][1][:20], rows[5][2]), (1009, [2 * x for x in rows[5][1]], rows[5][2])]
    usable = {k: (np.array(v, float), label) for k, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links: dict[int, set] = {k: set() for k, _, _ in rows}
    for a, (x, p) in usable.items():
        for b, (y, q) in usable.items():
            if a < b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    found = {r.vec_id: r for r in embedding_duplicates.embedding_classes(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")).collect()}
    true, got = sum(map(len, links.values())), sum(r.n_links for r in found.values())
    assert len(found) == len(rows) and all(r.n_links <= len(links[k]) for k, r in found.items()) and got >= 0.99 * true > 0

    def reach(k: int) -> int:
        seen, new = {k}, [k]
        while new:
            new = [y for x in new for y in links[x] if y not in seen and not seen.add(y)]
        return min(seen)

    if got == true:
        assert all(r.component_id == reach(k) and r.kept == (k == reach(k)) for k, r in found.items())
    assert embedding_duplicates.embedding_classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_of_null_and_repeated_ids(spark) -> None:
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 1), (5, v, 1), (5, v, 1), (7, [1.0, 2.0, 3.01], 1), (8, [-1.0, 0.0, 0.5], 1)]
    found = embedding_duplicates.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == Counter({(5, 2, 5, True): 2, (7, 2, 5, False): 1, (8, 0, 8, True): 1, (None, 0, None, None): 1})


def test_hadamard_keeps_lengths() -> None:
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = embedding_duplicates.hadamard(x)
    assert np.allclose((x * x).sum(axis=1), (y * y).sum(axis=1)) and np.allclose(embedding_duplicates.hadamard(y), x)


def test_recall_against_brute_force(spark) -> None:
    """All rows of the given table as queries."""
    names, expected = rows_of_sql(registry.oracle_sql()["op10_embeddings"])
    found = rows_of_spark(registry.op10_embeddings(spark, FOLDER))
    n = names.index("n_links")
    assert sum(r[n] * k for r, k in found.items()) >= 0.9 * sum(r[n] * k for r, k in expected.items())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name: str) -> None:
    df = registry.queries()[name](spark, FOLDER)
    names, expected = rows_of_sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == names and rows_of_spark(df) == expected


def test_pipeline(spark) -> None:
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        rows = out.cache()
        assert 0 < rows.count() <= docs.count()
        docs = rows
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    final = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in final.select("doc_id").collect()} == ids
    assert docs.where("length(text) <> n_chars").count() == 0
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    share = lambda df: df.join(labels, "doc_id").agg({"quality": "avg"}).first()[0]
    assert share(docs) > share(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_pipeline_stages_on_odd_tables(spark) -> None:
    """Nulls in any column, empty and very long texts, repeated rows, columns that operators use inside, empty tables: no row is made up, none lost but by rule."""
    rng = random.Random(21)
    clean = {k: " ".join(f"w{rng.randrange(50_000)}" for _ in range(120)) for k in range(40)}
    rows = [(k, t, None if k % 3 else "en", "s", "c", k) for k, t in clean.items()] + [(3, clean[3], None, "s", "c", 3)] * 2
    rows += [(None, " ".join(f"n{rng.randrange(50_000)}" for _ in range(120)), None, None, None, None), (100, None, "en", "s", "c", 1), (101, "", "en", "s", "c", 1), (102, " ".join(f"v{rng.randrange(10**6)}" for _ in range(40_000)), "en", "s", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, check string, counts string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        if name != "near-duplicates":  # test_pipeline_tells_rows_of_one_id_apart has that
            assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        ids = Counter(r.doc_id for r in docs.collect())
        if name == "quality rules":
            assert 100 not in ids and 101 not in ids and ids[3] == 3
        else:
            assert ids[3] == 1
        assert set(range(40)) | {102, None} == set(ids)
    assert {r.doc_id: r.text for r in docs.where("doc_id < 40").collect()} == clean
    last = corpus_pipeline.packing(spark, docs, FOLDER).collect()
    assert Counter(r.doc_id for r in last) == ids and corpus_pipeline.packing(spark, docs.limit(0), FOLDER).count() == 0


def test_pipeline_tells_rows_of_one_id_apart(spark) -> None:
    """A doc_id with a copy and a clean text keeps the clean one; of rows repeated whole one stays."""
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(9_000)}" for _ in range(200)) for _ in range(4))
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (6, c, 4), (6, c, 4), (6, c, 7), (7, b + " end", 5), (9, d, 6), (None, a, 8), (None, a, 8), (8, None, 9), (8, "", 9), (10, b, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    found = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert found.columns == docs.columns
    assert Counter(map(tuple, found.collect())) == Counter([(1, a, 1), (5, b, 3), (6, c, 4), (9, d, 6), (None, a, 8), (None, a, 8), (8, None, 9), (8, "", 9)])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), FOLDER).count() == 0


def test_pipeline_rows_of_stages_2_to_4(spark) -> None:
    """Near-duplicates, repeated passages and secrets in plain Python, row by row; quality rules are not in it."""
    texts = {k: t and t + (f" token=abcdef{k}" if k % 5 == 0 else "") for k, t in corpus(9).items()}
    sets, top = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and top[a] != top[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = {k: low if t == high else t for k, t in top.items()}
    expected, seen = set(), set()
    for k in (k for k in sorted(texts) if top[k] == k):
        text, words = texts[k] or "", WORD.findall(texts[k] or "")
        gone: set[int] = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            gone.update(range(i, i + 20) if window in seen else ())
            seen.add(window)
        if words and len(gone) == len(words):
            continue
        text = " ".join(w for i, w in enumerate(words) if i not in gone) if gone else text
        for kind, begin, stop in (x.split(":") for x in reversed(base(text))):
            text = f"{text[: int(begin)]}[{kind}]{text[int(stop) :]}"
        expected.add((k, text, len(text)))
    docs = spark.createDataFrame([(k, t, -1) for k, t in texts.items()], "doc_id long, text string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, FOLDER)
    found = list(map(tuple, docs.collect()))
    assert 0 < len(found) < len(texts) and len(found) == len(set(found)) and set(found) == expected
