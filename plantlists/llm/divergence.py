"""How far the sources of a language differ in their words, by chunk factorization.

Most of a corpus repeats the same white-space chunks, so texts are not tokenized one by one. Blocks of documents are factored into
their distinct chunks and, for each document, how often it has each; every chunk that occurs anywhere is split into terms once, the terms are joined back to the
blocks that hold the chunk, and a block turns its documents' chunk counts into term counts: occurrences, and documents that hold a
term in whatever chunks. Only these counts meet, by buckets of terms, each block's part of a bucket as one compressed row. A chunk that is its own single term needs no answer.

A block holds BLOCK_BYTES of text (or one longer text), and it sends a chunk, or a term's counts, once, so the commonest word of a corpus
makes as many rows as there are blocks and no key is hot; the buckets grow in number with the input.

Two sources are compared by p = 1 + floor(SCALE * (count + 1) / (N + V)) of each kept term, and by the sum of
f(p, q) = floor((p - q)^2 / q). A source that lacks a term has the p of count zero, its base; so that sum is made of sums over the terms that
a source holds against the other's base, and of a correction for the terms both hold: no term is spread over the sources that lack it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import of_blocks, small_batches, staged, staged_blocks
from .words import slices

#: A term is kept in a language if that many of its documents have it; terms of a source are reported to this rank.
MIN_DOCUMENTS, TOP = 3, 200
SCALE = 1_000_000_000
BLOCK_BYTES = 8_000_000
#: Buckets of terms for each part of the input; the terms of a bucket are counted together.
BUCKETS = 4
#: Entries of a block, and pairs of entries of the correction, that are looked at together.
_ENTRIES, _PAIRS = 1 << 18, 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BLOCK = "block long, chunks array<string>, entries binary, langs array<string>, sources array<string>"


def _block(block: int, parts: list, langs: list, sources: list) -> pa.RecordBatch:
    """parts: for each slice of texts its chunks, and (words of a row that are different, their numbers, how often) one after another."""
    chunks = pa.chunked_array([p[0] for p in parts], pa.large_string()).combine_chunks()
    chunks = (chunks.combine_chunks() if isinstance(chunks, pa.ChunkedArray) else chunks).dictionary_encode()
    number = chunks.indices.to_numpy()
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    ids = np.concatenate([number[p[2] + b].astype("<i4") for p, b in zip(parts, base.tolist(), strict=False)])
    sizes, counts = (np.concatenate([p[k] for p in parts]).astype("<i4") for k in (1, 3))
    head = np.array([len(sizes), len(ids)], "<i8").tobytes()
    entries = head + pa.Codec("zstd", 3).compress(sizes.tobytes() + ids.tobytes() + counts.tobytes(), asbytes=True)
    texts = pa.ListArray.from_arrays(pa.array([0, len(chunks.dictionary)], pa.int32()), chunks.dictionary.cast(pa.string()))
    columns = [pa.array([block], pa.int64()), texts, pa.array([entries], pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.list_(pa.string())) for x in (langs, sources))], ["block", "chunks", "entries", "langs", "sources"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents as distinct chunks and each document's counts of them."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    parts, langs, sources, size = [], [], [], 0
    for batch in batches:
        langs += batch.column(0).to_pylist()
        sources += batch.column(1).to_pylist()
        for part in slices(batch.column(2)):
            rows = len(part.row_bytes) - 1
            edge = np.append(part.starts, len(part.data)).astype(np.int64)  # a chunk and the white space after it
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part.starts), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(part.data))])
            coded = texts.dictionary_encode()
            chunks = pc.ascii_rtrim(coded.dictionary.cast(pa.large_string()), characters=" \t\n\v\f\r").dictionary_encode()
            number = chunks.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64) if len(edge) > 1 else np.zeros(0, np.int64)
            row = np.repeat(np.arange(rows), np.diff(part.row_words))
            many = max(1, len(chunks.dictionary))
            pair, counts = np.unique(row * many + number, return_counts=True)
            parts.append((chunks.dictionary, np.bincount(pair // many, minlength=rows).astype(np.int32), (pair % many).astype(np.int32), counts.astype(np.int32)))
            size += len(part.data)
        if size >= BLOCK_BYTES:
            yield _block(block, parts, langs, sources)
            block += 1
            parts, langs, sources, size = [], [], [], 0
    if langs and parts:
        yield _block(block, parts, langs, sources)


def _counted(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block the occurrences and documents of each (language, term, source), by the bucket of the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _block_counts(*(batch.column(c)[k] for c in range(5)), buckets)

    return run


def _block_counts(chunks: pa.Scalar, entries: pa.Scalar, langs: pa.Scalar, sources: pa.Scalar, found: pa.Scalar, buckets: int) -> pa.RecordBatch:
    raw = entries.as_py()
    rows, n = np.frombuffer(raw[:16], "<i8").tolist()
    flat = np.frombuffer(pa.Codec("zstd", 3).decompress(raw[16:], 4 * (rows + 2 * n), asbytes=True), "<i4")
    ids, counts, first = flat[rows : rows + n], flat[rows + n :], np.append(0, np.cumsum(flat[:rows], dtype=np.int64))

    # terms of each chunk: its answer, or the chunk itself
    own = chunks.values.cast(pa.large_string())
    answers = found.values if found.is_valid else None
    place = answers.field("pos").to_numpy() if answers is not None else np.zeros(0, np.int64)
    lists = answers.field("terms") if answers is not None else pa.array([], pa.list_(pa.string()))
    size = np.ones(len(own), np.int64)
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    size[place] = length
    plain = np.ones(len(own), bool)
    plain[place] = False
    terms = pa.concat_arrays([own.filter(pa.array(plain)), lists.flatten().cast(pa.large_string())]).dictionary_encode()
    number = terms.indices.to_numpy(zero_copy_only=False)
    edge = np.append(0, np.cumsum(size))
    of = np.zeros(edge[-1], np.int64)
    of[edge[:-1][plain]] = number[: plain.sum()]
    of[np.repeat(edge[place] - np.cumsum(length) + length, length) + np.arange(length.sum())] = number[plain.sum() :]

    lang, source = (x.values.dictionary_encode() for x in (langs, sources))
    per, many = max(1, len(source.dictionary)), max(1, len(terms.dictionary))
    group = lang.indices.to_numpy().astype(np.int64) * per + source.indices.to_numpy()
    groups = max(1, len(lang.dictionary)) * per
    sums = [(np.zeros(0, np.int64),) * 3]
    row = 0
    while row < rows:  # some documents at a time
        stop = max(row + 1, int(np.searchsorted(first, first[row] + _ENTRIES, "right")) - 1)
        part, repeat = ids[first[row] : first[stop]], size[ids[first[row] : first[stop]]]
        # entries of chunks into entries of terms, one for each document and term
        term = of[np.repeat(edge[part] - np.cumsum(repeat) + repeat, repeat) + np.arange(repeat.sum())]
        doc = np.repeat(np.repeat(np.arange(row, stop), np.diff(first[row : stop + 1])), repeat)
        pair, held = _sums(doc * many + term, [np.repeat(counts[first[row] : first[stop]].astype(np.int64), repeat)])
        # then one for each term, language and source
        sums.append(_sums(pair % many * groups + group[pair // many], [held[0], np.ones(len(pair), np.int64)], flat=True))
        row = stop
    key, counts, docs = (np.concatenate(x) for x in zip(*sums, strict=True))
    key, counts, docs = _sums(key, [counts, docs], flat=True)
    # entries by the bucket of their term; a bucket's terms and entries travel as one compressed row
    raw_terms = terms.dictionary.to_pylist()
    bucket = np.array([crc32(t.encode()) % buckets for t in raw_terms], np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(many, np.int64)
    place[order] = np.arange(len(order))
    term = place[key // groups]
    by = np.argsort(term, kind="stable")
    key, counts, docs, term = key[by], counts[by], docs[by], term[by]
    names = terms.dictionary.cast(pa.string()).take(pa.array(order))
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    entry = np.searchsorted(term, edge)
    found = np.flatnonzero(np.diff(entry))
    sources_of, langs_of = (x.dictionary.cast(pa.string()) for x in (source, lang))
    rows = []
    for k in found.tolist():
        x = slice(entry[k], entry[k + 1])
        group_of = key[x] % groups
        columns = [pa.DictionaryArray.from_arrays(pa.array((group_of // per).astype(np.int32)), langs_of), pa.DictionaryArray.from_arrays(pa.array((term[x] - edge[k]).astype(np.int32)), names.slice(edge[k], edge[k + 1] - edge[k]))]
        columns += [pa.DictionaryArray.from_arrays(pa.array((group_of % per).astype(np.int32)), sources_of), pa.array(counts[x]), pa.array(docs[x])]
        part = pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "n", "docs"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
        rows.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "packed"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept terms of whole buckets, which come one after another."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["lang", "term", "source"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "term", "source", "n", "docs"])

    def kept(parts: list[pa.Table]) -> pa.RecordBatch:
        table = summed(parts).combine_chunks()
        lang, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term"))
        lang, term = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lang, term))
        key = lang.indices.to_numpy().astype(np.int64) * max(1, len(term.dictionary)) + term.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key, counts, docs = key[order], table.column("n").to_numpy()[order], table.column("docs").to_numpy()[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(key)))
        good = np.add.reduceat(docs, head) >= MIN_DOCUMENTS
        total, size, head = np.add.reduceat(counts, head)[good], size[good], head[good]
        at = np.repeat(head - np.cumsum(size) + size, size) + np.arange(size.sum())
        source = table.column("source").combine_chunks()
        source = source.chunk(0) if isinstance(source, pa.ChunkedArray) else source
        entries = pa.StructArray.from_arrays([source.take(pa.array(order[at])), pa.array(counts[at])], ["source", "n"])
        by_source = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), entries)
        own = pa.array(order[head])
        names = [x.dictionary.take(x.indices.take(own)).cast(pa.string()) for x in (lang, term)]
        return pa.RecordBatch.from_arrays([*names, pa.array(total), by_source], ["lang", "term", "n", "by_source"])

    held, rows, last = [], 0, None
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != last and held:
                yield kept(held)
                held, rows = [], 0
            last = bucket
            part = pa.ipc.open_stream(packed.as_buffer()).read_all()
            held.append(pa.table({c: part.column(c).cast(pa.string()) if c in ("lang", "term", "source") else part.column(c) for c in part.column_names}))
            rows += len(part)
            if rows >= _ENTRIES:
                held = [summed(held)]
                rows = len(held[0]) // 2  # twice as many before the next time, so each entry is summed a few times only
    if held:
        yield kept(held)


def _sums(key: np.ndarray, values: list[np.ndarray], flat: bool = False) -> tuple:
    """The distinct keys, ascending, and the sums of values for each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], head) if len(head) else np.zeros(0, np.int64) for v in values]
    return (key[head], *sums) if flat else (key[head], sums)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n, by_source): the kept terms of each language, their occurrences, and those of each source that has any.

    A row of docs (lang, source, text; nulls are '') is a document. A term is a maximal run of ASCII letters and code points from U+0080
    on, with A-Z lower-cased; it is kept if MIN_DOCUMENTS documents of the language have it.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = texts.rdd.getNumPartitions()
    blocks = staged_blocks(texts.mapInArrow(_blocks, _BLOCK), "chunk_blocks", parts)
    places = blocks.select("block", F.posexplode("chunks").alias("pos", "chunk"))
    lowered = F.translate(F.col("chunk"), _UPPER, _LOWER)
    terms = places.select("chunk").distinct().select("chunk", F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0)).alias("terms"))
    back = places.join(terms.where("terms <> array(chunk)"), "chunk").select("block", "pos", "terms")
    counted = blocks.select("block", "chunks", "entries", "langs", "sources").join(of_blocks(back, "struct(pos, terms)", parts).hint("shuffle_hash"), "block", "left")
    buckets = BUCKETS * max(1, parts)
    counted = counted.select("chunks", "entries", "langs", "sources", "found").mapInArrow(_counted(buckets), "bucket int, packed binary")
    return counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "lang string, term string, n long, by_source array<struct<source: string, n: long>>")


def _p(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for any counts."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(19, 0))) div cast({total} + {terms} as decimal(19, 0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _held_by_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of sources of a language the correction over terms that both hold: f(p, q) - f(p, base) - f(base, q) + f(base, base)."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        lang, source = batch.column(0).dictionary_encode(), flat.field("source").dictionary_encode()
        per = max(1, len(source.dictionary))
        lang_of, source_of = np.repeat(lang.indices.to_numpy(), size).astype(np.int64), source.indices.to_numpy().astype(np.int64)
        p, base = (flat.field(c).to_numpy() for c in ("p", "base"))
        first, size_of = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        step = np.searchsorted(np.cumsum(size_of), np.arange(0, int(size_of.sum()) + _PAIRS, _PAIRS), "right")
        for a, b in zip(step[:-1].tolist(), step[1:].tolist(), strict=True):
            many = size_of[a:b]
            i = np.repeat(np.arange(a, b), many)
            j = np.repeat(first[a:b] - np.cumsum(many) + many, many) + np.arange(many.sum())
            other = i != j
            i, j = i[other], j[other]
            value = f(p[i], p[j]) - f(p[i], base[j]) - f(base[i], p[j]) + f(base[i], base[j])
            sums.append(_sums((lang_of[i] * per + source_of[i]) * per + source_of[j], [value], flat=True))
        key, value = (np.concatenate([s[c] for s in sums] or [np.zeros(0, np.int64)]) for c in (0, 1))
        key, value = _sums(key, [value], flat=True)
        names = [lang.dictionary.take(pa.array(key // (per * per))), *(source.dictionary.take(pa.array(k)) for k in (key // per % per, key % per))]
        yield pa.RecordBatch.from_arrays([*names, pa.array(value)], ["lang", "source", "other", "value"])


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) of docs (lang, source, text).

    part `pair`: item is each other source of the language, value the sum of f(p, q) over all kept terms of the language, p of the row's source
    and q of the item. part `term`: item is a kept term that the source has and with p > q of the whole language, value f(p, q), to rank TOP.
    Ranks are by value, descending, then by the item's UTF-8 bytes. Null lang, source and text are ''. Every row counts as a document, repeated
    ones too; texts may have any length; a group without kept terms has only pair rows, a language without kept terms value 0 in
    them, a language of one source none. An empty table gives an empty table. No other column of docs is looked at.
    """
    kept = staged(term_counts(docs), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("terms"))
    flat = kept.select("lang", "term", F.col("n").alias("in_lang"), F.explode("by_source").alias("s")).select("lang", "term", "in_lang", "s.source", F.col("s.n").alias("n"))
    own = flat.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("held"))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["group_n", "held", "lang_n", "terms"])
    groups = staged(groups.withColumn("base", F.when(F.col("terms") > 0, _p("0", "group_n", "terms"))), "source-groups")

    placed = flat.join(groups, ["lang", "source"]).withColumn("p", _p("n", "group_n", "terms")).withColumn("q", _p("in_lang", "lang_n", "terms"))
    placed = staged(placed.select("lang", "term", "source", "p", "q", "base"), "placed-terms")
    # the sum over terms that a source holds, with the other's base, from how often it has each p
    levels = staged(placed.groupBy("lang", "source", "p").agg(F.count("*").alias("n")), "levels")
    this = groups.select("lang", "source", "terms", "held", "base")
    that = groups.select("lang", F.col("source").alias("other"), F.col("held").alias("other_held"), F.col("base").alias("other_base"))
    pairs = staged(this.join(that, "lang").where("source <> other"), "source-pairs")
    none = pairs.select("lang", "source", "other", F.when(F.col("terms") > 0, (F.col("terms") - F.col("held") - F.col("other_held")) * _f("base", "other_base")).otherwise(0).cast("long").alias("value"))
    here = levels.join(pairs, ["lang", "source"]).select("lang", "source", "other", (F.col("n") * _f("p", "other_base")).alias("value"))
    there = levels.withColumnRenamed("source", "other").join(pairs, ["lang", "other"]).select("lang", "source", "other", (F.col("n") * _f("base", "p")).alias("value"))
    shared = placed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "base")).alias("x")).where(F.size("x") > 1)
    both = shared.select("lang", "x").mapInArrow(_held_by_both, "lang string, source string, other string, value long")
    pair = none.union(here).union(there).union(both).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = placed.where("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
    pair, term = (x.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit(name)) for x, name in ((pair, "pair"), (term, "term")))
    return pair.unionByName(term.where(F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")
