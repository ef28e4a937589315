"""Removal of long passages that occur earlier in the corpus, by relative Lempel-Ziv parsing.

Documents are factored against the corpus itself, indexed in reference blocks. A block is anchored at the least five-word hash
(leftmost on ties) of a 20-word window; consecutive windows of a document with one anchor form a block that covers 20 words or
more. Equal windows always have equal anchors. The index gives, for each block content, the earliest place that has it.

A document is parsed greedily from left to right: a factor starts at the first block that the index holds at an earlier place
and is extended over the ends of blocks as long as the next block's place continues the same reference at the same distance;
where it does not, the factor is complete and the next one starts. Blocks hold whole windows, so every factor has 20 words or
more and all of its windows are duplicates. At factor boundaries a match may go on inside a block that as a whole occurs
nowhere earlier: blocks with no earlier place whose anchor occurs with other contents too. Their windows are checked one by one.
A block whose anchor has one content only cannot hold an earlier window. So the union of the factors and of the checked
windows is the union of all duplicate windows.

"Earlier" is a smaller doc_id, or the same document and an earlier start. Contents are told apart by 128-bit hashes made from
keyed digests of the words. Every batch first settles repeats among its own documents, so that a block common to a third of all
rows reaches the exchange once for each batch and not once for each row; anchors are counted before the exchange and spread over
contents after it. Texts cross an exchange compressed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import packed_texts, small_batches, staged, unpacked
from .words import Words, joined, mix, run_hashes, slices

WINDOW = 20
ANCHOR = 5
_SPAN = WINDOW - ANCHOR + 1
_NONE = np.zeros(0, np.int64)


def _blocks(part: Words, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window and last window (word numbers in the part) and anchor hash of every block; lane: a half of the words' digests."""
    if len(lane) < WINDOW:
        return _NONE, _NONE, _NONE, _NONE.view(np.uint64)
    grams = run_hashes(lane, ANCHOR)
    n = len(lane) - WINDOW + 1
    where = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, _SPAN).argmin(axis=1)
    row = np.searchsorted(part.row_words, np.arange(n), "right") - 1
    inside = np.flatnonzero(np.arange(n) + WINDOW <= part.row_words[row + 1])
    if not len(inside):
        return _NONE, _NONE, _NONE, _NONE.view(np.uint64)
    row, where = row[inside], where[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    return row[first], inside[first], inside[last], grams[where[first]]


def _contents(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128-bit hashes (two halves, one row each) of the blocks from window first to window last: of its two end windows, which cover it."""
    out = []
    for lane in hashes:
        whole = run_hashes(lane, WINDOW)
        out.append(joined(joined(whole[first], whole[last]), (last - first).astype(np.uint64)) if len(whole) else np.zeros(0, np.uint64))
    return np.stack(out)


def _heads(content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each (doc, start) the index of the earliest one with the same content among those given."""
    order = np.lexsort((start, doc, content[1], content[0]))
    c = content[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (c[:, 1:] != c[:, :-1]).any(axis=0)
    out = np.zeros(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    return out


def _batch_blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, start, anchor, content (two rows) of all blocks of a batch (doc_id, text), doc_id by row, and each block's head."""
    ids = batch.column(0).cast(pa.int64()).to_numpy()
    rows, starts, anchors, contents = [_NONE], [_NONE], [_NONE.view(np.uint64)], [np.zeros((2, 0), np.uint64)]
    for part in slices(batch.column(1)):
        hashes = part.hashes()
        row, first, last, anchor = _blocks(part, hashes[0])
        rows.append(row + part.first_row)
        starts.append(first - part.row_words[row])
        anchors.append(anchor)
        contents.append(_contents(hashes, first, last))
    row, start, anchor, content = np.concatenate(rows), np.concatenate(starts), np.concatenate(anchors), np.concatenate(contents, axis=1)
    return row, start, anchor, content, ids, _heads(content, ids[row], start)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and anchor the least and the greatest content (its first half) and the number of blocks, settled ones left out."""
    for batch in batches:
        row, start, anchor, content, ids, head = _batch_blocks(batch)
        own = (ids[row] == ids[row[head]]) & (start == start[head])
        a, c = anchor[own].view(np.int64), content[0][own].view(np.int64)  # signed, as Spark compares them
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        edge = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else _NONE
        stop = np.append(edge[1:], len(a))
        columns = [a[edge], c[edge], c[stop - 1], stop - edge] if len(a) else [_NONE] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "lo", "hi", "n"])


def _own_key(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key for what is settled in its batch, so that it adds to no group."""
    return mix(doc.astype(np.uint64) * np.uint64(31) + mix(start.astype(np.uint64)))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks; those with an earlier equal one in their batch carry its place."""
    from zlib import crc32

    for batch in batches:
        checks = np.array([crc32((t.as_py() or "").encode()) - (1 << 31) for t in batch.column(1)], np.int64)
        row, start, anchor, content, ids, head = _batch_blocks(batch)
        doc, source, source_start = ids[row], ids[row[head]], start[head]
        known = (doc != source) | (start != source_start)
        key = np.where(known, _own_key(doc, start), anchor)
        content = np.where(known, np.uint64(0), content)
        columns = [x.view(np.int64) for x in (key, content[0], content[1])]
        columns += [doc, checks[row].astype(np.int32), start.astype(np.int32)]
        places = [pa.array(source, mask=~known), pa.array(source_start.astype(np.int32), mask=~known)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *places], ["anchor", "c1", "c2", "doc_id", "check", "start", "source", "source_start"])


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the blocks that start at the given words."""
    for batch in batches:
        ids, checks, opened = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
        rows, starts, contents = [_NONE], [_NONE], [np.zeros((2, 0), np.uint64)]
        for part in slices(unpacked(batch.column(2))):
            hashes = part.hashes()
            row, first, last, _ = _blocks(part, hashes[0])
            want = np.concatenate([_NONE, *(np.array(opened[r + part.first_row], np.int64) + part.row_words[r] for r in range(len(part.row_words) - 1))])
            pick = np.isin(first, want)
            row, first, size = row[pick], first[pick], (last - first)[pick] + 1
            begin = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            row = np.repeat(row, size)
            rows.append(row + part.first_row)
            starts.append(begin - part.row_words[row])
            contents.append(_contents(hashes, begin, begin))
        row, start, content = np.concatenate(rows), np.concatenate(starts), np.concatenate(contents, axis=1)
        head = _heads(content, ids[row], start)
        known = (ids[row] != ids[row[head]]) | (start != start[head])
        content = np.where(known, _own_key(ids[row], start), content)
        columns = [content[0].view(np.int64), content[1].view(np.int64), ids[row], checks[row], start.astype(np.int32), known]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["c1", "c2", "doc_id", "check", "start", "known"])


def factors(start: np.ndarray, stop: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> np.ndarray:
    """Greedy factors of one document, as rows (begin, end, source document, begin there), from its blocks with an earlier place.

    start and stop: first words of the blocks' first and last windows, ascending. A factor goes on over the end of a block if the next
    block starts with the next window and its place lies in the same source at the same distance.
    """
    if not len(start):
        return np.zeros((0, 4), np.int64)
    goes_on = (start[1:] == stop[:-1] + 1) & (source[1:] == source[:-1]) & (source_start[1:] - source_start[:-1] == start[1:] - start[:-1])
    head = np.flatnonzero(np.append(True, ~goes_on))
    tail = np.append(head[1:], len(start)) - 1
    return np.stack([start[head], stop[tail] + WINDOW, source[head], source_start[head]], axis=1)


def _parsed(part: Words, lane: np.ndarray, places: list) -> list[np.ndarray]:
    """The factors of each row of the part; places: for each row its blocks with an earlier place (start, source, source_start)."""
    row, first, last, _ = _blocks(part, lane)
    edges, out = np.searchsorted(row, np.arange(len(places) + 1)), []
    for r, found in enumerate(places):
        if not found:
            out.append(np.zeros((0, 4), np.int64))
            continue
        known = np.unique(np.array([(x["start"], x["source"], x["source_start"]) for x in found], np.int64), axis=0)
        known = known[np.unique(known[:, 0], return_index=True)[1]]
        begin, end = first[edges[r] : edges[r + 1]] - part.row_words[r], last[edges[r] : edges[r + 1]] - part.row_words[r]
        out.append(factors(known[:, 0], end[np.searchsorted(begin, known[:, 0])], known[:, 1], known[:, 2]))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, windows = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        n, gone, kept, spans = [], [], [], []
        for part in slices(unpacked(batch.column(1))):
            rows = range(part.first_row, part.first_row + len(part.row_words) - 1)
            total = int(part.row_words[-1])
            some = any(places[r] for r in rows)
            found = _parsed(part, part.hashes()[0], [places[r] for r in rows]) if some else [np.zeros((0, 4), np.int64)] * len(rows)
            mark = np.zeros(total + 1, np.int64)
            for at, r, own in zip(part.row_words.tolist(), rows, found, strict=False):
                np.add.at(mark, at + own[:, 0], 1)
                np.add.at(mark, at + own[:, 1], -1)
                single = np.array(windows[r] or [], np.int64) + at
                np.add.at(mark, single, 1)
                np.add.at(mark, single + WINDOW, -1)
                spans.append([dict(zip(("begin", "stop", "source", "source_begin"), x, strict=True)) for x in own.tolist()])
            covered = np.cumsum(mark)[:-1] > 0
            left = np.flatnonzero(~covered)
            # bytes of kept words, each with one byte before it, which becomes the space between
            size = part.ends[left] - part.starts[left] + 1
            place = np.repeat(part.starts[left] - 1 - np.cumsum(size) + size, size) + np.arange(size.sum())
            out = part.data[np.maximum(place, 0)] if len(left) else np.zeros(0, np.uint8)
            edge = np.append(0, np.cumsum(size))
            out[edge[:-1]] = 0x20
            by_row = edge[np.searchsorted(left, part.row_words)]
            raw = out.tobytes()
            for r in range(len(rows)):
                kept.append(raw[by_row[r] + 1 : by_row[r + 1]])
            n.append(np.diff(part.row_words))
            gone.append(np.diff(np.searchsorted(np.flatnonzero(covered), part.row_words)))
        n, gone = (np.concatenate(x) if x else _NONE for x in (n, gone))
        columns = [batch.column(0), pa.array(n), pa.array(gone), pa.array(spans, _FACTORS), pa.array(kept, pa.large_binary()).cast(pa.large_string()), *batch.columns[4:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "factors", "kept_text", *batch.schema.names[4:]])


_FACTORS = pa.list_(pa.struct([(c, pa.int64()) for c in ("begin", "stop", "source", "source_begin")]))


def duplicate_places(docs: DataFrame) -> DataFrame:
    """(doc_id, check, places, windows) of the rows with any: blocks with their earliest place, and starts of single windows that occur earlier."""
    small_batches(docs.sparkSession)
    known = docs.where("doc_id is not null").select("doc_id", "text")
    anchors = known.mapInArrow(_anchored, "anchor long, lo long, hi long, n long").groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    anchors = anchors.where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    blocks = known.mapInArrow(_indexed, "anchor long, c1 long, c2 long, doc_id long, check int, start int, source long, source_start int")
    blocks = staged(blocks.join(anchors, "anchor", "left").where("source is not null or mixed is not null"), "reference-blocks")
    first = F.first(F.struct("doc_id", "start")).over(Window.partitionBy("anchor", "c1", "c2").orderBy("doc_id", "start"))
    found = blocks.where("source is null").withColumn("first", first)
    earlier = F.col("first") < F.struct("doc_id", "start")
    found = found.where(earlier | F.col("mixed")).select("doc_id", "check", "start", F.when(earlier, F.col("first.doc_id")).alias("source"), F.when(earlier, F.col("first.start")).alias("source_start"))
    found = found.unionByName(blocks.where("source is not null").select("doc_id", "check", "start", "source", "source_start"))
    placed, opened = F.expr("if(source is not null, struct(start, source, source_start), null)"), F.expr("if(source is null, start, null)")
    places = staged(found.groupBy("doc_id", "check").agg(F.collect_list(placed).alias("places"), F.collect_list(opened).alias("opened")), "places")

    texts = packed_texts(known).join(places.where("size(opened) > 0").select("doc_id", "check", "opened"), ["doc_id", "check"])
    windows = texts.select("doc_id", "check", "packed", "opened").mapInArrow(_open_windows, "c1 long, c2 long, doc_id long, check int, start int, known boolean")
    first = F.first(F.struct("doc_id", "start")).over(Window.partitionBy("c1", "c2").orderBy("doc_id", "start"))
    windows = windows.withColumn("dup", F.col("known") | (first < F.struct("doc_id", "start"))).where("dup")
    windows = staged(windows.groupBy("doc_id", "check").agg(F.collect_set("start").alias("windows")), "windows")
    return places.select("doc_id", "check", "places").join(windows, ["doc_id", "check"], "left")


def without_repeats(docs: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, factors, kept_text (kept words joined by one space), o0, o1, ...

    factors: the document's factors (begin, stop, source, source_begin in words, stop exclusive; source is the doc_id of the reference).
    o0, o1, ... are the columns of docs named in others; no other column is looked at, whatever its name.
    Words are compared unchanged. A word goes if some 20-word window over it occurs earlier: in a document with a smaller doc_id,
    or in the same one with an earlier start; windows are judged on the input. Null, empty and wordless texts have no words
    and an empty kept_text. Rows that repeat a doc_id stand at the same place in the order, so none of them is earlier than
    its twin. Rows with a null doc_id stand outside the order and keep all their words. An empty table gives an empty table.
    """
    places = staged(duplicate_places(docs), "duplicate-places")
    whole = packed_texts(docs, others=others).join(places, ["doc_id", "check"], "left")
    rest = [f"o{k}" for k in range(len(others))]
    factor = "factors array<struct<begin: long, stop: long, source: long, source_begin: long>>"
    schema = ", ".join([f"doc_id long, n_words long, n_removed long, {factor}, kept_text string", *(f"{c} {whole.schema[c].dataType.simpleString()}" for c in rest)])
    return whole.select("doc_id", "packed", "places", "windows", *rest).mapInArrow(_cut, schema)


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of without_repeats()."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
