"""Removal of repeated byte strings by column-wise construction of a collection's Burrows-Wheeler transform.

Which strings have to be compared. A window is WINDOW bytes of one document. Its anchor is the least hash of the ANCHOR-byte grams in it
(leftmost on ties), a function of its bytes: equal windows have equal anchors at equal distances. Consecutive windows with one
anchor form a segment of at most WINDOW + WINDOW - ANCHOR bytes, so texts of any length become short strings, and only
segments whose anchor occurs elsewhere too can hold a repeated window. Equal segments collapse to the earliest one, and the others are
repeats as a whole.

What decides about the rest. The different segments of an anchor form a collection, placed so that their anchors stand in one column.
It is built from the last column to the first, one symbol of each string a round (suffix_rounds): the strings stand in the order of
their suffixes after the column, the column's symbols read in that order are the newest part of the collection's transform, a stable sort of them
gives the order of the suffixes that begin with the column, and the common prefix of two neighbours is one more than the least common
prefix between them one round before. Neighbours with a common prefix of WINDOW bytes are equal windows. As equal windows
stand in one column, no round has to look back at the columns after it: each round replaces order, symbols and prefixes, reading
them in sequence once, and a collection costs its rounds times its strings, not the square of the rounds.

The sequential files of the construction are Spark's: blocks of texts with their segments in a bucketed table, and the exchanges between the
steps; a round's arrays stay in memory, bounded by COLLECTION strings, as a cluster's machines have no folders of their own here.

"Earlier" is a smaller doc_id, or the same document and an earlier start. Segments of a block are settled among themselves first, so an
anchor, a segment or a window reaches an exchange once for each block. An anchor with more than APART different segments is taken
apart into its windows, which meet by their digests instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import of_blocks, small_batches, staged, staged_blocks
from .words import mix, text_column

WINDOW, ANCHOR = 100, 32
#: Bytes of text of a block (a longer text is a block of its own), window starts hashed together, strings of a collection.
BLOCK_BYTES, _PIECE, COLLECTION = 4_000_000, 1 << 17, 1 << 15
#: Different segments of an anchor from which on its windows meet by themselves.
APART = 1 << 15
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_PLACE = np.uint64((1 << 18) - 1)
_NONE = np.zeros(0, np.int64)
_TYPES = {"d": "<i8", "i": "<i4", "b": "u1"}


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; each name's first letter gives the type."""
    raw = [np.ascontiguousarray(v, _TYPES[k[0]]).tobytes() for k, v in arrays.items()]
    sizes = np.array([len(x) for x in raw], "<i8").tobytes()
    return sizes + pa.Codec("zstd", 3).compress(b"".join(raw), asbytes=True)


def _unpack(packed: bytes, types: str) -> list[np.ndarray]:
    sizes = np.frombuffer(packed[: 8 * len(types)], "<i8")
    raw = pa.Codec("zstd", 3).decompress(packed[8 * len(types) :], int(sizes.sum()), asbytes=True)
    edge = np.append(0, np.cumsum(sizes))
    return [np.frombuffer(raw[a:b], _TYPES[t]) for a, b, t in zip(edge[:-1].tolist(), edge[1:].tolist(), types, strict=True)]


def segments(data: np.ndarray, edges: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor's distance from the first window and anchor of the segments of known rows of data."""
    mark = np.zeros(len(data) + 1, np.int8)
    rows = known & (np.diff(edges) >= WINDOW)
    mark[edges[:-1][rows]] += 1
    mark[edges[1:][rows] - (WINDOW - 1)] -= 1
    begins = np.cumsum(mark, dtype=np.int8)[:-1] > 0  # a window of one row begins here
    starts, counts, distances, anchors = [_NONE], [_NONE], [_NONE], [_NONE.view(np.uint64)]
    for at in range(0, len(data) - WINDOW + 1, _PIECE):
        part = data[at : at + _PIECE + WINDOW - 1]
        first = np.flatnonzero(begins[at : at + len(part) - WINDOW + 1])
        if not len(first):
            continue
        eight = np.ascontiguousarray(np.ndarray(len(part) - 7, "<u8", np.ascontiguousarray(part).data, strides=(1,)))  # the eight bytes from each place on
        n = len(part) - ANCHOR + 1
        grams = mix(sum(eight[8 * k : 8 * k + n] * _FACTORS[k] for k in range(ANCHOR // 8)))
        least, width = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64), 1
        while 2 * width <= WINDOW - ANCHOR + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = WINDOW - ANCHOR + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        place = (least[first] & _PLACE).astype(np.int64)
        head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        starts.append(first[head] + at)
        counts.append(np.diff(np.append(head, len(first))))
        distances.append(place[head] - first[head])
        anchors.append(grams[place[head]])
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(distances), np.concatenate(anchors)


def _block(block: int, ids: list, columns: list) -> pa.RecordBatch:
    column = pa.concat_arrays([text_column(c) for c in columns])
    edges = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: edges[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    known = np.array([i is not None for i in ids], bool)
    start, n, distance, anchor = segments(data, edges, known)
    values, first, number = np.unique(anchor, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")  # anchors by their first segment, so that numbers differ little from one to the next
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    number = place[number.ravel()]
    texts = _pack(d_edges=edges, d_ids=np.array([i or 0 for i in ids], np.int64), b_known=known, b_data=data)
    found = _pack(i_steps=np.diff(start, prepend=0), b_n=n, b_distance=distance, i_numbers=np.diff(number, prepend=0))
    columns = [pa.array([block], pa.int64()), pa.array([texts], pa.binary()), pa.array([found], pa.binary()), pa.array([values[order].view(np.int64)], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["block", "texts", "segments", "anchors"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    ids, columns, size = [], [], 0
    for batch in batches:
        own, column = batch.column(0).cast(pa.int64()).to_pylist(), text_column(batch.column(1))
        edges = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
        row = 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(edges, edges[row] + BLOCK_BYTES, "right")) - 1)
            ids += own[row:stop]
            columns.append(column.slice(row, stop - row))
            size += int(edges[stop] - edges[row])
            row = stop
            if 2 * size >= BLOCK_BYTES:
                yield _block(block, ids, columns)
                block += 1
                ids, columns, size = [], [], 0
                pa.default_memory_pool().release_unused()
    if ids:
        yield _block(block, ids, columns)


class _Block:
    """A block's texts and segments."""

    def __init__(self, texts: pa.Scalar, found: pa.Scalar):
        self.edges, self.ids, known, self.data = _unpack(texts.as_py(), "ddbb")
        self.known = known.astype(bool)
        steps, n, distance, numbers = _unpack(found.as_py(), "ibbi")
        self.start, self.number = np.cumsum(steps, dtype=np.int64), np.cumsum(numbers, dtype=np.int64)
        self.n, self.distance = n.astype(np.int64), distance.astype(np.int64)
        self.stop = self.start + self.n + WINDOW - 1

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id, and distance from the document's begin, of bytes of the block."""
        row = np.searchsorted(self.edges, at, "right") - 1
        return self.ids[row], at - self.edges[row]


def _digests(raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit digests of ranges of bytes, as two rows."""
    out = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(out, "<i8").reshape(-1, 2).T


def _earliest(content: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether no equal content stands at an earlier place (twins at one place are both earliest)."""
    order = np.lexsort((at, doc, content[1], content[0]))
    new = np.ones(len(order), bool)
    new[1:] = (content[:, order[1:]] != content[:, order[:-1]]).any(axis=0)
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    out = np.zeros(len(order), bool)
    out[order] = (doc[order] == doc[head]) & (at[order] == at[head])
    return out


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with repeated anchors that are the earliest of their content in the block; one more row for the others' numbers."""
    for batch in batches:
        for k in range(batch.num_rows):
            block, anchors, shared = batch.column(0)[k].as_py(), batch.column(3)[k].values.to_numpy(), batch.column(4)[k]
            b = _Block(batch.column(1)[k], batch.column(2)[k])
            repeated = np.bincount(b.number, minlength=len(anchors)) > 1
            if shared.is_valid:
                repeated[shared.values.to_numpy()] = True
            seg = np.flatnonzero(repeated[b.number])
            content = _digests(b.data.tobytes(), b.start[seg], b.stop[seg])
            doc, at = b.place(b.start[seg])
            own = _earliest(content, doc, at)
            rest = seg[~own].astype("<i4").tobytes()
            n = int(own.sum()) + 1
            columns = [
                pa.array(np.append(anchors[b.number[seg[own]]], block)), pa.array(np.append(content[0][own], block)), pa.array(np.append(content[1][own], 0)),
                pa.array(np.append(doc[own], 0)), pa.array(np.append(at[own], 0)), pa.array(np.full(n, block)), pa.array(np.append(seg[own], -1).astype(np.int32)), pa.array([None] * (n - 1) + [rest], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "c1", "c2", "doc_id", "at", "block", "seg", "part"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments; of those to be taken apart, the windows that are the earliest of the block, and one more row for each segment's others."""
    names = ["group", "raw", "distance", "doc_id", "at", "block", "seg", "shift", "part"]
    for batch in batches:
        for k in range(batch.num_rows):
            block, anchors = batch.column(0)[k].as_py(), batch.column(3)[k].values.to_numpy()
            b, want = _Block(batch.column(1)[k], batch.column(2)[k]), batch.column(4)[k].values
            raw, seg, apart = b.data.tobytes(), want.field("seg").to_numpy().astype(np.int64), want.field("apart").to_numpy(zero_copy_only=False)
            whole, parts = seg[~apart], seg[apart]
            size = b.n[parts]
            owner, shift = np.repeat(parts, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            begin = b.start[owner] + shift
            content = _digests(raw, begin, begin + WINDOW)
            own = _earliest(content, *b.place(begin))
            late = {int(s): bytes(shift[(owner == s) & ~own].astype(np.uint8)) for s in np.unique(owner[~own]).tolist()}
            start, stop = np.append(b.start[whole], begin[own]), np.append(b.stop[whole], begin[own] + WINDOW)
            ones, more, few = np.ones(int(own.sum()), np.int64), np.zeros(len(late), np.int64), list(late)
            doc, at = b.place(start)
            out = [
                np.concatenate([anchors[b.number[whole]], content[0][own], more + block]), [raw[x:y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)] + [b""] * len(few),
                np.concatenate([b.distance[whole], 0 * ones, more]), np.append(doc, more), np.append(at, more), np.full(len(start) + len(few), block),
                np.concatenate([whole, owner[own], np.array(few, np.int64)]), np.concatenate([0 * whole, shift[own], more]), [None] * len(start) + [late[s] for s in few],
            ]
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) if isinstance(x, np.ndarray) else pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)


def suffix_rounds(data: np.ndarray, edges: np.ndarray, distance: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rounds of the construction, from the last column to the first: the column, the order of the strings by their suffixes from it on, common prefixes.

    String k is data[edges[k] : edges[k + 1]] with its anchor at distance[k]; group, ascending, tells collections apart. Columns count from
    the farthest begin of a string. Strings that do not reach the column stand first in their group; prefixes belong to a string and the one before it.
    """
    n, size, left = len(group), np.diff(edges), int(distance.max())
    columns = left + int((size - distance).max())
    grid = np.zeros((columns, n), np.uint16)  # zero: the string has no byte here
    string = np.repeat(np.arange(n), size)
    grid.reshape(-1)[(np.arange(edges[-1]) - edges[string] - distance[string] + left) * n + string] = data.astype(np.uint16) + 1
    group = np.cumsum(np.append(False, group[1:] != group[:-1])).astype(np.uint16 if n <= 1 << 16 else np.int64)
    together = np.append(False, group[1:] == group[:-1])
    order, prefix = np.arange(n), np.zeros(n + 1, np.uint8)
    for column in range(columns - 1, -1, -1):
        symbols = grid[column][order]  # the newest part of the transform
        by = np.argsort(symbols, kind="stable")
        by = by[np.argsort(group[by], kind="stable")]  # groups keep their places
        symbols = symbols[by]
        same = np.flatnonzero(together & (symbols > 0) & np.append(False, symbols[1:] == symbols[:-1]))
        now = np.zeros(n + 1, np.uint8)
        if len(same):
            between = np.stack([by[same - 1] + 1, by[same] + 1], axis=1).reshape(-1)
            now[same] = np.minimum.reduceat(prefix, between)[::2] + 1
        order, prefix = order[by], now
        yield column - left, order, prefix[:-1]


def repeated_windows(data: np.ndarray, edges: np.ndarray, distance: np.ndarray, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, window): windows with an equal one in a string of smaller rank, of the same group."""
    strings, windows = [_NONE], [_NONE]
    for column, order, prefix in suffix_rounds(data, edges, distance, group):
        apart = prefix < WINDOW
        if apart.all():
            continue
        head, ranks = np.flatnonzero(apart), rank[order]
        late = order[ranks > np.minimum.reduceat(ranks, head)[np.cumsum(apart) - 1]]
        strings.append(late)
        windows.append(column + distance[late])
    return np.concatenate(strings), np.concatenate(windows)


def _collection(table: pa.Table) -> pa.RecordBatch:
    """(block, seg, part): the repeated windows of each segment of whole groups, as bytes."""
    table = table.combine_chunks()
    group, distance, doc, at, block, seg, shift = (table.column(c).to_numpy().astype(np.int64) for c in ("group", "distance", "doc_id", "at", "block", "seg", "shift"))
    raw = table.column("raw").chunk(0) if table.num_rows else pa.array([], pa.large_binary())
    edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    place = np.lexsort((at + distance, doc))
    doc, at = doc[place], (at + distance)[place]
    rank = np.empty(len(place), np.int64)
    rank[place] = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])))
    string, window = repeated_windows(data, edges - edges[0], distance, group, rank)
    window = window + shift[string]
    order = np.lexsort((window, seg[string], block[string]))
    string, window = string[order], window[order].astype(np.uint8)
    head = np.flatnonzero(np.append(True, (seg[string[1:]] != seg[string[:-1]]) | (block[string[1:]] != block[string[:-1]]))) if len(string) else _NONE
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(np.append(head, len(string)).astype(np.int64)), pa.py_buffer(window)])
    return pa.RecordBatch.from_arrays([pa.array(block[string[head]]), pa.array(seg[string[head]].astype(np.int32)), parts.cast(pa.binary())], ["block", "seg", "part"])


def _collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; whole groups are built together, about COLLECTION strings at a time."""
    held: list[pa.Table] = []
    rows = 0

    def built(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = table.column("group").to_numpy()
        number = np.cumsum(np.append(False, group[1:] != group[:-1])) if len(group) else _NONE
        several = np.bincount(number)[number] > 1
        if several.any():
            yield _collection(table.filter(pa.array(several)))

    for batch in batches:
        other = batch.column(batch.schema.get_field_index("part"))
        if other.null_count < len(other):  # windows settled in their block pass
            settled = batch.filter(other.is_valid())
            yield pa.RecordBatch.from_arrays([settled.column(c) for c in (5, 6, 8)], ["block", "seg", "part"])
            batch = batch.filter(other.is_null())
        table = pa.Table.from_batches([batch]).drop_columns(["part"])
        held.append(table.set_column(table.schema.get_field_index("raw"), "raw", table.column("raw").cast(pa.large_binary())))
        rows += len(table)
        if rows >= COLLECTION:
            table = pa.concat_tables(held)
            group = table.column("group").to_numpy()
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            yield from built(table.slice(0, cut))
            held, rows = [table.slice(cut)], len(table) - cut
    if rows:
        yield from built(pa.concat_tables(held))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        for k in range(batch.num_rows):
            b, found = _Block(batch.column(0)[k], batch.column(1)[k]), batch.column(2)[k]
            mark = np.zeros(len(b.data) + 1, np.int32)
            if found.is_valid:
                seg, part = found.values.field("seg").to_numpy().astype(np.int64), found.values.field("part")
                whole = [seg[part.is_null().to_numpy(zero_copy_only=False)], *(np.frombuffer(p.as_py(), "<i4") for p in part.filter(pa.array(seg < 0)))]
                whole = np.concatenate(whole).astype(np.int64)
                np.add.at(mark, b.start[whole], 1)
                np.add.at(mark, b.stop[whole], -1)
                some = np.flatnonzero((seg >= 0) & part.is_valid().to_numpy(zero_copy_only=False))
                texts = part.take(pa.array(some)).to_pylist()
                at = np.repeat(b.start[seg[some]], [len(t) for t in texts]) + np.frombuffer(b"".join(texts), np.uint8)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + WINDOW, -1)
            gone = np.cumsum(mark, out=mark)[:-1] > 0
            del mark
            heads = np.zeros(len(gone), bool)
            heads[b.edges[:-1][np.diff(b.edges) > 0]] = True
            before = np.append(False, gone[:-1])[: len(gone)]
            begin = np.flatnonzero(gone & (~before | heads))
            after = np.append(gone[1:] & ~heads[1:], False)[: len(gone)]
            stop = np.flatnonzero(gone & ~after) + 1
            row = np.searchsorted(b.edges, begin, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(x - b.edges[row]) for x in (begin, stop)], ["begin", "stop"])
            edges = np.searchsorted(row, np.arange(len(b.ids) + 1)).astype(np.int32)
            left = b.data[~gone]
            kept = b.edges - np.append(0, np.cumsum(gone, dtype=np.int32))[b.edges]
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b.ids), [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(left)])
            size = np.diff(b.edges)
            columns = [pa.array(b.ids, mask=~b.known), pa.array(size), pa.array(size - np.diff(kept)), pa.ListArray.from_arrays(pa.array(edges), spans).cast(kind), texts.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])
            pa.default_memory_pool().release_unused()


def without_repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, spans (begin, stop in bytes of the text), kept (binary).

    Texts are their UTF-8 bytes, null ones empty. A byte goes if some WINDOW bytes over it also start earlier: in a document with a
    smaller doc_id, or in the same one at an earlier place; strings are judged on the input, lie in one document and may overlap. spans are
    maximal runs of removed bytes; kept joins the others and may cut code points. Rows that repeat a doc_id stand at the same place in
    the order, so none of them is earlier than its twin. Rows with a null doc_id stand outside the order and keep all their bytes. Texts
    may have any length. An empty table gives an empty table. Other columns of docs are not looked at.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    parts = texts.rdd.getNumPartitions()
    blocks = staged_blocks(texts.mapInArrow(_blocks, "block long, texts binary, segments binary, anchors array<long>"), "text_blocks", parts)

    # anchors of more than one block, back to their blocks
    places = blocks.select("block", F.posexplode("anchors").alias("pos", "anchor"))
    shared = places.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1").select("block", "pos")
    asked = blocks.join(of_blocks(shared, "pos", parts).hint("shuffle_hash"), "block", "left").select("block", "texts", "segments", "anchors", "found")
    contents = asked.mapInArrow(_contents, "anchor long, c1 long, c2 long, doc_id long, at long, block long, seg int, part binary")

    # the earliest of each content; the others are repeats as a whole
    place = F.struct("doc_id", "at")
    contents = contents.withColumn("first", F.first(place).over(Window.partitionBy("c1", "c2").orderBy("doc_id", "at")) == place)
    judged = staged(contents.select("block", "seg", "part", "first", F.when(F.col("first"), F.col("anchor")).alias("anchor")), "segments")
    repeats = judged.where("not first or part is not null").select("block", "seg", "part")

    # anchors with several contents: their strings are built together
    firsts = judged.where("first and part is null").select("block", "seg", "anchor")
    sizes = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    several = firsts.join(sizes, "anchor").select("block", "seg", (F.col("n") > APART).alias("apart"))
    opened = blocks.join(of_blocks(several, "struct(seg, apart)", parts).hint("shuffle_hash"), "block").select("block", "texts", "segments", "anchors", "found")
    opened = opened.mapInArrow(_opened, "group long, raw binary, distance int, doc_id long, at long, block long, seg int, shift int, part binary")
    windows = staged(opened.repartition("group").sortWithinPartitions("group").mapInArrow(_collections, "block long, seg int, part binary"), "repeated-windows")

    found = of_blocks(repeats.union(windows), "struct(seg, part)", parts).hint("shuffle_hash")
    spans = "spans array<struct<begin: long, stop: long>>"
    return blocks.join(found, "block", "left").select("texts", "segments", "found").mapInArrow(_kept, f"doc_id long, n_bytes long, n_removed long, {spans}, kept binary")


def byte_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of without_repeated_bytes()."""
    out = without_repeated_bytes(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
