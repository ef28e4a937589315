"""Near-duplicate documents by tensored MinHash tables and exact confirmation.

Method: a small collection of COLLECTION short hashes (each a pair of MinHash values) is drawn for a document, and every pair of
the collection's entries makes the key of one table. So 28 table keys need 16 MinHash values instead of 112. Documents that
meet in a table are candidates; all links are confirmed on the full shingle sets.

Plan, none of which holds a group in one task or on the driver:

1. One pass over the texts gives each document its set size, a 128-bit fingerprint of its set and the collection. Equal sets
   form a class and only its least doc_id goes on, so copies cost nothing later.
2. Table keys are counted; documents alone in all their tables are done.
3. Of the rest, a document can be linked only if at least 85 of 100 shingles occur in another candidate as well
   (intersection <= shared shingles). This exact bound removes edited copies that drifted too far. Shingles that one document
   alone holds are counted, so a shingle of most documents is one row per task.
4. Each live document is first compared with the most typical document (highest shared fraction) of its tables: one pair
   each, which joins most of a large group in linear work.
5. Documents in tables whose members are still in different components have their remaining pairs confirmed. A pair is
   looked at only if it shares one of the rarest shingles of both: with n shingles, one of the n - ceil(0.85 n) + 1 rarest has to
   be in any linked document's as well, so documents of one template, which differ in rare shingles, make no pairs. Pairs are left
   out where no table has both, where sizes or shared counts rule a link out, or where the triangle inequality does: Jaccard
   distance is a metric, so two documents whose distances to the same typical document differ by more than 15 of 100 are not linked.
   Shingles with many members, and typical documents with many pairs, are dealt into blocks.
6. Components by minimum labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import packed_texts, small_batches, staged, unpacked
from .words import Words, mix, run_hashes, slices

SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 85
COLLECTION = 8
#: Members of a shingle, or pairs of a typical document, that one block holds on average.
BLOCK = 2_000
#: Rarest shingles of a document that its rows carry.
HEAD = 32
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1 << 62, size=2 * COLLECTION, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1 << 62, size=2 * COLLECTION, dtype=np.uint64)
_PAIRS = [(i, j) for i in range(COLLECTION) for j in range(i)]


def _shingles(part: Words, lanes: int) -> list[np.ndarray]:
    """For each row of the part, its distinct shingles by the first half of their hashes, ascending, as (lanes, n) hashes.

    Fewer words than SHINGLE make one shingle.
    """
    hashes, out = part.hashes()[:lanes], []
    whole = np.stack([run_hashes(h, SHINGLE) for h in hashes])
    edges = part.row_words.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= SHINGLE:
            own = whole[:, a : b - SHINGLE + 1]
            out.append(own[:, np.unique(own[0], return_index=True)[1]] if lanes > 1 else np.unique(own)[None])
        else:
            out.append(np.stack([run_hashes(h[a:b], max(1, b - a)) for h in hashes]))
    return out


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """Table keys (rows, tables) of sets that are not empty."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    least = np.stack([np.minimum.reduceat((flat + b) * a, begin) for a, b in zip(_MULTIPLY, _ADD, strict=True)])
    short = mix(least[0::2] * np.uint64(0x9E3779B97F4A7C15) + least[1::2])
    return np.stack([mix(short[i] * np.uint64(2 * k + 3) + mix(short[j] + np.uint64(k))) for k, (i, j) in enumerate(_PAIRS)], axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:  # doc_id, text, check
        n, fingerprints, keys = [], [], []
        for part in slices(batch.column(1), lower=True):
            sets = _shingles(part, 2)
            n += [x.shape[1] for x in sets]
            fingerprints += [(x[0].sum(dtype=np.uint64), mix(x[1]).sum(dtype=np.uint64)) for x in sets]
            some = [x[0] for x in sets if x.shape[1]]
            table = iter(_keys(some)) if some else iter(())
            keys += [next(table) if x.shape[1] else None for x in sets]
        fp = np.array(fingerprints, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "check", "n_shingles", "f1", "f2", "keys"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, check (of the text, as packed_texts() has it), n_shingles, a fingerprint of the set (f1, f2) and its table keys (null for an empty set)."""
    small_batches(docs.sparkSession)
    check = (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) - (1 << 31)).cast("int").alias("check")
    return docs.select("doc_id", "text", check).mapInArrow(_signatures, "doc_id long, check int, n_shingles long, f1 long, f2 long, keys array<long>")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both, union = [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
            both.append(len(np.intersect1d(x, y, assume_unique=True)))
            union.append(len(x) + len(y) - both[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "both", "union"])


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Sizes of intersection and union of the full sets of the pairs (a, b); pairs of a frequent b are dealt into blocks."""
    small_batches(pairs.sparkSession)
    often = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    y = sets.select(F.col("node").alias("b"), F.col("packed").alias("y")).join(often, "b", "left").select("b", "y", F.explode(every).alias("block"))
    x = sets.select(F.col("node").alias("a"), F.col("packed").alias("x"))
    dealt = pairs.join(often, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    return dealt.join(x, "a").join(y, ["b", "block"]).select("a", "b", "x", "y").mapInArrow(_measured, "a long, b long, both long, union long")


def _pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [x[0].tobytes() for part in slices(unpacked(batch.column(1)), lower=True) for x in _shingles(part, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["node", "packed"])


def _rest_pairs(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of the documents of `apart` (node, n, shared, component, hub, distance, keys) that could be linked."""
    own = sets.join(apart.select("node"), "node", "left_semi").mapInArrow(_as_lists, "node long, shingles array<long>").select("node", F.explode("shingles").alias("s"))
    members = own.groupBy("s").agg(F.count("*").alias("m"))
    # of the prefix only shingles with another member can match; the ones that stand alone come first in it
    places = F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1 - (F.col("n") - F.size("common"))
    ranked = own.join(members.where("m > 1"), "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("m", "s"))).alias("common"))
    prefix = ranked.join(apart.select("node", "n"), "node").where(places > 0).select("node", F.slice("common", F.lit(1), F.greatest(places, F.lit(0)).cast("int"))["s"].alias("own"))
    # a row carries the head of the prefix only, so that rows and bytes grow with a text's length and not with its square
    prefix = staged(prefix.select("node", F.slice("own", 1, HEAD).alias("own"), F.explode("own").alias("s")), "prefixes")
    sizes = prefix.groupBy("s").agg(F.count("*").alias("m")).where("m > 1").select("s", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    prefix = prefix.join(sizes, "s").join(apart, "node")
    names = {"n": "n", "shared": "s", "component": "c", "keys": "k", "hub": "h", "distance": "d", "own": "o"}
    side = lambda z: [F.col("node").alias(z), *(F.col(c).alias(f"{short}{z}") for c, short in names.items())]
    x = prefix.select("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *side("a"))
    y = prefix.select("s", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), *side("b"))
    most = F.least("sa", "sb")  # no intersection is larger
    possible = (100 * most >= SIMILARITY * (F.col("na") + F.col("nb") - most)) & ((F.col("ha") != F.col("hb")) | (F.abs(F.col("da") - F.col("db")) <= 1 - SIMILARITY / 100 + 1e-9))
    in_table = F.exists(F.zip_with("ka", "kb", lambda p, q: p == q), lambda e: e)
    # a pair counts at the first shingle of the heads that it shares; at each one if the heads share none
    once = F.coalesce(F.get(F.array_intersect("oa", "ob"), F.lit(0)) == F.col("s"), F.lit(True))
    return x.join(y, ["s", "block"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & possible & once & in_table).select("a", "b").distinct()


def _as_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["node", "shingles"])


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and split into words; two documents are linked if 100 * intersection >= 85 * union of their
    distinct five-word shingles. component_id is the least doc_id that links reach, kept = (doc_id = component_id). Null,
    empty and wordless texts have n_shingles 0 and are linked with nothing. Rows with a null doc_id come back with null
    component_id and kept. Repeated rows are copies like others and come back as often as they came; rows that give one doc_id
    different texts are compared each by its own. Other columns of docs, whatever their names, are ignored.
    """
    signed = staged(signatures(docs), "signatures")
    some = signed.where("doc_id is not null and n_shingles > 0")
    classes = some.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "check")).alias("of"), F.min_by("keys", "doc_id").alias("keys"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # a doc_id may come with several texts
    tables = classes.select("node", F.explode(F.transform("keys", lambda k, t: F.xxhash64(t, k))).alias("key"))
    shared_keys = tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = staged(tables.join(shared_keys, "key", "left_semi"), "members")
    nodes = members.select("node").distinct()

    wanted = classes.join(nodes, "node", "left_semi").select("node", "of.doc_id", "of.check")
    texts = packed_texts(docs).where("doc_id is not null").join(wanted, ["doc_id", "check"])
    sets = staged(texts.select("node", "packed").mapInArrow(_pack_sets, "node long, packed binary").groupBy("node").agg(F.min("packed").alias("packed")), "sets")
    shingles = sets.mapInArrow(_as_lists, "node long, shingles array<long>").select("node", F.explode("shingles").alias("s"))
    lone = shingles.groupBy("s").agg(F.count("*").alias("m"), F.min("node").alias("node")).where("m = 1").groupBy("node").agg(F.count("*").alias("lone"))
    counts = classes.join(nodes, "node", "left_semi").select("node", F.col("n_shingles").alias("n"))
    live = counts.join(lone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("lone", F.lit(0))).where(F.col("shared") * 100 >= F.col("n") * SIMILARITY)
    live = staged(live.select("node", "n", "shared"), "live")
    members = staged(members.join(live, "node"), "live-members")

    # the most typical document of each table; each other member meets the best of those that it sees, and it only
    typical = F.struct((F.col("shared") / F.col("n")).alias("fraction"), (-F.col("node")).alias("minus"))
    heads = members.groupBy("key").agg(F.max(typical).alias("head"), F.count("*").alias("m")).where("m > 1").select("key", "head")
    first = members.join(heads, "key").groupBy("node").agg(F.max("head").alias("head")).select(F.col("node").alias("a"), (-F.col("head.minus")).alias("b")).where("a <> b")
    to_head = staged(_measure(first, sets), "to-head")
    linked = F.col("both") * 100 >= F.col("union") * SIMILARITY
    first_links = to_head.where(linked).select("a", "b")
    found = connected_components(first_links)
    far = to_head.select(F.col("a").alias("node"), F.col("b").alias("hub"), (1 - F.col("both") / F.col("union")).alias("distance"))

    # documents in tables whose members are still apart
    placed = members.join(found, "node", "left").join(far, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = staged(placed.withColumns({"hub": F.coalesce("hub", "node"), "distance": F.coalesce("distance", F.lit(0.0))}), "placed")
    per = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    nodes_apart = placed.join(per, "key").groupBy("node", "n", "shared", "component", "hub", "distance").agg(F.count("*").alias("tables"))
    apart = staged(nodes_apart.drop("tables").join(classes.select("node", "keys"), "node"), "apart")
    rest = staged(_rest_pairs(apart, sets), "rest-pairs")
    links = first_links.union(staged(_measure(rest, sets).where(linked).select("a", "b"), "rest-links"))
    component = connected_components(links)

    least = component.join(classes.select("node", F.col("of.doc_id").alias("low")), "node").groupBy("component").agg(F.min("low").alias("least"))
    named = classes.join(component.join(least, "component"), "node", "left").select("f1", "f2", "n_shingles", F.coalesce("least", "of.doc_id").alias("low"))
    whole = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    return whole.select("doc_id", "n_shingles", component_id.alias("component_id"), (F.col("doc_id") == component_id).alias("kept"))
