"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, multiprobe buckets and exact confirmation.

A hash turns a vector by three rounds of random signs and a fast Walsh-Hadamard transform and takes the signed axis it is closest
to. A table key is made of HASHES such axes and the label, so only vectors of one label meet. Multiprobe: besides its own
key a vector also looks into the keys that differ in one hash, taking that hash's second best axis. So two vectors meet if one of them
has its own key in the other's list.

Pairs are compared in blocks: a bucket's members are dealt into blocks of BLOCK rows and each pair of blocks is one group,
so a bucket of any size spreads over tasks and no pair leaves a task unless it is confirmed. A pair which meets in several
tables is counted in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import staged

COSINE = 0.98
TABLES = 10
HASHES = 3
BLOCK = 512
#: Rows of all block pairs that are handed to one call, on average.
SLOT_ROWS = 10_000
#: Rows of a group whose pairs are listed together with those of other small groups; larger ones take a product of matrices each.
SMALL = 32
#: Pairs whose vectors are gathered at once.
PAIRS = 50_000
SEED = 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def axes(unit: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second nearest signed axis of each row after the rotation of this number."""
    width = 1 << max(0, int(unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([SEED, number, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    order = np.argsort(-size, axis=1, kind="stable")[:, :2] if width > 1 else np.zeros((len(x), 2), np.int64)
    pick = np.take_along_axis(x, order, axis=1)
    signed = order * 2 + (pick < 0)
    return signed[:, 0], signed[:, 1]


def table_keys(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own keys (rows, TABLES) and probes (rows, TABLES, HASHES): keys with one hash at its second axis."""
    base = 4 * (1 << max(0, int(unit.shape[1] - 1).bit_length()))
    own = np.full((len(unit), TABLES), unit.shape[1], np.int64)  # vectors of other lengths have other keys
    probes = np.full((len(unit), TABLES, HASHES), unit.shape[1], np.int64)
    for t in range(TABLES):
        best, second = zip(*(axes(unit, t * HASHES + k) for k in range(HASHES)), strict=True)
        for k in range(HASHES):
            own[:, t] = own[:, t] * base + best[k]
            for p in range(HASHES):
                probes[:, t, p] = probes[:, t, p] * base + (second[k] if p == k else best[k])
    return own, probes


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["node", "m", "vector", "own", "probes", "spots"]
    for batch in batches:
        lists = batch.column(1)
        width = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        edges = np.append(0, np.cumsum(width))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            x = np.stack([flat[edges[r] : edges[r + 1]] for r in rows])
            unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
            own, probes = table_keys(unit)
            spots = np.concatenate([own[:, :, None], probes], axis=2).reshape(len(rows), -1)  # of each table the own key and its probes
            as_bytes = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), as_bytes(x), as_bytes(own), as_bytes(probes), pa.array(list(spots), pa.list_(pa.int64()))], names
            )


def _pairs_of_small(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of row numbers inside groups of consecutive rows."""
    row = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    after = np.repeat(start + size, size) - row - 1  # rows of the group behind each row
    left = np.repeat(row, after)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)


def _near(unit: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of rows are linked."""
    return np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", unit[p[k : k + PAIRS]], unit[q[k : k + PAIRS]]) >= COSINE for k in range(0, len(p), PAIRS))])


def _linked_rows(unit: np.ndarray, group: np.ndarray, first: np.ndarray, second: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of one group; rows are sorted by group, and a group of two blocks pairs rows of different blocks only."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(group)))
    few = size <= SMALL
    p, q = _pairs_of_small(start[few], size[few])
    apart = (first[p] == second[p]) | (block[p] != block[q])
    p, q = p[apart], q[apart]
    near = _near(unit, p, q)
    found = [(p[near], q[near])]
    for s, n in zip(start[~few].tolist(), size[~few].tolist(), strict=True):
        rows = np.arange(s, s + n)
        a, b = rows[block[rows] == first[s]], rows[block[rows] == second[s]]
        hit = np.argwhere(unit[a] @ unit[b].T >= COSINE - 1e-9)
        p, q = a[hit[:, 0]], b[hit[:, 1]]
        if first[s] == second[s]:
            p, q = p[p < q], q[p < q]
        near = _near(unit, p, q)
        found.append((p[near], q[near]))
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect."""
    top: dict[int, int] = {}

    def root(v: int) -> int:
        while top.setdefault(v, v) != v:
            top[v] = v = top[top[v]]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        if (ru := root(u)) != (rv := root(v)):
            top[max(ru, rv)] = min(ru, rv)
            out.append((u, v))
    return out


def _compare(slot: pd.DataFrame) -> pd.DataFrame:
    """All block pairs of one slot: confirmed links, each in its first table only, as counts by vector and a spanning forest."""
    edges, ends, weights = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    widths = slot["vector"].map(len)
    for width in widths.unique():
        rows = slot[widths == width]
        group = rows.groupby(["label", "t", "key", "i", "j"], sort=False).ngroup().to_numpy()
        rows, group = rows.iloc[np.argsort(group, kind="stable")], np.sort(group)
        x = np.frombuffer(b"".join(rows["vector"])).reshape(len(rows), -1)
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        p, q = _linked_rows(unit, group, *(rows[c].to_numpy() for c in ("i", "j", "block")))
        own = np.frombuffer(b"".join(rows["own"]), np.int64).reshape(-1, TABLES)
        probes = np.frombuffer(b"".join(rows["probes"]), np.int64).reshape(-1, TABLES, HASHES)
        # a pair meets in a table where its own keys are equal, or where one's own key is in the other's probes
        at_p, at_q = (own[p][:, :, None] == probes[q]).any(axis=2), (own[q][:, :, None] == probes[p]).any(axis=2)
        same = own[p] == own[q]
        met = same | at_p | at_q
        table, key = rows["t"].to_numpy()[p], rows["key"].to_numpy()[p]
        # it counts in the first of these tables, there in the least of the keys where it meets
        pick, most = np.arange(len(p)), np.iinfo(np.int64).max
        key_p, key_q = own[p, table], own[q, table]
        least = np.minimum(np.where((same | at_p)[pick, table], key_p, most), np.where((same | at_q)[pick, table], key_q, most))
        mine = (met.argmax(axis=1) == table) & (least == key)
        p, q = p[mine], q[mine]
        node, m = rows["node"].to_numpy(), rows["m"].to_numpy()
        edges += _forest(node[p], node[q])
        ends += [node[p], node[q]]
        weights += [m[q], m[p]]  # a link to a class of equal vectors counts its members
    nodes, back = np.unique(np.concatenate(ends), return_inverse=True)
    counts = np.bincount(back, weights=np.concatenate(weights), minlength=len(nodes)).astype(np.int64)
    forest = np.array(edges, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": np.concatenate([nodes, forest[:, 0]]), "b": np.concatenate([nodes, forest[:, 1]]), "n": np.concatenate([counts, np.zeros(len(forest), np.int64)])}).astype("int64")


def embedding_classes(vectors: DataFrame) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label (not null) are linked from a cosine of 0.98 in double precision. Vectors that are null, empty, zero or hold nulls
    or non-finite components, and rows with a null label, are linked with nothing (n_links 0, component_id their own
    vec_id). Equal vectors of one label are compared once for all and count as links of each other. Rows with a null vec_id come back
    with null component_id and kept. A repeated vec_id counts as a vector of its own for others' n_links, and rows that give one vec_id several
    labels or vectors are compared each by its own. Vectors of other lengths are not comparable and do not link. Components whose squares
    are beyond double precision make a norm of infinity or zero: such vectors link with their equals only. Other columns are ignored.
    """
    values = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), values.alias("v"))
    rows = rows.withColumn("usable", F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists("v", lambda v: v != 0), F.lit(False)))
    rows = staged(rows.select("vec_id", "label", "usable", F.when(F.col("usable"), F.transform("v", lambda v: v + 0.0)).alias("v")), "vectors")
    usable = rows.where("usable")
    distinct = usable.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("m"))
    distinct = staged(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")  # a vec_id may come with several labels and vectors
    keyed = staged(distinct.select("node", "v", "m").mapInArrow(_keyed, "node long, m long, vector binary, own binary, probes binary, spots array<long>"), "keyed")
    spots = keyed.join(distinct.select("node", "label"), "node").select("node", "label", F.posexplode("spots").alias("at", "key"))
    spots = spots.select("node", "label", F.floor(F.col("at") / (HASHES + 1)).cast("int").alias("t"), "key").distinct()
    sizes = spots.groupBy("label", "t", "key").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = spots.join(sizes, ["label", "t", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets itself and all others; (i, j) with i <= j names the group
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    groups = dealt.select("node", "label", "t", "key", "block", F.inline(pairs)).join(keyed.drop("spots"), "node")
    # many small groups make up one slot, so that a slot's work and not a group's sets the cost of a call
    rows_to_come = sizes.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
    slots = max(1, int(rows_to_come) // SLOT_ROWS)
    groups = groups.withColumn("slot", F.pmod(F.xxhash64("label", "t", "key", "i", "j"), F.lit(slots)))
    found = staged(groups.groupBy("slot").applyInPandas(_compare, "a long, b long, n long"), "found")
    component = connected_components(found.where("a <> b").select("a", "b"))
    per = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    least = component.join(distinct, "node").groupBy("component").agg(F.min("low").alias("least"))
    known = distinct.join(per, "node", "left").join(component.join(least, "component"), "node", "left")
    known = known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("least", "low").alias("component"))
    out = rows.join(known, ["label", "v"], "left")
    component_id = F.when(F.col("vec_id").isNotNull(), F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id")))
    return out.select("vec_id", F.when(F.col("usable"), F.col("links")).otherwise(0).cast("long").alias("n_links"), component_id.alias("component_id"), (F.col("vec_id") == component_id).alias("kept"))
