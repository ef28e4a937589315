"""Joins of points that lie near each other, with bounded copies and bounded groups."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import staged

#: A cell is CELL tolerances wide along each axis, so a box of two tolerances meets (1 + 2 / CELL)^3 cells on the average, 8 at most.
CELL = 8.0
#: Rows of one side that meet in one place; cells with more are dealt out in blocks.
DENSE = 4096
#: Boxes are this much wider than the tolerance, so that rounding loses no pair; the tolerance itself is tested on every pair.
_MARGIN = 1.02
#: Cells of own_pairs() are COARSE of the widest tolerance wide along each axis; those that more than CROWD rows share go through box_pairs().
COARSE, CROWD = 32.0, 131_072
#: Rows of own_pairs() that a task sorts on the average, rows that meet at a time, candidate pairs that are tested at a time.
TASK_ROWS, BATCH_ROWS, CANDIDATES = 500_000, 65_536, 262_144
#: Inside a coarse cell, rows meet in cells FINE tolerances wide.
FINE = 3.0


def _cells(box: int, axes: Sequence[tuple[str, float]], spread: bool) -> Column:
    """Structs (box, cell) of a point: its own cell, or all that its box meets."""
    ends = []
    for c, tolerance in axes:
        reach = tolerance * _MARGIN if spread else 0.0
        ends.append([F.floor((F.col(c) + s * reach) / (CELL * tolerance)) for s in ((-1, 1) if spread else (0,))])
    seen = F.array_distinct(F.array(*(F.xxhash64(F.lit(box), *cell) for cell in product(*ends))))
    return F.transform(seen, lambda cell: F.struct(F.lit(box).alias("box"), cell.alias("cell")))


def _dealt(df: DataFrame, counts: DataFrame, own: str, other: str) -> DataFrame:
    """Rows of dense cells get a block of their own side (by a hash of the row) and are copied to each block of the other side."""
    wide = df.join(counts, ["box", "cell"], "left")
    mine = F.pmod(F.xxhash64(*df.columns), F.coalesce(f"n_{own}", F.lit(1)))
    return wide.select(*df.columns, mine.alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"n_{other}", F.lit(1)) - 1)).alias(other))


def box_pairs(left: DataFrame, right: DataFrame, boxes: Mapping[str, Sequence[tuple[str, str, float]]]) -> DataFrame:
    """All pairs of rows that lie in a box: column box, columns of left, columns of right; a pair comes once for each box it lies in.

    boxes: for each box its axes (column of left, column of right, tolerance), up to three: the columns differ by the tolerance at most on
    each. Every box has a grid of cells; a right row stands in one cell of a grid, a left row in those its box meets, so the left side, which
    should be the smaller one, is copied a few times. Cells where more than DENSE rows of a side meet are dealt out in blocks of about DENSE by DENSE rows, so
    no task gets a whole dense cell. Rows with a null on an axis lie in no box that has it. The join is a sort-merge one: neither side is broadcast.
    """
    none = F.array().cast("array<struct<box: int, cell: bigint>>")

    def spread(df: DataFrame, side: int) -> DataFrame:
        grids = []
        for k, axes in enumerate(boxes.values()):
            placed = F.expr(" and ".join(f"{axis[side]} is not null" for axis in axes))
            grids.append(F.when(placed, _cells(k, [(axis[side], axis[2]) for axis in axes], side == 0)).otherwise(none))
        return df.select(*df.columns, F.inline(F.concat(*grids)))

    a, b = spread(left, 0), spread(right, 1)
    sizes = a.groupBy("box", "cell").agg(F.count("*").alias("a")).join(b.groupBy("box", "cell").agg(F.count("*").alias("b")), ["box", "cell"]).where(f"greatest(a, b) > {DENSE}")
    blocks = lambda c: F.ceil(F.col(c) / DENSE).cast("long").alias(f"n_{c}_block")
    sizes = staged(sizes.select("box", "cell", blocks("a"), blocks("b")), "dense-cells")
    keys = ["box", "cell"]
    if not sizes.isEmpty():
        a, b = _dealt(a, sizes, "a_block", "b_block"), _dealt(b, sizes, "b_block", "a_block")
        keys += ["a_block", "b_block"]
    inside = F.lit(False)
    for k, axes in enumerate(boxes.values()):
        here = F.col("box") == k
        for p, q, tolerance in axes:
            here = here & (F.abs(F.col(p) - F.col(q)) <= tolerance)
        inside = inside | here
    name = F.get(F.array(*map(F.lit, boxes)), F.col("box")).alias("box")
    return a.join(b.hint("merge"), keys).where(inside).select(name, *left.columns, *right.columns)


def own_pairs(rows: DataFrame, boxes: Mapping[str, Sequence[tuple[str, str, float]]]) -> DataFrame:
    """box_pairs() of a table with itself: column box, columns of the left row as a_<name>, of the right row as b_<name>; a row may meet itself.

    The columns of boxes are left and right points of one row, so a row crosses a single exchange with both: once for each coarse cell that its left
    point reaches or its right point lies in, mostly the same one. A pair is found where its right point lies. Tasks sort their rows by cells and
    match some cells at a time in memory. Rows of crowded cells go through box_pairs(); such cells are fewer than the copies of rows by CROWD, so they
    are broadcast. All boxes have to have the same axes.
    """
    widths = {(p, q): max(t for box in boxes.values() for a, b, t in box if (a, b) == (p, q)) for p, q, _ in next(iter(boxes.values()))}
    finite = F.expr(" and ".join(f"abs({q}) < double('Infinity')" for _, q in widths))
    known = rows.where(finite).agg(F.count("*"), *(f(q) for _, q in widths for f in (F.min, F.max))).first()
    # by axis: size of cells, where they begin (in cells), how many hold right points, so that a cell's number is less than 2^60
    grid = []
    for width, low, high in zip(widths.values(), known[1::2], known[2::2], strict=True):
        size = max(COARSE * width, ((high or 0.0) / 2 - (low or 0.0) / 2) / 2**18)
        begin = (low or 0.0) / size
        grid.append((size, begin, math.floor((high or 0.0) / size - begin) + 1))

    def place(point: Column, k: int) -> Column:
        size, begin, n = grid[k]
        return F.when(point.isNotNull(), F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), F.floor(point / size - begin))))

    def number(places: Sequence[str]) -> Column:
        return reduce(lambda whole, k: whole * grid[k][2] + F.col(places[k]), range(1, len(grid)), F.col(places[0]))

    # places are columns, since an explode would work them out anew for each of the cells
    own = [place(F.col(q), k).alias(f"_own{k}") for k, (_, q) in enumerate(widths)]
    ends = [place(F.col(p) + s * _MARGIN * width, k).alias(f"_{end}{k}") for k, ((p, _), width) in enumerate(widths.items()) for end, s in (("low", -1), ("high", 1))]
    corners = product(*((f"_low{k}", f"_high{k}") for k in range(len(grid))))
    spread = rows.select("*", *own, *ends).withColumn("_own", number([f"_own{k}" for k in range(len(grid))]))
    spread = spread.select(*rows.columns, "_own", F.explode(F.array_distinct(F.array(*map(number, corners), F.col("_own")))).alias("_cell")).where("_cell is not null")
    spread = spread.select(*rows.columns, "_cell", F.coalesce(F.col("_own") == F.col("_cell"), F.lit(False)).alias("_right"))

    crowded = staged(spread.groupBy("_cell").count().where(F.col("count") > CROWD).select("_cell"), "crowded-cells")
    crowds = not crowded.isEmpty()
    some = spread.join(F.broadcast(crowded), "_cell", "left_anti") if crowds else spread
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), known[0] // TASK_ROWS + 1)
    both = T.StructType([T.StructField("box", T.StringType()), *(T.StructField(f"{side}_{f.name}", f.dataType) for side in "ab" for f in rows.schema)])
    names, order = list(rows.columns), list(widths)
    axes = [(name, [(p, q, t, order.index((p, q))) for p, q, t in box]) for name, box in boxes.items()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            values = [table.column(c).combine_chunks() for c in names]
            for name, left, right in _met(table, axes, grid):
                columns = [pa.repeat(name, len(left)), *(v.take(pa.array(i)) for i in (left, right) for v in values)]
                yield pa.RecordBatch.from_arrays(columns, both.fieldNames())

    found = some.repartition(parts, "_cell").sortWithinPartitions("_cell").mapInArrow(each, both)
    if not crowds:
        return found
    dense = spread.join(F.broadcast(crowded), "_cell", "left_semi")
    side = lambda df, name: df.select(*(F.col(c).alias(f"{name}_{c}") for c in rows.columns), F.col("_cell").alias(f"_{name}_cell"))
    met = box_pairs(side(dense, "a"), side(dense.where("_right"), "b"), {name: [(f"a_{p}", f"b_{q}", t) for p, q, t in box] for name, box in boxes.items()})
    return found.unionByName(met.where("_a_cell = _b_cell").select(*both.fieldNames()))


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by cells, as tables of whole cells of about BATCH_ROWS rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH_ROWS:
            table = pa.Table.from_batches(held)
            cells = table.column("_cell").to_numpy()
            start = int(np.searchsorted(cells, cells[-1]))  # of the last cell, which may go on
            if start:
                yield table.slice(0, start)
            held = table.slice(start).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _met(table: pa.Table, boxes: Sequence[tuple[str, Sequence[tuple]]], grid: Sequence[tuple]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(box, left rows, right rows) of a table of whole cells, BATCH_ROWS pairs at most at a time; boxes: axes as (left, right, tolerance, place in the grid)."""
    number = table.column("_cell").to_numpy()
    rank = np.concatenate([[0], np.cumsum(number[1:] != number[:-1])])
    corners = []
    for size, begin, n in reversed(grid):
        corners.insert(0, (number % n + begin) * size)
        number = number // n
    value = {c: table.column(c).cast(pa.float64()).to_numpy() for _, axes in boxes for axis in axes for c in axis[:2]}
    lefts, rights = (np.logical_and.reduce([np.isfinite(value[axis[side]]) for axis in boxes[0][1]]) for side in (0, 1))
    lefts, rights = np.flatnonzero(lefts), np.flatnonzero(rights & table.column("_right").to_numpy())
    if not len(rights) or not len(lefts):
        return
    for name, axes in boxes:
        code, low, high, spans = rank[rights], [], [], []
        for p, q, tolerance, k in axes:
            fine = max(FINE * tolerance, grid[k][0] / 4096)
            span = int(grid[k][0] // fine) + 3
            place = lambda x, rows: np.clip(np.floor((x - corners[k][rows]) / fine), -1, span - 2).astype(np.int64) + 1  # noqa: B023, E731
            code = code * span + place(value[q][rights], rights)
            low.append(place(value[p][lefts] - _MARGIN * tolerance, lefts))
            high.append(place(value[p][lefts] + _MARGIN * tolerance, lefts))
            spans.append(span)
        order = np.argsort(code, kind="stable")
        codes, begin, count = np.unique(code[order], return_index=True, return_counts=True)
        seen = []
        for corner in product((0, 1), repeat=len(axes)):  # a left box reaches two fine cells along an axis at most
            use = np.flatnonzero(np.logical_and.reduce([h > w for h, w, up in zip(high, low, corner, strict=True) if up] or [np.ones(len(lefts), bool)]))
            wanted = rank[lefts[use]]
            for span, w, h, up in zip(spans, low, high, corner, strict=True):
                wanted = wanted * span + (h if up else w)[use]
            found = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            hit = codes[found] == wanted
            seen.append((lefts[use[hit]], begin[found[hit]], count[found[hit]]))
        left, begin, count = (np.concatenate(c) for c in zip(*seen, strict=True))
        total = np.cumsum(count)
        cuts = np.unique(np.searchsorted(total, np.arange(0, (total[-1] if len(total) else 0) + CANDIDATES, CANDIDATES), "right"))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = count[a:b]
            one = np.repeat(left[a:b], n)
            other = rights[order[np.arange(len(one)) + np.repeat(begin[a:b] - (np.cumsum(n) - n), n)]]
            near = np.logical_and.reduce([np.abs(value[p][one] - value[q][other]) <= t for p, q, t, _ in axes])
            one, other = one[near], other[near]
            for s in range(0, len(one), BATCH_ROWS):
                yield name, one[s : s + BATCH_ROWS], other[s : s + BATCH_ROWS]
