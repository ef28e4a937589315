"""Running numbers and fills over a global order, by ranges of rows.

A window over a group puts the whole group into one task. Here rows are dealt into ranges of the sort key (Spark samples its quantiles) and sorted inside them, so a
group of any size spreads over tasks; what a range has to know of the ranges before it is one row for each range and group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def _laid_out(df: DataFrame, by: Sequence[str], order: Sequence[Column], drop: Sequence[str] = ()) -> DataFrame:
    """df with _at, the place in the order by groups and order, and _range, without the columns drop; written once, so that both stay as they are."""
    keys = [*(F.col(c) for c in by), *order]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staged(laid.withColumn("_at", F.monotonically_increasing_id()).drop(*drop), "ranges").withColumn("_range", F.shiftright("_at", 33))


def _joined(df: DataFrame, of_range: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with what is known of its range and group; null groups are groups."""
    keys = ["_range", *by]
    other = of_range.select(*(F.col(c).alias(f"_of_{c}") for c in keys), *(c for c in of_range.columns if c not in keys))
    return df.join(other, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys)), "left").drop(*(f"_of_{c}" for c in keys))


def numbered(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with a running number from 1 in the given order within the groups of the columns by (null is a group; none: over all rows).

    A number is the place of a row in its range, and the rows of its group in the ranges before. Ties of the order are numbered in any order. Keys are plain
    values in ascending order; they become columns first, since a sort works an expression out again at every comparison.
    """
    keys = {f"_k{k}": c for k, c in enumerate(order)}
    rows = _laid_out(df.withColumns(keys), by, [F.col(c) for c in keys], drop=list(keys))
    sizes = rows.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and group
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = _joined(rows, sizes, by).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return out.drop("_at", "_range", "_first", "_before")


def placed(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with a number from 0 (under 2^54) that grows in the given order within the groups of by and leaves numbers out: numbered() where nobody counts, without its second pass.

    Keys are columns of df, as a sort works expressions out at every comparison.
    """
    return _laid_out(df, by, order).withColumnRenamed("_at", name).drop("_range")


def filled(df: DataFrame, values: Mapping[str, Column], order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """df with columns of the given names: the last value that is not null, up to the row, in the given order within the groups of by.

    Inside a range it is a running last value; a row with none before it in its range takes the last value of the ranges before.
    """
    own = {f"_v{k}": v for k, v in enumerate(values.values())}
    rows = _laid_out(df.withColumns(own), by, order)
    inside = Window.partitionBy("_range", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.groupBy("_range", *by).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(v) for v in own))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and group
    carried = last.select("_range", *by, *(F.last(v, ignorenulls=True).over(before).alias(f"_c{v}") for v in own))
    rows = rows.withColumns({f"_i{v}": F.last(v, ignorenulls=True).over(inside) for v in own})
    out = _joined(rows, carried, by).withColumns({name: F.coalesce(f"_i{v}", f"_c{v}") for name, v in zip(values, own, strict=True)})
    return out.drop("_at", "_range", *own, *(f"_i{v}" for v in own), *(f"_c{v}" for v in own))
