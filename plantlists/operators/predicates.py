"""Filters of list rows and small set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered
from .rules import contains_all, contains_any


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with some cell that is not blank."""
    some = F.lit(False)
    for c in columns or df.columns:
        some = some | ~_blank(c)
    return df.where(some)


def drop_null_key(df: DataFrame, key: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is not blank and none of the excluded values."""
    kept = df.where(~_blank(key))
    return kept.where(~F.trim(F.col(key).cast("string")).isin(*excluded)) if excluded else kept


def truncate_at_first_blank(df: DataFrame, key: str, group: str = "file", order: str = "row_pos") -> DataFrame:
    """The rows of each file before its first blank key."""
    stop = df.where(_blank(key)).groupBy(F.col(group).alias("_g")).agg(F.min(order).alias("_stop"))
    joined = df.join(stop, F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).select(df.columns)


def between_header_and(df: DataFrame, column: str, word: str, header_pos: str = "header_pos", group: str = "file", order: str = "row_pos") -> DataFrame:
    """Rows after the header row and before the first row whose cell begins with the word."""
    stop = df.where(F.lower(F.trim(column)).startswith(word.lower()) & (F.col(order) > F.col(header_pos))).groupBy(F.col(group).alias("_g")).agg(F.min(order).alias("_stop"))
    joined = df.join(stop, F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.where((F.col(order) > F.col(header_pos)) & (F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))).select(df.columns)


def drop_artifacts(df: DataFrame, legend: Sequence[str] = ("legend", "legende")) -> DataFrame:
    """Without columns Changed, Geändert and Unnamed..., legend rows and repeated header rows (a cell that equals its column's name in the first two columns)."""
    names = [c for c in df.columns if c not in ("Changed", "Geändert") and not c.startswith("Unnamed")]
    first = F.lower(F.trim(F.col(names[0]).cast("string")))
    header = F.lit(True)
    for c in names[:2]:
        header = header & (F.trim(F.col(c).cast("string")) == c)
    is_legend = F.lit(False)
    for w in legend:
        is_legend = is_legend | first.startswith(w)
    return df.select(names).where(~F.coalesce(header, F.lit(False)) & ~F.coalesce(is_legend, F.lit(False)))


def flag_empty_cells(df: DataFrame, exclude: Sequence[str] = (), conditional: Mapping[str, str] | None = None) -> DataFrame:
    """Column flag is X if a cell is blank; a column of conditional counts only where the other column is above 0."""
    out = F.lit(False)
    for c in df.columns:
        if c not in exclude:
            hit = _blank(c)
            if conditional and c in conditional:
                hit = hit & F.coalesce(F.col(conditional[c]).try_cast("double") > 0, F.lit(False))
            out = out | hit
    return df.withColumn("flag", F.when(out, "X").otherwise(""))


def stainless(material: Column) -> Column:
    """C4: 1.4571 in either notation, or a number equal to it."""
    return material.rlike(r"1[.,]4571") | F.coalesce(F.abs(F.replace(material, F.lit(","), F.lit(".")).try_cast("double") - 1.4571) < 1e-9, F.lit(False))


def concatenated(parts: Sequence[DataFrame]) -> DataFrame:
    """One table of all rows, missing columns null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def key_sets(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """S3: distinct row keys with the side they are on: both, a or b."""
    x, y = a.select(*columns).distinct(), b.select(*columns).distinct()
    tag = lambda df, s: df.withColumn("side", F.lit(s))
    return tag(x.intersect(y), "both").unionByName(tag(x.subtract(y), "a")).unionByName(tag(y.subtract(x), "b"))


def dedupe_names(df: DataFrame, name: str = "name", order: str = "row_pos") -> DataFrame:
    """the second and later rows of a name become name_2, name_3, ..."""
    return numbered(df, [F.col(order)], "_n", [name]).withColumn(name, F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")


def spec_order(df: DataFrame, path: str, second: str, third: str) -> DataFrame:
    """By the first segment of a path, a second column, a third as a number, nulls last, then row_pos."""
    segment = F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(1))
    return df.orderBy(segment.asc_nulls_last(), F.col(second).asc_nulls_last(), F.col(third).try_cast("double").asc_nulls_last(), F.col("row_pos"))


__all__ = [
    "between_header_and", "concatenated", "contains_all", "contains_any", "dedupe_names", "drop_artifacts", "drop_blank_rows", "drop_null_key", "flag_empty_cells", "key_sets", "spec_order", "stainless", "truncate_at_first_blank",
]
