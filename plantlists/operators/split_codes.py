"""Codes that a text extraction broke over two lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST = r"\b([0-3]\s?[A-Z]{3}\s?\d{2})\b"
SECOND = r"\b([A-Z]{2}\s?\d{3})\b"
WHOLE = r"[0-3]\s?[A-Z]{3}\s?\d{2}\s?[A-Z]{2}\s?\d{3}"


def extract_split_codes(lines: DataFrame) -> DataFrame:
    """File, line_no, code of each first part on a line with each second part on the next one; a line with a whole code has no first part of its own.

    lines: file, line_no, line. Neighbours are found by one window per file in order of line_no.
    """
    following = F.lead("line").over(Window.partitionBy("file").orderBy("line_no"))
    rows = lines.withColumn("next", following).where("next is not null").where(~F.col("line").rlike(WHOLE))
    parts = rows.select("file", "line_no", F.explode(F.regexp_extract_all("line", F.lit(FIRST), F.lit(1))).alias("a"), "next").select("file", "line_no", "a", F.explode(F.regexp_extract_all("next", F.lit(SECOND), F.lit(1))).alias("b"))
    return parts.select("file", "line_no", F.regexp_replace(F.concat("a", "b"), r"\s", "").alias("code")).distinct()
