"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All stages but the last return the columns of docs.

docs has doc_id and text; n_chars, where it is there, follows the text; all other columns, whatever their names, pass unchanged.
Nulls: a null text counts as empty and leaves in the first stage, as empty and wordless ones do; a row without a doc_id is judged by
its own text only (no copy of anything, no earlier passage) and stays; nulls in other columns pass. Texts of any length go through
whole. Repeated rows stay until near-duplicates, which keeps one of them. Empty tables give empty tables. Ties go to the smaller doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlists.llm.near_duplicates import near_duplicate_classes
from plantlists.llm.packing import packed
from plantlists.llm.quality_rules import without_rejected
from plantlists.llm.secrets import masked
from plantlists.llm.staging import staged
from plantlists.llm.substrings import without_repeats


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where docs has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned rules keep."""
    return without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least doc_id; rows without a doc_id stay.

    Rows are told apart by doc_id and text: a doc_id's further texts are judged under numbers of their own, and of rows that are
    equal in both one stays, the least by the other columns.
    """
    keyed = docs.withColumn("row_check", F.xxhash64("text"))
    pairs = staged(keyed.where("doc_id is not null").groupBy("doc_id", "row_check").agg(F.count("*").alias("n")), "row-keys")
    several = pairs.groupBy("doc_id").agg(F.min("row_check").alias("first"), F.count("*").alias("texts")).where("texts > 1")
    free = pairs.agg(F.coalesce(F.max("doc_id"), F.lit(0)) + 1).first()[0]
    further = pairs.drop("n").join(several.select("doc_id", "first"), "doc_id").where("row_check <> first").drop("first")
    further = staged(further.withColumn("node", F.lit(free).cast("long") + F.monotonically_increasing_id()), "further-texts")
    keyed = keyed.join(further, ["doc_id", "row_check"], "left").withColumn("node", F.coalesce("node", "doc_id"))

    classes = near_duplicate_classes(keyed.select(F.col("node").alias("doc_id"), "text"))
    named = staged(classes.where("doc_id is not null").select(F.col("doc_id").alias("node"), "component_id").distinct(), "row-classes")
    # op2 keeps the least number; where a group has further texts, the least doc_id decides instead, then its first text
    touched = named.join(further.select("node"), "node", "left_semi").select("component_id").distinct()
    place = F.struct(F.coalesce("doc_id", "node"), F.col("doc_id").isNotNull(), "row_check")
    best = named.join(touched, "component_id", "left_semi").join(further, "node", "left").groupBy("component_id").agg(F.min_by("node", place).alias("best"))
    gone = named.join(best, "component_id", "left").where(F.col("node") != F.coalesce("best", "component_id")).select("node")
    left = keyed.join(gone, "node", "left_anti")

    twins = pairs.where("n > 1").select("doc_id", "row_check")
    if twins.isEmpty():
        return left.select(docs.columns)
    once = left.join(twins, ["doc_id", "row_check"], "left_anti").select(docs.columns)
    one = left.join(twins, ["doc_id", "row_check"], "left_semi").groupBy("doc_id", "row_check").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.union(one.select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that stand in passages of earlier documents; texts with none are unchanged, texts of nothing else go."""
    found = without_repeats(docs, others=docs.columns)
    left = found.where("n_removed = 0 or n_removed < n_words")
    at = {c: f"o{k}" for k, c in enumerate(docs.columns)}
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(at["text"]))
    return _recounted(left.select(*(text.alias(c) if c == "text" else F.col(at[c]).alias(c) for c in docs.columns)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by the names of their kinds."""
    return _recounted(masked(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of each document."""
    return packed(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("repeated passages", repeated_passages), ("secrets", secrets), ("packing", packing)]

#: The learned rules and the bucket bounds come from fitting, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
