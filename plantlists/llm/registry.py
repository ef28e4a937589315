"""The queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql

#: The vocabulary of op5 among the public tokenizers' files on the driver's machine; its text travels to the executors.
VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from .quality_rules import judged

    return judged(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from .near_duplicates import near_duplicate_classes

    return near_duplicate_classes(_table(spark, folder, "documents"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    from .pii import pseudonymised

    return pseudonymised(_table(spark, folder, "documents"))


def op4_weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    from .weak_labels import scored

    return scored(_table(spark, folder, "documents"))


def op5_bpe(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    from .bpe import encoded

    out = encoded(_table(spark, folder, "documents"), Path(vocabulary or public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from .secrets import secret_digest

    return secret_digest(_table(spark, folder, "documents"))


def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from .substrings import substring_digest

    return substring_digest(_table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import packed

    return packed(_table(spark, folder, "documents"))


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    from .chat import perspectives

    return perspectives(_table(spark, folder, "conversations"))


def op10_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    from .embedding_duplicates import embedding_classes

    return embedding_classes(_table(spark, folder, "embeddings"))


def op11_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    from .suffix_duplicates import byte_digest

    return byte_digest(_table(spark, folder, "documents"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(_table(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(_table(spark, folder, "documents"))


QUERIES = (
    op1_quality_rules, op2_minhash, op3_pii, op4_weak_labels, op5_bpe, op6_secrets, op7_substrings, op8_packing, op9_chat, op10_embeddings,
    op11_suffixes, op12_divergence, op13_spelling,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.SQL.items() if k in queries()}
