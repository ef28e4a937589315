"""How queries are put together: derived inputs as expressions that Spark SQL and DuckDB read alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, name: str, columns: Sequence[str], where: str = "true") -> DataFrame:
    return table(spark, folder, name).where(where).selectExpr(*columns)


def derived_sql(name: str, columns: Sequence[str], where: str = "true") -> str:
    return f"SELECT {', '.join(columns)} FROM {name} WHERE {where}"


def scalar(name: str, base: Sequence[str], make: Callable[[], dict[str, Column]], sql: dict[str, str]) -> tuple[Query, str]:
    """A query of column functions over derived columns (k and others), and its SQL."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return derived(spark, folder, name, base).select("k", *(c.alias(n) for n, c in make().items()))

    return run, f"WITH t AS ({derived_sql(name, base)}) SELECT k, {', '.join(f'{x} AS {n}' for n, x in sql.items())} FROM t"
