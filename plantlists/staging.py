"""Tables that cut lineage, written to the folder that the cluster names for it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's staged tables, in spark.checkpoint.dir.

    Only a session on one machine (a local master, as in tests) may name none; on a cluster a machine's own folder would not do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _local_folder:
            _local_folder.append(tempfile.mkdtemp(prefix="spark-stage-"))
        folder = _local_folder[0]
    return f"{folder.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so that a lost executor costs no recomputation before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_buckets(df: DataFrame, name: str, keys: Sequence[str], parts: int) -> DataFrame:
    """staged() in buckets of the keys; joins on them leave its rows where they are. df comes dealt into as many parts by the keys, so a bucket is one file."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, *keys).option("path", f"{shared_folder(spark)}/{table}").option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def drop_staged(spark: SparkSession) -> None:
    """Remove all tables that this application staged; results that were not written elsewhere can't be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
