"""Structured Streaming jobs: a drop folder appended to one table with its log, and comments replicated to their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def page_log(rows: DataFrame) -> DataFrame:
    """By file and page: rows, whether a code was found, status."""
    g = rows.groupBy("filename", "page").agg(F.count("*").alias("rows"), F.coalesce(F.bool_or(F.coalesce(F.col("kks"), F.lit("")) != ""), F.lit(False)).alias("code_found"))
    return g.withColumn("status", F.when(F.col("code_found"), "OK").otherwise("NO CODE"))


def stream_ingest(spark: SparkSession, path: str, schema: str, sink: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """New files of a drop folder go to sink/data, their page log to sink/log, once each: batches overwrite their own partition if they are run again."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, df in (("data", batch), ("log", page_log(batch))):
                df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{sink}/{name}")
        finally:
            batch.unpersist()

    return spark.readStream.schema(schema).format(form).load(path).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def group_key(c: str):  # noqa: ANN201
    """Trimmed and in lower case; '-', 'n/a' and blanks are no group."""
    low = F.lower(F.trim(c))
    return F.when(~low.isin("", "-", "n/a"), low)


def latest_comments(changes: DataFrame) -> DataFrame:
    """Changes (group_text, comment, seq): the last comment of each group; an empty one clears."""
    keyed = changes.withColumn("key", group_key("group_text")).where("key is not null")
    return keyed.groupBy("key").agg(F.max_by(F.coalesce("comment", F.lit("")), "seq").alias("comment"), F.max("seq").alias("seq"))


def replicated(target: DataFrame, latest: DataFrame) -> DataFrame:
    """Target rows (id, group_text, comment) with the comments of their groups."""
    l = latest.select(F.col("key").alias("_k"), F.col("comment").alias("_c"))  # noqa: E741
    joined = target.join(l, group_key("group_text") == F.col("_k"), "left")
    return joined.select("id", "group_text", F.when(F.col("_k").isNull(), F.col("comment")).otherwise(F.when(F.col("_c") != "", F.col("_c"))).alias("comment"))


def _buckets(target: DataFrame, buckets: int) -> DataFrame:
    return target.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(group_key("group_text"), F.lit(""))), F.lit(buckets)).cast("int"))


def create_target(target: DataFrame, path: str, buckets: int = 64) -> None:
    """Write target rows (id, group_text, comment) as a table of hash buckets by group, which stream_upsert() keeps up to date."""
    rows = _buckets(target.select("id", "group_text", "comment"), buckets).withColumn("seq", F.lit(None).cast("long"))
    _written(rows, path, -1)


def _written(rows: DataFrame, path: str, version: int) -> None:
    rows = rows.withColumn("version", F.lit(version).cast("long")).repartition("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(bucket, version) of the folders of a target: two for each bucket at most."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/version=*")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or ()
    return [tuple(int(x.split("=")[1]) for x in f.getPath().toString().rsplit("/", 2)[1:]) for f in found]


def read_target(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The rows (id, group_text, comment, bucket, seq) of a target: each bucket's last version, or its last one before a batch."""
    last: dict[int, int] = {}
    for bucket, version in _versions(spark, path):
        if before is None or version < before:
            last[bucket] = max(version, last.get(bucket, version))
    schema = "id long, group_text string, comment string, seq long, bucket int, version long"
    rows = spark.read.schema(schema).parquet(path)
    wanted = spark.createDataFrame(sorted(last.items()), "bucket int, version long")  # a row for each bucket
    return rows.join(F.broadcast(wanted), ["bucket", "version"]).select("id", "group_text", "comment", "bucket", "seq")


def upsert_comments(batch: DataFrame, batch_id: int, path: str, buckets: int = 64) -> None:
    """The batch's last comment of each group to the target's rows of that group; an older one than a row has seen (by seq) changes nothing.

    Only the buckets of the batch's groups are written, as versions of their own: a batch that runs again starts from the versions before it and writes the same again,
    and a reader never sees a bucket that is half old. Older versions than the last two go.
    """
    spark = batch.sparkSession
    latest = _buckets(latest_comments(batch).withColumnRenamed("key", "group_text"), buckets).select(F.col("group_text").alias("_k"), F.col("comment").alias("_c"), F.col("seq").alias("_s"), "bucket")
    latest = latest.persist()
    try:
        touched = latest.select("bucket").distinct()  # as many as there are buckets at most
        rows = read_target(spark, path, batch_id).join(F.broadcast(touched), "bucket", "left_semi")
        joined = rows.join(latest.drop("bucket"), group_key("group_text") == F.col("_k"), "left")
        newer = F.col("_k").isNotNull() & (F.col("seq").isNull() | (F.col("_s") >= F.col("seq")))
        comment = F.when(newer, F.when(F.col("_c") != "", F.col("_c"))).otherwise(F.col("comment"))
        _written(joined.select("id", "group_text", comment.alias("comment"), F.when(newer, F.col("_s")).otherwise(F.col("seq")).alias("seq"), "bucket"), path, batch_id)
        _drop_old(spark, path, {r.bucket for r in touched.collect()})
    finally:
        latest.unpersist()


def _drop_old(spark: SparkSession, path: str, touched: set[int]) -> None:
    held: dict[int, list[int]] = {}
    for bucket, version in _versions(spark, path):
        held.setdefault(bucket, []).append(version)
    for bucket in touched:
        for version in sorted(held.get(bucket, ()))[:-2]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}/version={version}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def stream_upsert(spark: SparkSession, changes: str, schema: str, target: str, checkpoint: str, buckets: int = 64, files: int = 1_000) -> StreamingQuery:
    """A stream of change files (group_text, comment, seq) keeps a target of create_target() up to date, `files` files a batch at most."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        upsert_comments(batch, batch_id, target, buckets)

    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(changes).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_replicate(spark: SparkSession, changes: str, schema: str, store: str, checkpoint: str) -> StreamingQuery:
    """A stream of change files keeps a store of latest comments for readers that apply it by replicated(): each batch adds a partition, the last of all by seq counts.

    The store grows by a partition each batch; stream_upsert() keeps the target itself and stays as large as it is.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        latest_comments(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(store)

    return spark.readStream.schema(schema).parquet(changes).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
