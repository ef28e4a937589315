"""Tables that cut lineage, in the shared folder that the cluster names, and batch sizes for Arrow workers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import drop_staged, shared_folder, staged

__all__ = ["drop_staged", "of_blocks", "packed_texts", "shared_folder", "small_batches", "staged", "staged_blocks", "unpacked"]

#: Rows, and bytes, of text that one Arrow batch may hold; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 4_000, 8_000_000
#: Most buckets of a table of blocks.
MAX_BUCKETS = 50_000


def small_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch of texts holds. Spark reads the bound when it runs a plan, so the session keeps it; lower ones stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        given = (spark.conf.get(name, None) or "").removesuffix("b")
        if not given.isdigit() or not 0 < int(given) <= most:
            spark.conf.set(name, str(most))


def packed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", others: Sequence[str] = ()) -> DataFrame:
    """(key, check, packed, o0, o1, ...): texts compressed before a shuffle by key, and other columns of docs by number.

    check, a checksum of the text, tells apart rows that share a key.
    """
    small_batches(docs.sparkSession)
    rest = docs.select(*(F.col(c).alias(f"o{k}") for k, c in enumerate(others)))
    schema = ", ".join(["doc_id long, check int, packed binary", *(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields)])
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(others))).mapInArrow(_pack, schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    codec = pa.Codec("zstd", 3)
    for batch in batches:
        raw = [(t.as_py() or "").encode() for t in batch.column(1)]
        packed = [len(x).to_bytes(4, "little") + codec.compress(x, asbytes=True) for x in raw]
        checks = pa.array([crc32(x) - (1 << 31) for x in raw], pa.int32())
        columns = [batch.column(0).cast(pa.int64()), checks, pa.array(packed, pa.binary()), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "check", "packed", *batch.schema.names[2:]])


def unpacked(column: pa.Array) -> pa.Array:
    """The texts of a packed column."""
    codec = pa.Codec("zstd", 3)
    out = []
    for x in column:
        x = x.as_py()
        out.append(codec.decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True) if len(x) > 4 else b"")
    return pa.array(out, pa.large_binary()).cast(pa.large_string())


def staged_blocks(blocks: DataFrame, name: str, parts: int) -> DataFrame:
    """Write a table with a column block once, bucketed by it, and read it back; joins on block then leave its rows where they are.

    A block is what one task made of a bounded number of texts, so writing needs no shuffle and makes one file for a block at most.
    """
    spark = blocks.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    blocks.write.bucketBy(max(1, min(parts, MAX_BUCKETS)), "block").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def of_blocks(rows: DataFrame, values: str, parts: int) -> DataFrame:
    """(block, found): the values (an SQL expression) of each block's rows, dealt out as staged_blocks() deals out blocks."""
    return rows.repartition(max(1, min(parts, MAX_BUCKETS)), "block").groupBy("block").agg(F.expr(f"collect_list({values})").alias("found"))
