"""Batches of documents under a token budget, inside length buckets whose bounds minimise padding.

The global histogram of lengths is one aggregation. All its lengths go through dynamic programming on the driver: cost(i, j) is
the padding of lengths i..j padded to length j, and the best split into k buckets follows from the best splits into k - 1. The cost
satisfies the quadrangle inequality, so the best last cut never moves back as j grows, and divide and conquer finds all cuts of one k
in O(m log m). m different lengths need m * m / 2 words at least, so m grows with the root of the table. Documents then take the
least bound that holds them, and batches fill up to the budget inside each bucket.

A bucket may hold any share of the rows, so ranks inside it are not taken in one task: rows are dealt to slots by a hash of
their id, ranked within (bucket, slot), and slot offsets come from the running sum of slot counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

BUCKETS = 16
BUDGET = 16_384
#: Rows that a slot holds on average.
SLOT_ROWS = 5_000


def n_words(text: Column) -> Column:
    """Words of a text, runs other than 0x20 and 0x09-0x0D (null: 0). Each begins where one such character or the start comes before."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds of at most `buckets` buckets with the least padding. lengths ascend; the last one is always a bound."""
    m = len(lengths)
    if not m:
        return []
    docs, tokens = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))
    # best[j]: least padding of the first j lengths in k buckets, for j >= k; a bucket over i..j-1 pads to lengths[j - 1]
    best = np.append(0, lengths * docs[1:] - tokens[1:])
    back = [np.zeros(m + 1, np.int64)]
    for k in range(2, min(buckets, m) + 1):
        new, frm = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        todo = [(k, m, k - 1, m - 1)]  # the cuts of j in low..high lie in least..most
        while todo:
            low, high, least, most = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = slice(least, min(most, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])
            at = int(np.argmin(cost))
            new[j], frm[j] = cost[at], least + at
            todo += [(low, j - 1, least, least + at), (j + 1, high, least + at, most)]
        back.append(frm)
        best = new
    bounds, j = [], m
    for frm in reversed(back):
        bounds.append(int(lengths[j - 1]))
        j = int(frm[j])
        if not j:
            break
    return sorted(bounds)


def length_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Bounds for the column n_tokens, empty rows left out."""
    histogram = lengths.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n"))
    found = sorted((r["n_tokens"], r["n"]) for r in histogram.collect())
    return best_bounds(np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64), buckets)


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens (words), bucket (from 0, by bound), padded_length, batch_id, row_in_batch, padding.

    A batch holds max(1, budget // padded_length) rows of one bucket, so padded tokens stay within the budget unless one document
    alone is longer; a document is never cut. All batches of a bucket but its last are full. Null, empty and wordless texts
    have n_tokens 0 and no bucket or batch (nulls). Equal rows stand side by side in any order. Other columns are ignored.
    """
    rows = staged(docs.select(F.col(key).cast("long").alias("doc_id"), n_words(F.col(text)).alias("n_tokens"), F.hash(text).alias("check")), "lengths-by-row")
    bounds = length_bounds(rows, buckets)
    bucket = F.lit(None).cast("int")
    bound = F.lit(None).cast("long")
    for k, b in reversed(list(enumerate(bounds))):
        bucket, bound = F.when(F.col("n_tokens") <= b, k).otherwise(bucket), F.when(F.col("n_tokens") <= b, b).otherwise(bound)
    some = F.col("n_tokens") > 0
    slots = max(1, rows.count() // SLOT_ROWS)
    placed = rows.select("doc_id", "n_tokens", "check", F.when(some, bucket).alias("bucket"), F.when(some, bound).alias("padded_length"), F.pmod(F.xxhash64("doc_id", "check"), F.lit(slots)).alias("slot"))
    sizes = placed.groupBy("bucket", "slot").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("bucket").alias("b"), F.col("slot").alias("s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "slot").orderBy("doc_id", "check", "n_tokens")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, F.col("bucket").eqNullSafe(F.col("b")) & (F.col("slot") == F.col("s")))
    place, room = F.col("rank") + F.col("offset"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_length")))
    out = ranked.select(
        "doc_id", "n_tokens", "bucket", "padded_length",
        F.when(F.col("bucket").isNotNull(), F.format_string("%d-%d", "bucket", F.floor(place / room))).alias("batch_id"),
        F.when(F.col("bucket").isNotNull(), place % room).alias("row_in_batch"), (F.col("padded_length") - F.col("n_tokens")).alias("padding"),
    )
    return out
