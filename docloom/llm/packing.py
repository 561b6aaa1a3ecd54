"""Packing into length buckets whose boundaries minimise padding.

A dynamic programme over the global histogram of lengths chooses at most ``buckets``
boundaries; sequences are padded to their bucket's boundary and cut into batches whose
padded tokens stay within a budget.

Length is the number of words (runs of characters other than white space) unless the
caller gives a column.  A sequence longer than ``max_len`` becomes pieces of ``max_len``
and one rest, so that nothing is dropped.  A null or empty text has length 0 and takes part
in bucket 0 with boundary 0 and batch null; repeated rows are all packed; an empty table
gives no row.  Extra columns are left behind.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

BUCKETS = 12
MAX_LEN = 4096
TOKEN_BUDGET = 32768
SHARD_ROWS = 20_000


def optimal_boundaries(counts: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` boundaries, the last the largest length, of least total padding.

    ``counts`` maps length to number; the programme is quadratic in the distinct lengths.
    Of equally good choices, that with the fewest and then the smallest boundaries.
    """
    lengths = np.array(sorted(k for k, n in counts.items() if n > 0 and k > 0), np.int64)
    if not len(lengths):
        return []
    weight = np.array([counts[int(k)] for k in lengths], np.int64)
    below = np.concatenate([[0], np.cumsum(weight)])
    tokens = np.concatenate([[0], np.cumsum(weight * lengths)])
    n = len(lengths)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back: list[np.ndarray] = []
    totals = []
    for _ in range(min(buckets, n)):
        step, came = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (below[j] - below[:j]) - (tokens[j] - tokens[:j])
            came[j] = np.argmin(cost)
            step[j] = cost[came[j]]
        best = step
        back.append(came)
        totals.append(int(step[n]))
    k, j, chosen = int(np.argmin(totals)), n, []
    while j > 0:
        chosen.append(int(lengths[j - 1]))
        j = int(back[k][j])
        k -= 1
    return chosen[::-1]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def pack(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, max_len: int = MAX_LEN, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(id, piece, start, length, bucket, boundary, batch) for each piece of each row.

    Rows of a bucket are numbered by (shard, id, piece).  A shard is a hash of the id and
    piece, and there are enough of them that each holds about ``SHARD_ROWS`` rows, however
    large the bucket; shard counts give the numbers' offsets, so that batches are full but
    for the last of each bucket and no bucket is gathered in one task.
    """
    size = length if length is not None else word_count(F.col("text"))
    sized = df.select(F.col(id_col).alias("id"), size.alias("n"))
    pieces = sized.select("id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / max_len)).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * max_len
    rows = scratch.keep(pieces.select("id", "piece", start.alias("start"), F.least(F.lit(max_len).cast("long"), F.col("n") - start).alias("length")))
    histogram = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # at most max_len + 1 rows
    bounds = optimal_boundaries(histogram, buckets)
    total = sum(histogram.values())
    shards = max(1, -(-total // SHARD_ROWS))
    bucket = F.lit(0)
    boundary = F.lit(0).cast("long")
    for i, b in reversed(list(enumerate(bounds, 1))):
        bucket = F.when(F.col("length") <= b, i).otherwise(bucket)
        boundary = F.when(F.col("length") <= b, F.lit(b).cast("long")).otherwise(boundary)
    bucket = F.when(F.col("length") == 0, 0).otherwise(bucket)
    boundary = F.when(F.col("length") == 0, F.lit(0).cast("long")).otherwise(boundary)
    placed = rows.select("*", bucket.alias("bucket"), boundary.alias("boundary"), F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int").alias("shard"))
    per_shard = placed.groupBy("bucket", "shard").agg(F.count("*").alias("rows_here"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.keep(per_shard.select("bucket", "shard", F.coalesce(F.sum("rows_here").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("bucket", "shard").orderBy("id", "piece")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["bucket", "shard"])
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("boundary")))
    batch = F.when(F.col("boundary") > 0, F.floor((F.col("at") + F.col("offset")) / per_batch))
    return numbered.select(F.col("id").alias(id_col), "piece", "start", "length", "bucket", "boundary", batch.cast("long").alias("batch"))


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` packed into padded batches of at most 32,768 tokens."""
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "packing"))


QUERIES = {"op5_length_buckets": op5_length_buckets}
ORACLE_SQL: dict[str, str] = {}
