"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number r in [0, N). A keyed Feistel network is a bijection of
[0, 4**h) for the least h that covers N; walking its cycles until the value falls below N
makes it a bijection of [0, N). The permuted number p gives shard = p mod shards and
slot = p div shards, so shards differ by one row at most, slots have no gaps, and both
can be computed from r alone (and r from them, by walking backwards).

Row numbers follow the content, not the files: rows are ordered by (bucket, key, size,
checksum) where bucket is a hash of the other three. Equal rows are counted before the
shuffle and numbered as a range, so no key can make a task large.

Nulls: a null text has size 1 and the checksum of no bytes; a null key is a key of its
own. Repeated rows get different numbers of one range; which of them is which does not show.
Of very long texts only size and checksum travel. Ties in the order are equal rows. An empty table gives no rows.
Columns other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of the row numbering: a fixed number, so that their totals are a small table.
BUCKETS = 4096
#: Copies of one row that are numbered by one generated row.
COPIES = 10_000
ROUNDS = 6


def round_keys(seed: int) -> list[int]:
    """The keys of the rounds, drawn from the seed by a linear generator."""
    keys, state = [], seed & (2**64 - 1)
    for _ in range(ROUNDS):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        keys.append(state)
    return keys


def half_bits(n: int) -> int:
    """Half the width of the least even-width domain that covers n values."""
    h = 1
    while 4**h < n:
        h += 1
    return h


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _pass(x: np.ndarray, h: int, keys: list[int], back: bool) -> np.ndarray:
    mask, h64 = np.uint64((1 << h) - 1), np.uint64(h)
    left, right = x >> h64, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_scramble(left, key) & mask), left
        else:
            left, right = right, left ^ (_scramble(right, key) & mask)
    return (left << h64) | right


def permute(numbers: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Where the permutation of [0, n) sends each number; back: where it comes from."""
    x = np.asarray(numbers).astype(np.uint64)
    if n <= 1:
        return x.astype(np.int64)
    h, keys = half_bits(n), round_keys(seed)
    out = _pass(x, h, keys, back)
    far = np.flatnonzero(out >= n)
    while len(far):  # walk the cycle until it comes back below n
        out[far] = _pass(out[far], h, keys, back)
        far = far[out[far] >= n]
    return out.astype(np.int64)


def place(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of one row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies in a slot of a shard: the inverse of place."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def permuted(row: Column, n: Column, seed: int) -> Column:
    """Column form of permute; n is the same in every row."""

    @F.pandas_udf(T.LongType())
    def walk(r: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), int(total.iloc[0]) if len(total) else 0, seed))

    return walk(row, n)


def number_rows(rows: DataFrame, key: str) -> DataFrame:
    """Adds row_number and n_rows to rows of (key, size, text_crc32): see the module's text."""
    cols = [key, "size", "text_crc32"]
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int"))
    totals = counted.groupBy("bucket").agg(F.sum("copies").alias("in_bucket"))
    # at most BUCKETS rows, whatever the input: one task orders them, and every task holds them
    ordered = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("in_bucket").over(ordered), F.lit(0)).alias("offset"), F.sum("in_bucket").over(Window.partitionBy()).alias("n_rows"))
    within = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in cols]).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(F.broadcast(offsets), "bucket")
    blocks = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("copies")) - 1)))
    return copies.select(*cols, (F.col("offset") + F.col("before") + F.col("copy")).alias("row_number"), "n_rows")


def shard_rows(docs: DataFrame, shards: int, seed: int = 20240229, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, row_number, n_rows, shard and slot of every row of docs."""
    if shards < 1:
        raise ValueError("shards must be positive")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    slim = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    numbered = number_rows(slim, key).withColumn("p", permuted(F.col("row_number"), F.col("n_rows"), seed))
    return numbered.withColumn("shard", F.pmod("p", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"p div {shards}")).drop("p")


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law "rows"."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_rows(docs, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
