"""Near pictures: a Hamming-ball join of 64-bit picture hashes by multi-index blocks.

A hash is cut into PARTS blocks of 16 bits. Of two hashes that are `most` bits apart or fewer, some block
differs in few bits (pigeonhole): with q and r the quotient and rest of most by PARTS, one of the first
r + 1 blocks in at most q bits, or one of the others in at most q - 1. So each asked hash looks for its
blocks with up to so many bits changed, in an equi-join; distances decide afterwards, and no pair
is lost. Equal hashes (one placeholder on thousands of rows) are one hash for the join.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS, BITS = 4, 16


def median_hash(values: Column) -> Column:
    """16 hex digits for 64 numbers: a bit for each, 1 above the upper median; null for other lengths."""
    median = F.get(F.array_sort(values), F.lit(32))
    bit = lambda v, m: F.when(v > m, "1").otherwise("0")
    bits = F.get(F.transform(F.array(median), lambda m: F.array_join(F.transform(values, lambda v: bit(v, m)), "")), F.lit(0))
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(49), F.lit(16)), lambda i: F.lpad(F.conv(F.substring(bits, i, 16), 2, 16), 4, "0")), "")
    return F.when(F.size(values) == 64, F.lower(words))


def blocks(hash64: Column) -> Column:
    """The four 16-bit numbers of 16 hex digits."""
    return F.transform(F.sequence(F.lit(1), F.lit(13), F.lit(4)), lambda i: F.conv(F.substring(hash64, i, 4), 16, 10).cast("int"))


def is_hash(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{16}$"), F.lit(False))


def radii(most: int) -> list[int]:
    """How many bits a block may differ in, for each block; -1: it need not be looked at."""
    q, r = divmod(most, PARTS)
    return [q if i <= r else q - 1 for i in range(PARTS)]


def masks(radius: int) -> list[int]:
    """All numbers of BITS bits with at most radius of them set."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]


def near_hashes(asked: DataFrame, known: DataFrame, most: int = 10, within: list[str] | None = None) -> DataFrame:
    """[within,] a, b, distance: every asked hash with every known one at most `most` bits away.

    asked, known: [within,] and hash. within: columns that must be equal as well.
    """
    within = within or []
    side = lambda df, name: df.where(is_hash(F.col("hash"))).select(*within, F.col("hash").alias(name), blocks(F.col("hash")).alias(f"{name}_blocks")).distinct()
    index = side(known, "b").select(*within, "b", "b_blocks", F.posexplode("b_blocks").alias("part", "value"))

    def changed(part: int, radius: int) -> Column:
        return F.transform(F.array(*[F.lit(m) for m in masks(radius)]), lambda m: F.struct(F.lit(part).alias("part"), F.get("a_blocks", F.lit(part)).bitwiseXOR(m).alias("value")))

    near = [changed(i, r) for i, r in enumerate(radii(most)) if r >= 0]
    looked = side(asked, "a").select(*within, "a", "a_blocks", F.inline(F.concat(*near)))
    apart = F.aggregate(F.zip_with("a_blocks", "b_blocks", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return looked.join(index, [*within, "part", "value"]).withColumn("distance", apart).where(F.col("distance") <= most).select(*within, "a", "b", "distance").distinct()


def near_pictures(left: DataFrame, right: DataFrame, most: int = 10, top: int = 3, within: list[str] | None = None) -> DataFrame:
    """[within,] id, candidate, distance, rank: for every left row the `top` nearest right rows, at most `most` bits away.

    left, right: [within,] id and hash; rows without a hash of 16 hex digits have no picture. A row
    is no candidate of itself. Ties go to the least id. Of rows with one hash only the first top + 1
    can be anyone's candidates, so no more of them are joined back.
    """
    within = within or []
    pairs = near_hashes(left, right, most, within)
    first = Window.partitionBy(*within, "hash").orderBy("id")
    few = right.where(is_hash(F.col("hash"))).select(*within, "hash", "id").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1)
    found = left.select(*within, "id", F.col("hash").alias("a")).distinct().join(pairs, [*within, "a"]).join(few.select(*within, F.col("hash").alias("b"), F.col("id").alias("candidate")), [*within, "b"])
    order = Window.partitionBy(*within, "id").orderBy("distance", "candidate")
    ranked = found.where(F.col("id") != F.col("candidate")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select(*within, "id", "candidate", "distance", "rank")


def visual_score(distance: Column) -> Column:
    """1 for equal pictures, down to 0."""
    return F.greatest(F.lit(0.0), 1 - distance / 64)
