"""The pairs of groups against all pairs, and where they are made."""

import random

from pyspark.sql import functions as F

from shelfwise.operators import pairing
from shelfwise.plans import decisions


def test_group_pairs_are_all_pairs(spark):
    some = random.Random(7)
    rows = [(i, some.choice("ab"), some.choice(["p", "q", None]), some.choice(["x", "y", None]), some.choice([1, 2, None])) for i in range(150)]
    rows += [(5, "a", "p", "x", 1), (5, "a", "p", "x", 1), (None, "a", "p", "x", 1), (900, None, "p", "x", 1), (901, "alone", "p", "x", 1)]
    some.shuffle(rows)
    table = spark.createDataFrame(rows, "id long, g string, h string, c string, v int")
    both = lambda u, w: None if u is None or w is None else u == w
    want = []
    for i, *g, c, v in rows:
        for j, *h, d, w in rows:
            if None not in (i, j, *g) and g == h and i < j:
                parts = (both(v, w), both(c, d))
                want.append((i, j, False if False in parts else None if None in parts else True))
    order = lambda r: tuple((x is None, x) for x in r)
    for block_rows, parts in ((7, 5), (1, 3), (2048, None)):
        got = [tuple(r) for r in pairing.group_pairs(table, "id", ["g", "h"], ["v", "c"], block_rows, parts).collect()]
        assert sorted(got, key=order) == sorted(want, key=order)


def test_pair_generation_of_one_group_is_not_one_task(spark, tmp_path):
    n = 2200
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = decisions.pair_generation(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "same").alias("same")).collect()
    assert sum(t["n"] for t in tasks) == n * (n - 1) // 2
    assert sum(t["same"] for t in tasks) == 50 * (44 * 43 // 2)
    assert len(tasks) > 1
