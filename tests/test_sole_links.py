"""Links of rows and board items by equal names, counted and not paired."""

from collections import Counter

from pyspark.sql import functions as F

from shelfwise.operators import boards as B


def test_sole_links_are_those_of_all_pairs(spark):
    rows = [(1, "a", 1), (2, "b", 1), (3, "b", 1), (4, "c", 1), (5, None, 1), (6, "d", 1), (6, "d", 1), (7, "e", 1), (7, "f", 1), (8, "g", 2)]
    items = [("x", "a", 1), ("y", "b", 1), ("z", "c", 1), ("u", "c", 1), ("v", None, 1), ("w", "d", 1), ("e", "e", 1), ("g", "g", 2)]
    pairs = [(p, i) for p, *k in rows for i, *q in items if k == q and None not in k]
    n = Counter(p for p, _ in pairs)
    want = sorted((i, c) for i, c in Counter(i for p, i in pairs if n[p] == 1).items() if c == 1)
    got = B.sole_links(spark.createDataFrame(rows, "product_id long, name string, size int"), spark.createDataFrame(items, "id string, name string, size int"), ["name", "size"])
    assert sorted(map(tuple, got.collect())) == want == [("e", 1), ("g", 1), ("x", 1)]


def test_a_hot_name_is_not_paired(spark):
    hot = spark.range(300000).select(F.col("id").alias("product_id"), F.lit("a").alias("name"))
    got = B.sole_links(hot, hot.select(F.col("product_id").cast("string").alias("id"), "name"), ["name"])
    assert got.collect() == []
