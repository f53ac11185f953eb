import pytest
from pyspark.sql import functions as F

from shelfwise.operators import clusters
from shelfwise.sources import markup as H
from shelfwise.sources import pages as G
from shelfwise.sources import sinks as S


def test_read_or_empty_and_config(spark, tmp_path):
    assert S.read_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "sites.txt").write_text("# shops\n a | https://a.example | 3\n\nb|https://b.example|4\n")
    got = S.read_config(spark, str(tmp_path / "sites.txt"), ["name", "url", "n"]).collect()
    assert [tuple(r) for r in got] == [("a", "https://a.example", "3"), ("b", "https://b.example", "4")]


def test_snapshots_publish_and_restore(spark, tmp_path):
    root = str(tmp_path / "cat")
    S.snapshot(spark.range(3), root, "one")
    S.snapshot(spark.range(5), root, "two")
    S.publish(spark, root, "two")
    assert S.current(spark, root).count() == 5
    S.publish(spark, root, "one")
    assert S.current(spark, root).count() == 3
    with pytest.raises(Exception, match="already exists"):
        S.snapshot(spark.range(1), root, "one")


def test_offers_are_written_with_flags(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10.0, "TRY"), (1, 11.0, "TRY"), (1, 900.0, "TRY")], "product_id long, price double, currency string")
    S.write_offers(rows, f"{tmp_path}/o")
    assert {r.price: r.suspect for r in spark.read.parquet(f"{tmp_path}/o").collect()} == {10.0: None, 11.0: None, 900.0: "outlier"}


def test_pairs_need_balance(spark, tmp_path):
    pairs = spark.range(200).select(F.when(F.col("id") % 2 == 0, "same").otherwise("different").alias("label"))
    S.write_pairs(pairs, f"{tmp_path}/p")
    assert spark.read.json(f"{tmp_path}/p").count() == 200
    with pytest.raises(ValueError):
        S.write_pairs(pairs.where("id < 199"), f"{tmp_path}/p")


def test_feed(spark):
    schema = "products array<struct<title:string,images:array<struct<src:string,variant_ids:array<long>>>,variants:array<struct<id:long,title:string,price:string,available:boolean>>>>"
    feed = spark.createDataFrame([([("PLA", [("a.jpg", []), ("b.jpg", [2])], [(1, "Default Title", "10.5", True), (2, "Red", "11", True), (3, "Blue", "9", False), (4, "Bad", "x", True)])],)], schema)
    assert sorted(map(tuple, S.explode_feed(feed).collect())) == [(1, "PLA", 10.5, "a.jpg"), (2, "PLA Red", 11.0, "b.jpg")]


def test_pages(spark):
    html = """<html><head><title> Shop &amp; more </title><meta content="K2 Plus" property="og:title"><meta property='og:image' content='https://x/k2.jpg'>
    <script type="application/ld+json">{"a": 1}</script></head><body><h1>Head</h1><a href="/p/k2/1">a</a><a href='/p/kx/2'>b</a><a href="/p/abc/3">c</a><a href="/about">d</a> 58.526,76 TL 46.236,14 TL Sepete Ekle</body></html>"""
    df = spark.createDataFrame([(1, "https://x/p", html), (2, "https://x/q", None), (3, "https://x/r", "<p>no price</p><title>t</title>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in H.read_product_page(df).collect()}
    assert (got[1].name, got[1].image, got[1].amount, got[1].stock, got[1].outcome) == ("K2 Plus", "https://x/k2.jpg", 46236.14, "in_stock", "product")
    assert got[2].outcome == "incomplete" and got[3].outcome == "incomplete"
    assert [r.n for r in G.link_shapes(df).collect()] == [3]
    urls = spark.createDataFrame([("https://a/x?page=3",), ("https://a/x",), ("https://a/cart/1",), ("https://a/p/{id}",), ("ftp://a/b",)], "u string")
    assert [r[0] for r in urls.select(G.next_page(F.col("u"))).collect()][:2] == ["https://a/x?page=4", "https://a/x?page=2"]
    assert [r[0] for r in urls.select(G.is_product_url(F.col("u"))).collect()] == [True, True, False, False, False]
    assert df.where("page_id = 1").select(G.json_ld(F.col("html"))).first()[0] == ['{"a": 1}']


def test_clusters(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (2, "a b c d e"), (3, "x y"), (4, "x y"), (5, "b c d e f"), (6, None)], "id long, t string").withColumn("g", F.lit(1))
    assert sorted(map(tuple, clusters.lead(rows, ["g"], "id", "t", 0.75).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)]
    nodes = spark.range(1, 9).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(8, 7), (7, 6), (6, 5), (3, 2)], "x long, y long")
    got = dict(map(tuple, clusters.connected(nodes, edges).collect()))
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5}
