"""Operators on offers: small cases and invariants."""

from pyspark.sql import functions as F

from shelfwise.operators import offers as O

SCHEMA = "product_id long, shop_id long, store string, price double, was double, stock string, preorder boolean, url string, ord int, currency string"


def offers(spark, rows):
    return spark.createDataFrame([(p, s, f"s{s}", price, price * 2 if price else None, stock, pre, f"u{o}", o, "TRY") for p, s, price, stock, pre, o in rows], SCHEMA)


def test_outliers_use_the_upper_median_and_caps(spark):
    rows = [(1, 1, 10.0, "in_stock", False, 1), (1, 2, 11.0, "in_stock", False, 2), (1, 3, 111.0, "in_stock", False, 3), (2, 1, 5.0, "in_stock", False, 4), (2, 2, 900.0, "in_stock", False, 5), (3, 1, 800000.0, "in_stock", False, 6), (4, 1, None, "in_stock", False, 7)]
    got = {r.ord: r.suspect for r in O.flag_outliers(offers(spark, rows)).collect()}
    assert got == {1: None, 2: None, 3: "outlier", 4: None, 5: None, 6: "over-cap", 7: None}


def test_best_offer_cascade(spark):
    rows = [(1, 1, 5.0, "out_of_stock", False, 1), (1, 2, 9.0, "unknown", False, 2), (1, 3, 10.0, "in_stock", True, 3), (1, 4, 12.0, "in_stock", False, 4), (1, 5, 12.0, "in_stock", False, 5), (2, 1, 3.0, "out_of_stock", False, 6)]
    best = O.best_offers(offers(spark, rows).withColumn("suspect", F.lit(None).cast("string"))).collect()
    assert [(r.product_id, r.ord, r.n_live, r.n_shops) for r in best] == [(1, 4, 4, 4)]
    suspect = F.when(F.col("ord").isin(4, 5), "outlier")
    assert O.best_offers(offers(spark, rows).withColumn("suspect", suspect)).first().ord == 3


def test_vat_flips_back(spark):
    o = offers(spark, [(1, 1, 29155.0, "in_stock", False, 1), (1, 2, 19999.0, "in_stock", False, 2)]).withColumn("vat_added", F.lit(False))
    added = O.reprice_vat(o, F.lit("excluded"))
    assert [r.price for r in added.orderBy("ord").collect()] == [34986.0, 23998.8]
    assert O.reprice_vat(added, F.lit("excluded")).exceptAll(added).count() == 0
    assert O.reprice_vat(added, F.lit("included")).exceptAll(o).count() == 0


def test_rollup_and_guard(spark):
    rows = [(1, 1, 1.0, "out_of_stock", False, 1), (1, 1, 1.0, "out_of_stock", False, 2), (2, 1, 1.0, "out_of_stock", False, 3), (2, 2, 1.0, "in_stock", False, 4), (3, 2, 1.0, "unknown", True, 5)]
    o = offers(spark, rows)
    assert {r.product_id: (r.status, r.verified) for r in O.rollup_stock(o).collect()} == {1: ("out_of_stock", True), 2: ("in_stock", True), 3: ("preorder", False)}
    assert {r.ord: r.stock for r in O.guard_shops(o).collect()} == {1: "unknown", 2: "unknown", 3: "unknown", 4: "in_stock", 5: "unknown"}


def test_money_helpers(spark):
    df = spark.createDataFrame([(100.0, "USD"), (100.0, None), (100.0, "XXX")], "a double, c string")
    assert [r[0] for r in df.select(O.to_try(F.col("a"), F.col("c"))).collect()] == [4100.0, 100.0, None]
    assert [r[0] for r in df.select(O.discount_percent(F.col("a"), F.lit(200.0))).collect()] == [50, 50, 50]
