"""Operators on offers: liveness, money in one currency, outliers, best offers, stock roll-ups.

Each takes and returns DataFrames; clocks and rates are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.views import CAPS, OUTLIER_RATIO, RATES, by_code, cents


def is_live(price: Column, stock: Column) -> Column:
    """A finite positive price, and not known to be out of stock."""
    return F.coalesce((price > 0) & (price < F.lit(float("inf"))) & (stock != "out_of_stock"), F.lit(False))


def to_try(amount: Column, code: Column, rates: dict[str, float] | None = None) -> Column:
    """An amount in TRY; null if the rate is unknown or the amount not positive."""
    return F.when(amount > 0, cents(amount * by_code(rates or RATES, F.coalesce(code, F.lit("TRY")))))


def is_over_cap(amount: Column, code: Column) -> Column:
    return F.coalesce(amount > by_code(CAPS, code), F.lit(False))


def flag_outliers(offers: DataFrame, key: str = "product_id", ratio: float = OUTLIER_RATIO) -> DataFrame:
    """offers with suspect: 'over-cap', 'outlier' (of three offers or more), or null.

    The middle is the upper median of the positive prices, from counts of equal prices: offers
    are counted before a product's prices meet, and those are added up in order without an array.
    """
    counted = offers.where(F.col("price") > 0).groupBy(key, "price").agg(F.count(F.lit(1)).alias("n"))
    upto, total = F.sum("n").over(Window.partitionBy(key).orderBy("price")), F.sum("n").over(Window.partitionBy(key))
    ranked = counted.select(key, "price", upto.alias("upto"), total.alias("n_priced"))
    middle = ranked.where(F.col("upto") > F.floor(F.col("n_priced") / 2)).groupBy(key, "n_priced").agg(F.min("price").alias("median"))
    outlier = (F.col("n_priced") >= 3) & (F.col("median") > 0) & (F.col("price") > F.col("median") * ratio)
    suspect = F.when(is_over_cap(F.col("price"), F.col("currency")), "over-cap").when(outlier, "outlier")
    return offers.join(middle, key, "left").withColumn("suspect", suspect).drop("n_priced", "median")


def best_offers(offers: DataFrame, key: str = "product_id") -> DataFrame:
    """Of each product: believable before suspect, in stock before other, no pre-order before
    pre-order, then the least price, then the least ord. One aggregation with partial results."""
    live = offers.where(is_live(F.col("price"), F.col("stock")))
    rank = F.struct(F.col("suspect").isNotNull().cast("int"), (F.col("stock") != "in_stock").cast("int"), F.col("preorder").cast("int"), "price", "ord")
    row = F.struct("store", "price", "was", "stock", "url", "ord")
    return live.groupBy(key).agg(F.min_by(row, rank).alias("b"), F.countDistinct("shop_id").alias("n_shops"), F.count(F.lit(1)).alias("n_live")).select(key, "b.*", "n_shops", "n_live")


def discount_percent(price: Column, was: Column) -> Column:
    """0 unless the old price is higher; rounded half up."""
    return F.when(was > price, F.floor((1 - price / was) * 100 + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))


def rollup_stock(offers: DataFrame, key: str = "product_id") -> DataFrame:
    """All out of stock: out of stock; else any in stock, any pre-order, else unknown.
    verified: every offer's status is known."""
    agg = offers.groupBy(key).agg(
        F.bool_and(F.col("stock") == "out_of_stock").alias("gone"),
        F.bool_or(F.col("stock") == "in_stock").alias("here"),
        F.bool_or("preorder").alias("ahead"),
        F.bool_and(F.col("stock") != "unknown").alias("verified"),
    )
    status = F.when(F.col("gone"), "out_of_stock").when(F.col("here"), "in_stock").when(F.col("ahead"), "preorder").otherwise("unknown")
    return agg.select(key, status.alias("status"), "verified")


def guard_shops(offers: DataFrame) -> DataFrame:
    """Shops of three offers or more that are all out of stock go back to unknown: a shop that
    looks wholly dead in one pass is more likely a page that could not be read."""
    dead = offers.groupBy("shop_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stock") == "out_of_stock").alias("out"))
    return offers.join(dead.where((F.col("n") >= 3) & (F.col("n") == F.col("out"))).select("shop_id", F.lit(True).alias("guarded")), "shop_id", "left").withColumn(
        "stock", F.when(F.col("guarded"), "unknown").otherwise(F.col("stock"))
    )


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def reprice_vat(offers: DataFrame, policy: Column) -> DataFrame:
    """Prices under a shop's VAT policy, reversibly: vat_added says which prices carry it."""
    add = (policy == "excluded") & ~F.col("vat_added")
    strip = (policy == "included") & F.col("vat_added")
    change = lambda c: F.when(F.col(c) <= 0, F.col(c)).when(add, cents(F.col(c) * 1.2)).when(strip, cents(F.col(c) / 1.2)).otherwise(F.col(c))
    return offers.withColumns({"price": change("price"), "was": change("was"), "vat_added": F.when(add, True).when(strip, False).otherwise(F.col("vat_added"))})
