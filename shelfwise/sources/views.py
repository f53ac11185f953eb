"""Catalogue views over the star-schema tables, as DataFrames and as the same SQL.

products come from part, shops from supplier with nation and region, offers from lineitem.
An offer's ord is its place among its product's offers by all columns, so that ties are
broken alike everywhere without a global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Currency of each region by key.
CURRENCIES = ("TRY", "USD", "EUR", "GBP", "CHF")
#: Fallback rates to TRY.
RATES = {"TRY": 1.0, "USD": 41.0, "EUR": 48.0, "GBP": 55.0}
#: The largest believable price of each currency.
CAPS = {"TRY": 700000.0, "USD": 20000.0, "EUR": 20000.0, "GBP": 20000.0, "CHF": 20000.0}
#: An offer over this many times the upper median of its product is an outlier.
OUTLIER_RATIO = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key over all cores: a table of few bytes comes in few splits, however much work is done on each row."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def cents(x: Column) -> Column:
    """Rounded half up to cents, the same in every engine."""
    return F.floor(x * 100 + 0.5) / 100


def by_code(values: dict[str, float], code: Column) -> Column:
    """The value of a currency code, null for a code that is not listed."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.upper(code))


#: Rows of a part that a task sorts; a larger table comes in more parts, so its memory does not grow with the table.
PART_ROWS = 1_000_000


def parted(rows: DataFrame, key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """rows as they are, or dealt by a key into more parts than the session makes where those would hold more than part_rows rows. Counts rows (of a table: from its footers)."""
    parts = -(-rows.count() // part_rows)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, "printer").otherwise("filament")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.concat_ws(" ", "p_brand", "p_type", "p_name", F.col("p_size").cast("string")).alias("name"),
        F.col("p_brand").alias("brand"),
        kind.alias("kind"),
        F.lower("p_type").alias("polymer"),
        F.col("p_size").alias("variant"),
        F.split("p_name", " ")[0].alias("color"),
        F.col("p_retailprice").alias("list_price"),
    )


PRODUCTS = """v_products AS (
  SELECT p_partkey AS product_id, p_brand || ' ' || p_type || ' ' || p_name || ' ' || p_size AS name, p_brand AS brand,
         CASE WHEN p_partkey % 2 = 0 THEN 'printer' ELSE 'filament' END AS kind, lower(p_type) AS polymer, p_size AS variant,
         string_split(p_name, ' ')[1] AS color, p_retailprice AS list_price FROM part)"""


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    currency = F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), F.col("n_regionkey") + 1)
    return s.select(F.col("s_suppkey").alias("shop_id"), F.col("s_name").alias("store"), currency.alias("currency"), F.when(F.col("n_nationkey") % 2 == 0, "included").otherwise("excluded").alias("vat_policy"), F.col("n_name").alias("nation"))


SHOPS = """v_shops AS (
  SELECT s_suppkey AS shop_id, s_name AS store, (['TRY','USD','EUR','GBP','CHF'])[n_regionkey + 1] AS currency,
         CASE WHEN n_nationkey % 2 = 0 THEN 'included' ELSE 'excluded' END AS vat_policy, n_name AS nation
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

_ORDER = ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def offers(spark: SparkSession, sf_dir: str, part_rows: int = PART_ROWS) -> DataFrame:
    # the order is made before any other column, so that all readers of offers in a query share one shuffle of the bare rows
    li = parted(table(spark, sf_dir, "lineitem"), "l_partkey", part_rows).withColumn("ord", F.row_number().over(Window.partitionBy("l_partkey").orderBy(*_ORDER)))
    was = cents(F.col("l_extendedprice") / F.col("l_quantity"))
    stock = F.when(F.col("l_returnflag") == "A", "in_stock").when(F.col("l_returnflag") == "R", "out_of_stock").otherwise("unknown")
    url = F.concat(F.lit("https://shop"), F.col("l_suppkey").cast("string"), F.lit(".example/p/"), F.col("l_partkey").cast("string"))
    return li.select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("shop_id"),
        was.alias("was"),
        cents(was * (1 - F.col("l_discount"))).alias("price"),
        stock.alias("stock"),
        ((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.06)).alias("preorder"),
        F.col("l_shipdate").alias("checked_at"),
        url.alias("url"),
        "ord",
    )


OFFERS = f"""v_raw AS (
  SELECT l_partkey AS product_id, l_suppkey AS shop_id, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS was, l_discount,
         CASE l_returnflag WHEN 'A' THEN 'in_stock' WHEN 'R' THEN 'out_of_stock' ELSE 'unknown' END AS stock,
         (l_linestatus = 'O' AND l_tax > 0.06) AS preorder, l_shipdate AS checked_at,
         'https://shop' || l_suppkey || '.example/p/' || l_partkey AS url,
         row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(_ORDER)}) AS ord FROM lineitem),
v_offers AS (SELECT product_id, shop_id, was, floor(was * (1 - l_discount) * 100 + 0.5) / 100 AS price, stock, preorder, checked_at, url, ord FROM v_raw)"""


def offers_with_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with store, currency and VAT policy; Spark broadcasts the shops if they are small."""
    return offers(spark, sf_dir).join(shops(spark, sf_dir), "shop_id")


OFFERS_WITH_SHOP = f"""{OFFERS}, {SHOPS}, v_full AS (SELECT o.*, s.store, s.currency, s.vat_policy, s.nation FROM v_offers o JOIN v_shops s USING (shop_id))"""
