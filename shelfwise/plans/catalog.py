"""Queries over the catalogue views: filters, joins, aggregations, windows, sorts, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators import offers as O
from shelfwise.plans.base import collection
from shelfwise.sources.views import OFFERS, OFFERS_WITH_SHOP, PRODUCTS, SHOPS, cents, offers, offers_with_shop, products, shops, table

QUERIES, ORACLES, query = collection()
#: The clock of queries that need one.
NOW = "2024-01-01 00:00:00"

_FLAGGED = f"""{OFFERS_WITH_SHOP},
v_mid AS (SELECT product_id, count(*) AS n_priced, list_sort(list(price))[count(*) // 2 + 1] AS median FROM v_full WHERE price > 0 GROUP BY 1),
v_flag AS (SELECT f.*, CASE WHEN price > CASE currency WHEN 'TRY' THEN 700000 ELSE 20000 END THEN 'over-cap'
                            WHEN n_priced >= 3 AND median > 0 AND price > median * 10 THEN 'outlier' END AS suspect
           FROM v_full f LEFT JOIN v_mid USING (product_id))"""


@query(f"WITH {PRODUCTS}, {SHOPS} SELECT (SELECT count(*) FROM v_products) AS n_products, (SELECT count(*) FROM v_shops) AS n_shops, (SELECT count(*) FROM lineitem) AS n_offers")
def scan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_products"))
    s = shops(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_shops"))
    return p.join(s).join(table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_offers")))  # one row each


@query(f"WITH {OFFERS} SELECT product_id, ord, price, stock FROM v_offers WHERE price > 0 AND stock <> 'out_of_stock'")
def live_offers(spark, sf_dir):
    return offers(spark, sf_dir).where(O.is_live(F.col("price"), F.col("stock"))).select("product_id", "ord", "price", "stock")


@query(f"WITH {OFFERS}, {PRODUCTS} SELECT product_id, name FROM v_products p WHERE EXISTS (SELECT 1 FROM v_offers o WHERE o.product_id = p.product_id AND price > 0 AND stock <> 'out_of_stock')")
def sellable_products(spark, sf_dir):
    live = offers(spark, sf_dir).where(O.is_live(F.col("price"), F.col("stock")))
    return products(spark, sf_dir).join(live, "product_id", "left_semi").select("product_id", "name")


@query(f"""WITH {OFFERS_WITH_SHOP}, {PRODUCTS} SELECT product_id, ord, price, price < (CASE kind WHEN 'printer' THEN 1000.0 ELSE 100.0 END) / (CASE WHEN currency = 'TRY' THEN 1 ELSE 40 END) AS below_floor,
 price > CASE currency WHEN 'TRY' THEN 700000 ELSE 20000 END AS over_cap FROM v_full JOIN v_products USING (product_id)""")
def price_floor_cap(spark, sf_dir):
    floor = F.when(F.col("kind") == "printer", 1000.0).otherwise(100.0) / F.when(F.col("currency") == "TRY", 1).otherwise(40)
    joined = offers_with_shop(spark, sf_dir).join(products(spark, sf_dir), "product_id")
    return joined.select("product_id", "ord", "price", (F.col("price") < floor).alias("below_floor"), O.is_over_cap(F.col("price"), F.col("currency")).alias("over_cap"))


@query(f"WITH {OFFERS} SELECT product_id, ord, CASE WHEN was > price THEN floor((1 - price / was) * 100 + 0.5)::bigint ELSE 0 END AS off FROM v_offers")
def discount_pct(spark, sf_dir):
    return offers(spark, sf_dir).select("product_id", "ord", O.discount_percent(F.col("price"), F.col("was")).alias("off"))


@query(f"WITH {OFFERS} SELECT stock, stock IN ('in_stock','out_of_stock','preorder','dropshipping') AS resolved, count(*) AS n FROM v_offers GROUP BY 1, 2")
def resolved_status(spark, sf_dir):
    resolved = F.col("stock").isin("in_stock", "out_of_stock", "preorder", "dropshipping")
    return offers(spark, sf_dir).groupBy("stock", resolved.alias("resolved")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PRODUCTS} SELECT product_id, name FROM v_products WHERE kind = 'filament' AND polymer LIKE 'standard%' AND variant <= 10 AND brand < 'Brand#3'")
def facet_path(spark, sf_dir):
    p = products(spark, sf_dir)
    return p.where((p.kind == "filament") & p.polymer.startswith("standard") & (p.variant <= 10) & (p.brand < "Brand#3")).select("product_id", "name")


@query(f"WITH {OFFERS}, {PRODUCTS}, b AS (SELECT product_id FROM v_offers GROUP BY 1 HAVING count(DISTINCT shop_id) > 1) SELECT product_id, name FROM v_products SEMI JOIN b USING (product_id) WHERE contains(lower(name), 'brass') ORDER BY product_id LIMIT 100")
def admin_filter(spark, sf_dir):
    many = offers(spark, sf_dir).groupBy("product_id").agg(F.countDistinct("shop_id").alias("n")).where("n > 1")
    p = products(spark, sf_dir).where(F.contains(F.lower("name"), F.lit("brass")))
    return p.join(many, "product_id", "left_semi").orderBy("product_id").limit(100).select("product_id", "name")


@query(f"WITH {OFFERS}, {PRODUCTS} SELECT product_id, name, list_price FROM v_products p WHERE list_price > 0 OR EXISTS (SELECT 1 FROM v_offers o WHERE o.product_id = p.product_id AND price > 0)")
def served_prune(spark, sf_dir):
    priced = offers(spark, sf_dir).where("price > 0").groupBy("product_id").agg(F.lit(True).alias("priced"))
    return products(spark, sf_dir).join(priced, "product_id", "left").where("list_price > 0 or priced").select("product_id", "name", "list_price")


@query(f"WITH {PRODUCTS} SELECT kind, CASE WHEN contains(lower(name), 'steel') THEN 'printer' ELSE 'filament' END AS detected, count(*) AS n FROM v_products GROUP BY 1, 2")
def category_mismatch(spark, sf_dir):
    detected = F.when(F.contains(F.lower("name"), F.lit("steel")), "printer").otherwise("filament")
    return products(spark, sf_dir).groupBy("kind", detected.alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OFFERS_WITH_SHOP} SELECT product_id, ord, price, currency, CASE currency WHEN 'TRY' THEN price WHEN 'USD' THEN floor(price * 41.0 * 100 + 0.5) / 100 WHEN 'EUR' THEN floor(price * 48.0 * 100 + 0.5) / 100 WHEN 'GBP' THEN floor(price * 55.0 * 100 + 0.5) / 100 END AS price_try FROM v_full")
def fx_to_try(spark, sf_dir):
    return offers_with_shop(spark, sf_dir).select("product_id", "ord", "price", "currency", O.to_try(F.col("price"), F.col("currency")).alias("price_try"))


@query(f"WITH {OFFERS} SELECT product_id, ord, floor(price * 1.2 * 100 + 0.5) / 100 AS with_vat, floor(floor(price * 1.2 * 100 + 0.5) / 100 / 1.2 * 100 + 0.5) / 100 AS without_vat FROM v_offers")
def vat_add_strip(spark, sf_dir):
    gross = cents(F.col("price") * 1.2)
    return offers(spark, sf_dir).select("product_id", "ord", gross.alias("with_vat"), cents(gross / 1.2).alias("without_vat"))


@query(f"""WITH {OFFERS_WITH_SHOP} SELECT product_id, ord, CASE WHEN vat_policy = 'excluded' THEN floor(price * 1.2 * 100 + 0.5) / 100 ELSE price END AS price,
 CASE WHEN vat_policy = 'excluded' THEN floor(was * 1.2 * 100 + 0.5) / 100 ELSE was END AS was, vat_policy = 'excluded' AS vat_added FROM v_full""")
def reprice_shop_vat(spark, sf_dir):
    o = offers_with_shop(spark, sf_dir).withColumn("vat_added", F.lit(False))
    return O.reprice_vat(o, F.col("vat_policy")).select("product_id", "ord", "price", "was", "vat_added")


def _flagged(spark, sf_dir):
    return O.flag_outliers(offers_with_shop(spark, sf_dir))


@query(f"WITH {_FLAGGED} SELECT suspect, count(*) AS n FROM v_flag GROUP BY 1")
def outlier_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).groupBy("suspect").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FLAGGED}, l AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY suspect IS NOT NULL, stock <> 'in_stock', preorder, price, ord) AS rn,
  count(*) OVER (PARTITION BY product_id) AS n_live FROM v_flag WHERE price > 0 AND stock <> 'out_of_stock'),
 s AS (SELECT product_id, count(DISTINCT shop_id) AS n_shops FROM l GROUP BY 1)
 SELECT product_id, store, price, was, stock, url, ord, n_shops, n_live, CASE WHEN was > price THEN floor((1 - price / was) * 100 + 0.5)::bigint ELSE 0 END AS off FROM l JOIN s USING (product_id) WHERE rn = 1""")
def best_offer(spark, sf_dir):
    """The cheapest believable offer of each product, its discount, and how many shops compete."""
    return O.best_offers(_flagged(spark, sf_dir)).withColumn("off", O.discount_percent(F.col("price"), F.col("was")))


@query(f"""WITH {OFFERS_WITH_SHOP} SELECT product_id, min(CASE currency WHEN 'TRY' THEN price WHEN 'USD' THEN floor(price * 41.0 * 100 + 0.5) / 100 WHEN 'EUR' THEN floor(price * 48.0 * 100 + 0.5) / 100 WHEN 'GBP' THEN floor(price * 55.0 * 100 + 0.5) / 100 ELSE price END) AS min_price FROM v_full WHERE price > 0 GROUP BY 1""")
def min_price(spark, sf_dir):
    o = offers_with_shop(spark, sf_dir).where("price > 0")
    return o.groupBy("product_id").agg(F.min(F.coalesce(O.to_try(F.col("price"), F.col("currency")), F.col("price"))).alias("min_price"))


@query(f"WITH {PRODUCTS} SELECT kind, coalesce(min(list_price), 0) AS low, coalesce(max(list_price), 0) AS high FROM v_products GROUP BY 1")
def price_stats(spark, sf_dir):
    return products(spark, sf_dir).groupBy("kind").agg(F.coalesce(F.min("list_price"), F.lit(0.0)).alias("low"), F.coalesce(F.max("list_price"), F.lit(0.0)).alias("high"))


@query(f"""WITH {PRODUCTS}, f AS (SELECT polymer, variant, brand, count(*) AS n, min(list_price) AS low, max(list_price) AS high FROM v_products WHERE kind = 'filament' GROUP BY 1, 2, 3)
 SELECT *, low = min(low) OVER (PARTITION BY polymer, variant) AS cheapest FROM f""")
def facets(spark, sf_dir):
    f = products(spark, sf_dir).where("kind = 'filament'").groupBy("polymer", "variant", "brand").agg(F.count(F.lit(1)).alias("n"), F.min("list_price").alias("low"), F.max("list_price").alias("high"))
    return f.withColumn("cheapest", F.col("low") == F.min("low").over(Window.partitionBy("polymer", "variant")))


@query(f"WITH {PRODUCTS} SELECT polymer, variant, grouping_id(polymer, variant) AS level, count(*) AS n, min(list_price) AS low FROM v_products WHERE kind = 'filament' GROUP BY ROLLUP (polymer, variant)")
def facets_rollup(spark, sf_dir):
    return products(spark, sf_dir).where("kind = 'filament'").rollup("polymer", "variant").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.min("list_price").alias("low"))


@query(f"WITH {PRODUCTS} SELECT brand, color, grouping_id(brand, color) AS level, count(*) AS n FROM v_products GROUP BY CUBE (brand, color)")
def facets_cube(spark, sf_dir):
    return products(spark, sf_dir).cube("brand", "color").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OFFERS}, {PRODUCTS} SELECT brand, polymer, count(DISTINCT product_id) AS options, count(DISTINCT shop_id) AS stores, min(price) AS low, list_sort(list(DISTINCT color))[1:12] AS colors
 FROM v_products JOIN v_offers USING (product_id) WHERE kind = 'filament' GROUP BY 1, 2""")
def family_groups(spark, sf_dir):
    j = products(spark, sf_dir).where("kind = 'filament'").join(offers(spark, sf_dir), "product_id")
    return j.groupBy("brand", "polymer").agg(F.countDistinct("product_id").alias("options"), F.countDistinct("shop_id").alias("stores"), F.min("price").alias("low"), F.slice(F.sort_array(F.collect_set("color")), 1, 12).alias("colors"))


@query(f"""WITH {OFFERS}, r AS (SELECT product_id, shop_id, ord, price, row_number() OVER (PARTITION BY product_id, shop_id ORDER BY ord) AS rn FROM v_offers)
 SELECT product_id, count(*) FILTER (rn = 1) AS merged, count(*) FILTER (rn > 1) AS leftover, min(price) FILTER (rn = 1) AS low FROM r GROUP BY 1""")
def merge_group(spark, sf_dir):
    r = offers(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("product_id", "shop_id").orderBy("ord")))
    return r.groupBy("product_id").agg(F.count_if(F.col("rn") == 1).alias("merged"), F.count_if(F.col("rn") > 1).alias("leftover"), F.min(F.when(F.col("rn") == 1, F.col("price"))).alias("low"))


@query(f"WITH {OFFERS} SELECT url, count(*) AS n, list_sort(list(ord)) AS ords FROM v_offers GROUP BY 1 HAVING count(*) > 1")
def dup_urls(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("ord")).alias("ords")).where("n > 1")


@query(f"WITH {OFFERS} SELECT url, product_id, ord, price FROM v_offers QUALIFY row_number() OVER (PARTITION BY url ORDER BY price DESC, ord) = 1")
def keep_best_row(spark, sf_dir):
    return O.keep_one(offers(spark, sf_dir), ["url"], [F.desc("price"), F.asc("ord")]).select("url", "product_id", "ord", "price")


@query(f"""WITH {OFFERS} SELECT url, arg_min(ord, ord) AS first_ord, arg_max(ord, ord) AS last_ord, arg_min(price, ord) AS first_price, arg_max(price, ord) AS last_price FROM v_offers GROUP BY 1""")
def keep_first_last(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("url").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.min_by("price", "ord").alias("first_price"), F.max_by("price", "ord").alias("last_price"))


@query(f"""WITH {OFFERS}, a AS (SELECT product_id, bool_and(stock = 'out_of_stock') AS gone, bool_or(stock = 'in_stock') AS here, bool_or(preorder) AS ahead, bool_and(stock <> 'unknown') AS verified FROM v_offers GROUP BY 1)
 SELECT product_id, CASE WHEN gone THEN 'out_of_stock' WHEN here THEN 'in_stock' WHEN ahead THEN 'preorder' ELSE 'unknown' END AS status, verified FROM a""")
def stock_rollup(spark, sf_dir):
    return O.rollup_stock(offers(spark, sf_dir))


@query(f"WITH {OFFERS} SELECT count(*) AS checked, count(*) FILTER (stock <> 'unknown') AS verified, count(*) FILTER (stock = 'out_of_stock') AS out_of_stock, count(*) FILTER (price <> was) AS repriced FROM v_offers")
def refresh_summary(spark, sf_dir):
    return offers(spark, sf_dir).agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("stock") != "unknown").alias("verified"), F.count_if(F.col("stock") == "out_of_stock").alias("out_of_stock"), F.count_if(F.col("price") != F.col("was")).alias("repriced"))


@query(f"""WITH {OFFERS}, o AS (SELECT * REPLACE (CASE WHEN shop_id % 7 = 0 THEN 'out_of_stock' ELSE stock END AS stock) FROM v_offers),
 d AS (SELECT shop_id FROM o GROUP BY 1 HAVING count(*) >= 3 AND bool_and(stock = 'out_of_stock'))
 SELECT CASE WHEN shop_id IN (SELECT shop_id FROM d) THEN 'unknown' ELSE stock END AS stock, count(*) AS n FROM o GROUP BY 1""")
def shop_guard(spark, sf_dir):
    o = offers(spark, sf_dir).withColumn("stock", F.when(F.col("shop_id") % 7 == 0, "out_of_stock").otherwise(F.col("stock")))
    return O.guard_shops(o).groupBy("stock").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PRODUCTS}, i AS (SELECT product_id, color || '-' || brand AS image FROM v_products), c AS (SELECT image, count(*) AS uses FROM i GROUP BY 1)
 SELECT product_id, CASE WHEN uses < 3 AND NOT (total >= 4 AND uses * 2 > total) THEN image END AS image FROM i JOIN c USING (image), (SELECT count(*) AS total FROM i)""")
def clone_images(spark, sf_dir):
    i = products(spark, sf_dir).select("product_id", F.concat_ws("-", "color", "brand").alias("image"))
    uses = i.groupBy("image").agg(F.count(F.lit(1)).alias("uses"))
    total = i.agg(F.count(F.lit(1)).alias("total"))  # one row
    ok = (F.col("uses") < 3) & ~((F.col("total") >= 4) & (F.col("uses") * 2 > F.col("total")))
    return i.join(uses, "image").join(F.broadcast(total)).select("product_id", F.when(ok, F.col("image")).alias("image"))


@query(f"WITH {OFFERS}, {PRODUCTS} SELECT kind, count(DISTINCT product_id) AS rows_, count(*) AS offers_, count(DISTINCT shop_id) AS shops_ FROM v_products JOIN v_offers USING (product_id) GROUP BY 1")
def counts(spark, sf_dir):
    j = products(spark, sf_dir).join(offers(spark, sf_dir), "product_id")
    return j.groupBy("kind").agg(F.countDistinct("product_id").alias("rows_"), F.count(F.lit(1)).alias("offers_"), F.countDistinct("shop_id").alias("shops_"))


@query(f"WITH {OFFERS} SELECT product_id, count(DISTINCT shop_id) AS stores FROM v_offers GROUP BY 1")
def distinct_stores(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("product_id").agg(F.countDistinct("shop_id").alias("stores"))


@query(f"WITH {OFFERS}, v AS (SELECT url, price, checked_at, ord, row_number() OVER (PARTITION BY url ORDER BY checked_at DESC, ord DESC) AS rank FROM v_offers) SELECT * FROM v WHERE rank <= 50")
def latest_50(spark, sf_dir):
    return O.top_n(offers(spark, sf_dir).select("url", "price", "checked_at", "ord"), ["url"], [F.desc("checked_at"), F.desc("ord")], 50)


@query(f"WITH {OFFERS}, v AS (SELECT product_id, ord, price, row_number() OVER (PARTITION BY product_id ORDER BY price, ord) AS rank FROM v_offers WHERE price > 0 AND stock <> 'out_of_stock') SELECT * FROM v WHERE rank <= 3")
def top3_offers(spark, sf_dir):
    live = offers(spark, sf_dir).where(O.is_live(F.col("price"), F.col("stock"))).select("product_id", "ord", "price")
    return O.top_n(live, ["product_id"], [F.asc("price"), F.asc("ord")], 3)


@query(f"WITH {PRODUCTS}, b AS (SELECT polymer, brand, min(list_price) AS low FROM v_products GROUP BY 1, 2) SELECT *, low = min(low) OVER (PARTITION BY polymer) AS cheapest FROM b")
def cheapest_brand(spark, sf_dir):
    b = products(spark, sf_dir).groupBy("polymer", "brand").agg(F.min("list_price").alias("low"))
    return b.withColumn("cheapest", F.col("low") == F.min("low").over(Window.partitionBy("polymer")))


@query(f"""WITH {OFFERS}, b AS (SELECT product_id, ord, (stock = 'out_of_stock')::int AS bad FROM v_offers), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY product_id ORDER BY ord) AS island FROM b)
 SELECT product_id, max(run) AS longest FROM (SELECT product_id, island, sum(bad)::bigint AS run FROM g GROUP BY 1, 2) GROUP BY 1""")
def streaks(spark, sf_dir):
    w = Window.partitionBy("product_id").orderBy("ord")
    b = offers(spark, sf_dir).select("product_id", "ord", (F.col("stock") == "out_of_stock").cast("long").alias("bad")).withColumn("island", F.sum(1 - F.col("bad")).over(w))
    return b.groupBy("product_id", "island").agg(F.sum("bad").alias("run")).groupBy("product_id").agg(F.max("run").alias("longest"))


@query(f"""WITH {OFFERS_WITH_SHOP}, t AS (SELECT product_id, ord, CASE currency WHEN 'TRY' THEN price WHEN 'USD' THEN floor(price * 41.0 * 100 + 0.5) / 100 WHEN 'EUR' THEN floor(price * 48.0 * 100 + 0.5) / 100 WHEN 'GBP' THEN floor(price * 55.0 * 100 + 0.5) / 100 END AS price_try FROM v_full)
 SELECT *, floor(price_try / 41.0 * 100 + 0.5) / 100 AS price_usd, row_number() OVER (PARTITION BY product_id ORDER BY price_try, ord) AS rank FROM t WHERE price_try IS NOT NULL""")
def price_rank(spark, sf_dir):
    t = offers_with_shop(spark, sf_dir).select("product_id", "ord", O.to_try(F.col("price"), F.col("currency")).alias("price_try")).where("price_try is not null")
    return t.withColumn("price_usd", cents(F.col("price_try") / 41.0)).withColumn("rank", F.row_number().over(Window.partitionBy("product_id").orderBy("price_try", "ord")).cast("long"))


@query(f"WITH {OFFERS} SELECT url, ord, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(checked_at)) / 3600000.0 AS age FROM v_offers ORDER BY checked_at, url, ord LIMIT 40")
def stale_queue(spark, sf_dir):
    age = (F.unix_millis(F.to_timestamp(F.lit(NOW))) - F.unix_millis(F.col("checked_at").cast("timestamp"))) / 3600000.0
    return offers(spark, sf_dir).orderBy("checked_at", "url", "ord").limit(40).select("url", "ord", age.alias("age"))


@query(f"WITH {OFFERS} SELECT count(*) AS n, count(*) FILTER (checked_at < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR) AS stale, count(*) FILTER (stock = 'out_of_stock') AS dead, count(*) FILTER (stock = 'unknown') AS unknown_ FROM v_offers")
def stock_ageing(spark, sf_dir):
    old = F.col("checked_at").cast("timestamp") < F.to_timestamp(F.lit(NOW)) - F.expr("interval 6 hours")
    return offers(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(old).alias("stale"), F.count_if(F.col("stock") == "out_of_stock").alias("dead"), F.count_if(F.col("stock") == "unknown").alias("unknown_"))


@query(f"WITH {PRODUCTS} SELECT brand, product_id FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY product_id) AS rn FROM v_products) WHERE rn % 5 = 1")
def stride_sample(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("brand").orderBy("product_id"))
    return products(spark, sf_dir).withColumn("rn", rn).where("rn % 5 = 1").select("brand", "product_id")


@query(f"WITH {OFFERS} SELECT url, ord, price FROM v_offers QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord DESC) = 1")
def offer_union_last(spark, sf_dir):
    o = offers(spark, sf_dir)
    both = o.where("ord % 2 = 0").unionByName(o.where("ord % 2 = 1"))
    return O.keep_one(both, ["url"], [F.desc("ord")]).select("url", "ord", "price")


@query(f"""WITH {OFFERS} SELECT a.url, a.owner, a.rows_ - 1 AS stripped FROM (SELECT url, arg_min(product_id, ord) AS owner, count(*) AS rows_ FROM v_offers GROUP BY 1) a WHERE rows_ > 1""")
def strip_url(spark, sf_dir):
    a = offers(spark, sf_dir).groupBy("url").agg(F.min_by("product_id", "ord").alias("owner"), F.count(F.lit(1)).alias("rows_"))
    return a.where("rows_ > 1").select("url", "owner", (F.col("rows_") - 1).alias("stripped"))


@query("""WITH e AS (SELECT event_id, 'https://shop' || (event_id % 7 + 1) || '.example/p/' || (event_id % 200 + 1) AS url FROM events), u AS (SELECT DISTINCT 'https://shop' || l_suppkey || '.example/p/' || l_partkey AS url, l_partkey AS product_id FROM lineitem)
 SELECT event_id, product_id FROM e LEFT JOIN u USING (url)""")
def url_join(spark, sf_dir):
    """The product that owns the address of each event, if any."""
    text = lambda c: c.cast("string")
    url = F.concat(F.lit("https://shop"), text(F.col("event_id") % 7 + 1), F.lit(".example/p/"), text(F.col("event_id") % 200 + 1))
    owner = offers(spark, sf_dir).select("url", "product_id").distinct()
    return table(spark, sf_dir, "events").select("event_id", url.alias("url")).join(owner, "url", "left").select("event_id", "product_id")


_UPD = "u AS (SELECT url, arg_max(stock, struct_pack(c := checked_at, o := ord)) AS new_stock FROM v_offers WHERE ord % 3 = 0 GROUP BY 1)"


@query(f"WITH {OFFERS}, {_UPD} SELECT url, ord, coalesce(new_stock, stock) AS stock FROM v_offers LEFT JOIN u USING (url)")
def stock_apply(spark, sf_dir):
    o = offers(spark, sf_dir)
    new = o.where("ord % 3 = 0").groupBy("url").agg(F.max_by("stock", F.struct("checked_at", "ord")).alias("new_stock"))
    return o.join(new, "url", "left").select("url", "ord", F.coalesce("new_stock", "stock").alias("stock"))


@query(f"WITH {PRODUCTS} SELECT product_id, coalesce(r_name, kind) AS aisle FROM v_products LEFT JOIN region ON variant = r_regionkey")
def dim_override(spark, sf_dir):
    return products(spark, sf_dir).join(table(spark, sf_dir, "region"), F.col("variant") == F.col("r_regionkey"), "left").select("product_id", F.coalesce("r_name", "kind").alias("aisle"))


@query(f"WITH {PRODUCTS} SELECT p.product_id, i.images FROM v_products p LEFT JOIN (SELECT brand, polymer, color, list_sort(list(DISTINCT name)) AS images FROM v_products GROUP BY 1, 2, 3) i USING (brand, polymer, color)")
def fallback_images(spark, sf_dir):
    p = products(spark, sf_dir)
    i = p.groupBy("brand", "polymer", "color").agg(F.sort_array(F.collect_set("name")).alias("images"))
    return p.join(i, ["brand", "polymer", "color"], "left").select("product_id", "images")


@query(f"WITH {PRODUCTS}, t AS (SELECT brand, polymer, color FROM v_products GROUP BY ALL HAVING count(*) > 1) SELECT product_id FROM v_products SEMI JOIN t USING (brand, polymer, color)")
def twin_semi(spark, sf_dir):
    p = products(spark, sf_dir)
    t = p.groupBy("brand", "polymer", "color").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return p.join(t, ["brand", "polymer", "color"], "left_semi").select("product_id")


@query(f"WITH {OFFERS}, {PRODUCTS} SELECT product_id, name FROM v_products p WHERE NOT EXISTS (SELECT 1 FROM v_offers o WHERE o.product_id = p.product_id AND stock = 'in_stock')")
def not_on_board_anti(spark, sf_dir):
    return products(spark, sf_dir).join(offers(spark, sf_dir).where("stock = 'in_stock'"), "product_id", "left_anti").select("product_id", "name")


@query(f"WITH {OFFERS} SELECT product_id, ord FROM v_offers ANTI JOIN (SELECT DISTINCT url FROM v_offers WHERE stock = 'out_of_stock') USING (url)")
def drop_urls_anti(spark, sf_dir):
    o = offers(spark, sf_dir)
    return o.join(o.where("stock = 'out_of_stock'").select("url"), "url", "left_anti").select("product_id", "ord")


@query(f"WITH {OFFERS_WITH_SHOP} SELECT product_id, ord FROM v_full WHERE lower(store) = 'supplier#000000005' OR split_part(url, '/', 3) IN ('shop9.example', 'shop11.example')")
def shop_offers_semi(spark, sf_dir):
    host = F.split("url", "/")[2]
    return offers_with_shop(spark, sf_dir).where((F.lower("store") == "supplier#000000005") | host.isin("shop9.example", "shop11.example")).select("product_id", "ord")


@query(f"WITH {PRODUCTS} SELECT a.product_id AS a, b.product_id AS b FROM v_products a JOIN v_products b ON a.kind = b.kind AND a.brand = b.brand AND a.polymer = b.polymer AND a.color = b.color AND a.variant = b.variant AND a.product_id < b.product_id")
def dup_pairs_theta(spark, sf_dir):
    p = products(spark, sf_dir).select("product_id", "kind", "brand", "polymer", "color", "variant")
    a, b = p.withColumnRenamed("product_id", "a"), p.withColumnRenamed("product_id", "b")
    return a.join(b, ["kind", "brand", "polymer", "color", "variant"]).where("a < b").select("a", "b")


@query(f"WITH {PRODUCTS}, s AS (SELECT p_partkey AS product_id, p_size / 50.0 AS score FROM part WHERE p_size > 25) SELECT product_id, coalesce(score, 0) AS score FROM v_products LEFT JOIN s USING (product_id)")
def score_left(spark, sf_dir):
    s = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("product_id"), (F.col("p_size") / 50.0).alias("score"))
    return products(spark, sf_dir).join(s, "product_id", "left").select("product_id", F.coalesce("score", F.lit(0.0)).alias("score"))


@query(f"WITH {PRODUCTS} SELECT coalesce(nullif(CASE WHEN variant < 5 THEN '' ELSE polymer END, ''), 'other') AS g, count(*) AS n FROM v_products GROUP BY 1")
def group_other(spark, sf_dir):
    g = F.when(F.col("variant") < 5, "").otherwise(F.col("polymer"))
    return products(spark, sf_dir).groupBy(F.coalesce(F.nullif(g, F.lit("")), F.lit("other")).alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PRODUCTS} SELECT product_id, concat_ws(' · ', kind, polymer, brand) AS axes FROM v_products")
def axis_labels(spark, sf_dir):
    return products(spark, sf_dir).select("product_id", F.concat_ws(" · ", "kind", "polymer", "brand").alias("axes"))


@query(f"WITH {OFFERS}, a AS (SELECT product_id, price, ord, min(price) OVER (PARTITION BY product_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM v_offers) SELECT * FROM a")
def running_best(spark, sf_dir):
    w = Window.partitionBy("product_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return offers(spark, sf_dir).select("product_id", "price", "ord").withColumn("best_before", F.min("price").over(w))


@query(f"WITH {OFFERS} SELECT product_id, list_transform(list_sort(list({{'p': price, 'o': ord}})), lambda x: x.p) AS prices FROM v_offers GROUP BY 1")
def offers_sorted(spark, sf_dir):
    s = F.sort_array(F.collect_list(F.struct("price", "ord")))
    return offers(spark, sf_dir).groupBy("product_id").agg(F.transform(s, lambda x: x["price"]).alias("prices"))


@query(f"WITH {OFFERS}, {PRODUCTS} SELECT brand, count(*) FILTER (stock = 'in_stock') AS in_stock, count(*) FILTER (stock = 'out_of_stock') AS out_of_stock, count(*) FILTER (stock = 'unknown') AS unknown FROM v_offers JOIN v_products USING (product_id) GROUP BY 1")
def run_summary(spark, sf_dir):
    j = offers(spark, sf_dir).join(products(spark, sf_dir), "product_id")
    return j.groupBy("brand").pivot("stock", ["in_stock", "out_of_stock", "unknown"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"""WITH {OFFERS}, o AS (SELECT url, product_id, price, checked_at, ord FROM v_offers), q AS (SELECT url, ord, checked_at FROM o WHERE ord % 5 = 0)
 SELECT q.url, q.ord, (SELECT arg_max(o.price, struct_pack(c := o.checked_at, r := o.ord)) FROM o WHERE o.url = q.url AND o.checked_at < q.checked_at) AS price_before FROM q""")
def asof_price(spark, sf_dir):
    """As-of join without pairs: the last price of the url strictly before each probe."""
    o = offers(spark, sf_dir).select("url", "ord", "price", "checked_at")
    steps = o.groupBy("url", "checked_at").agg(F.max_by("price", "ord").alias("last"), F.collect_list(F.when(F.col("ord") % 5 == 0, F.col("ord"))).alias("probes"))
    before = F.lag("last").over(Window.partitionBy("url").orderBy("checked_at"))
    return steps.withColumn("price_before", before).select("url", F.explode("probes").alias("ord"), "price_before")
