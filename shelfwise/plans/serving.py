"""Queries of the serving side: boards, review, shops, pages, job events and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators import clusters
from shelfwise.operators import offers as O
from shelfwise.plans.base import collection
from shelfwise.sources import markup as H
from shelfwise.sources import pages as G
from shelfwise.sources.views import OFFERS, OFFERS_WITH_SHOP, PRODUCTS, SHOPS, offers, products, shops, table
from shelfwise.streaming import jobs as Q
from shelfwise.streaming.events import latest

QUERIES, ORACLES, query = collection()

#: Job events as the rows of events: one job for each user, a card for each of a few keys.
EVENTS = """v_events AS (SELECT event_id AS ord, user_id AS job_id, event_type AS type, ts AS seen, value AS price,
  'https://shop' || (event_id % 7) || '.example/p/' || (event_id % 40) AS url FROM events)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    url = F.concat(F.lit("https://shop"), (F.col("event_id") % 7).cast("string"), F.lit(".example/p/"), (F.col("event_id") % 40).cast("string"))
    return e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("job_id"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("price"), url.alias("url"))


@query(f"WITH {EVENTS} SELECT job_id, url, arg_max(price, ord) FILTER (price IS NOT NULL) AS price, arg_max(type, ord) FILTER (type IS NOT NULL) AS type, count(*) AS n FROM v_events GROUP BY 1, 2")
def cards_fold(spark, sf_dir):
    """The latest non-null fields of each card: a fold that needs no order of arrival."""
    return job_events(spark, sf_dir).groupBy("job_id", "url").agg(latest("price", "ord").alias("price"), latest("type", "ord").alias("type"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS}, l AS (SELECT job_id, max(seen) AS last, count(*) AS n, arg_max(type, ord) AS type FROM v_events GROUP BY 1), c AS (SELECT max(seen) AS now FROM v_events)
 SELECT job_id, n, CASE WHEN type = 'purchase' THEN 'complete' WHEN epoch_ms(now) - epoch_ms(last) > 180000 THEN 'queued' ELSE 'running' END AS status FROM l, c""")
def job_states(spark, sf_dir):
    e = job_events(spark, sf_dir)
    now = e.agg(F.max("at").alias("now"))  # one row
    last = e.groupBy("job_id").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n"), F.max_by("type", "ord").alias("type"))
    idle = F.unix_millis("now") - F.unix_millis("last")
    return last.join(F.broadcast(now)).select("job_id", "n", F.when(F.col("type") == "purchase", "complete").when(idle > 180000, "queued").otherwise("running").alias("status"))


@query(f"""WITH {EVENTS}, d AS (SELECT job_id, min(ord) AS done FROM v_events WHERE type = 'purchase' GROUP BY 1)
 SELECT e.job_id, count(*) AS accepted FROM v_events e LEFT JOIN d USING (job_id) WHERE done IS NULL OR ord <= done GROUP BY 1""")
def stale_guard(spark, sf_dir):
    """Events of a job after its end are ignored."""
    w = Window.partitionBy("job_id")
    e = job_events(spark, sf_dir).withColumn("done", F.min(F.when(F.col("type") == "purchase", F.col("ord"))).over(w))
    return e.where("done is null or ord <= done").groupBy("job_id").agg(F.count(F.lit(1)).alias("accepted"))


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a worker's queues: eight queues, a job for each user, what happens by the number of the event."""
    e, n = job_events(spark, sf_dir), F.col("ord") % 12
    kind = F.when(n == 0, "submit").when(n.isin(1, 7), "poll").when(n == 10, F.when(F.col("job_id") % 3 == 0, "fail").otherwise("complete")).when((n == 11) & (F.col("job_id") % 7 == 0), "abort").otherwise("progress")
    job = F.when(kind != "poll", F.col("job_id"))
    return e.select(
        F.concat(F.lit("q"), (F.col("job_id") % 8).cast("string")).alias("queue"), "ord", "at", kind.alias("kind"), job.alias("job_id"), F.when(kind == "progress", F.col("url")).alias("url"),
        F.when(F.col("ord") % 2 == 0, F.concat(F.lit("n"), F.col("ord").cast("string"))).alias("name"), F.lit(None).cast("string").alias("image"), "price", F.lit(None).cast("string").alias("error"),
    )


@query(None)
def queue_jobs(spark, sf_dir):
    """Status, events and cards of every job of the queues, one job at a time in each, folded with state."""
    return Q.latest_status(Q.queue_changes(queue_events(spark, sf_dir)))


@query(None)
def queue_cards(spark, sf_dir):
    """Every card of the queues' jobs as it stands at the end."""
    return Q.queue_cards(queue_events(spark, sf_dir)).select("queue", "job_id", "url", "name", "image", "price")


@query(f"WITH {EVENTS} SELECT job_id, ord, type FROM v_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ord DESC) <= 20")
def event_tail(spark, sf_dir):
    return O.top_n(job_events(spark, sf_dir), ["job_id"], [F.desc("ord")], 20).select("job_id", "ord", "type")


@query(f"WITH {EVENTS} SELECT job_id, (epoch_us(max(seen)) - epoch_us(min(seen)))::bigint AS us, count(*) AS n FROM v_events GROUP BY 1")
def batch_duration(spark, sf_dir):
    return job_events(spark, sf_dir).groupBy("job_id").agg((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))).alias("us"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS} SELECT job_id, max(seen) AS last FROM v_events GROUP BY 1 ORDER BY last DESC, job_id LIMIT 25")
def jobs_newest(spark, sf_dir):
    j = job_events(spark, sf_dir).groupBy("job_id").agg(F.max("at").alias("last")).orderBy(F.desc("last"), "job_id").limit(25)
    return j.select("job_id", F.col("last").cast("timestamp_ntz").alias("last"))


_RANK = "CASE type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END"


@query(f"WITH {EVENTS} SELECT url, arg_max(type, struct_pack(r := {_RANK}, o := ord)) AS decision FROM v_events GROUP BY 1")
def decision_fold(spark, sf_dir):
    rank = F.when(F.col("type") == "purchase", 2).when(F.col("type") == "click", 1).otherwise(0)
    return job_events(spark, sf_dir).groupBy("url").agg(F.max_by("type", F.struct(rank, "ord")).alias("decision"))


@query(f"WITH {EVENTS} SELECT url, arg_min(ord, struct_pack(q := -((price > 50)::int * 8 + {_RANK} * 2), o := ord)) AS best FROM v_events GROUP BY 1")
def best_card(spark, sf_dir):
    quality = (F.col("price") > 50).cast("int") * 8 + F.when(F.col("type") == "purchase", 2).when(F.col("type") == "click", 1).otherwise(0) * 2
    return job_events(spark, sf_dir).groupBy("url").agg(F.min_by("ord", F.struct(-quality, "ord")).alias("best"))


@query(f"WITH {EVENTS}, u AS (SELECT url, arg_min(price, ord) AS price FROM v_events WHERE price > 0 GROUP BY 1) SELECT url, price FROM u")
def recover_price(spark, sf_dir):
    return job_events(spark, sf_dir).where("price > 0").groupBy("url").agg(F.min_by("price", "ord").alias("price"))


@query(f"WITH {EVENTS} SELECT DISTINCT job_id, url FROM v_events WHERE url LIKE 'http%'")
def job_urls(spark, sf_dir):
    return job_events(spark, sf_dir).where(F.col("url").startswith("http")).select("job_id", "url").distinct()


@query(f"WITH {EVENTS}, {SHOPS} SELECT job_id, shop_id, count(*) AS n FROM v_events JOIN v_shops ON split_part(url, '/', 3) = 'shop' || shop_id || '.example' GROUP BY 1, 2")
def shop_of_url(spark, sf_dir):
    host = F.split("url", "/")[2]
    s = shops(spark, sf_dir).select("shop_id", F.concat(F.lit("shop"), F.col("shop_id").cast("string"), F.lit(".example")).alias("host"))
    return job_events(spark, sf_dir).withColumn("host", host).join(s, "host").groupBy("job_id", "shop_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1")
def sliding_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, (epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 1800000)::int AS gap, event_id FROM events),
 s AS (SELECT user_id, ts, sum(coalesce(gap, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"WITH {OFFERS} SELECT product_id, count(*) AS others FROM v_offers WHERE split_part(url, '/', 3) <> 'shop3.example' GROUP BY 1")
def other_shops(spark, sf_dir):
    return offers(spark, sf_dir).where(F.split("url", "/")[2] != "shop3.example").groupBy("product_id").agg(F.count(F.lit(1)).alias("others"))


@query(f"WITH {PRODUCTS} SELECT product_id, name FROM v_products WHERE kind = 'printer' ORDER BY (product_id <> 42), product_id LIMIT 25")
def pinned_topn(spark, sf_dir):
    return products(spark, sf_dir).where("kind = 'printer'").orderBy(F.col("product_id") != 42, "product_id").limit(25).select("product_id", "name")


@query(f"WITH {PRODUCTS} SELECT product_id, replace(replace(replace(replace(replace(name, 'small gear', 'küçük dişli'), 'gear', 'dişli'), 'widget', 'parça'), 'ring', 'halka'), 'small', 'küçük') AS name FROM v_products")
def translate_names(spark, sf_dir):
    """Phrases replaced in order, the longest first."""
    name = F.col("name")
    for phrase, to in (("small gear", "küçük dişli"), ("gear", "dişli"), ("widget", "parça"), ("ring", "halka"), ("small", "küçük")):
        name = F.replace(name, F.lit(phrase), F.lit(to))
    return products(spark, sf_dir).select("product_id", name.alias("name"))


@query(f"WITH {PRODUCTS}, c AS (SELECT 'printers' AS id, 0 AS p UNION ALL SELECT 'filament', 0 UNION ALL SELECT polymer, 1 FROM v_products) SELECT id, min(p) AS p FROM c GROUP BY 1")
def board_categories(spark, sf_dir):
    """Default categories first, then those that items imply."""
    base = spark.createDataFrame([("printers", 0), ("filament", 0)], "id string, p int")
    return base.unionByName(products(spark, sf_dir).select(F.col("polymer").alias("id"), F.lit(1).alias("p"))).groupBy("id").agg(F.min("p").alias("p"))


@query(f"WITH {PRODUCTS}, p AS (SELECT p_partkey AS product_id, 'patched' AS new_name FROM part WHERE p_partkey % 50 = 0) SELECT product_id, coalesce(new_name, name) AS name FROM v_products LEFT JOIN p USING (product_id)")
def patch_products(spark, sf_dir):
    patch = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("product_id"), F.lit("patched").alias("new_name"))
    return products(spark, sf_dir).join(patch, "product_id", "left").select("product_id", F.coalesce("new_name", "name").alias("name"))


@query(f"WITH {PRODUCTS} SELECT lower(color) AS k, min(color) AS name, count(*) AS n FROM v_products GROUP BY 1")
def category_names(spark, sf_dir):
    return products(spark, sf_dir).groupBy(F.lower("color").alias("k")).agg(F.min("color").alias("name"), F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CASE WHEN url NOT LIKE 'https://%' THEN 'scheme' WHEN split_part(url, '/', 3) = '' THEN 'host' WHEN length(split_part(url, '/', 4)) = 0 THEN 'path' ELSE 'ok' END AS reason FROM pages")
def run_row_reason(spark, sf_dir):
    part = lambda i: F.coalesce(F.get(F.split("url", "/"), F.lit(i)), F.lit(""))
    reason = F.when(~F.col("url").startswith("https://"), "scheme").when(part(2) == "", "host").when(part(3) == "", "path").otherwise("ok")
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"))


@query(f"WITH {PRODUCTS} SELECT product_id, name FROM v_products WHERE contains(lower(name || ' ' || brand || ' ' || color), 'gear') ORDER BY product_id LIMIT 12")
def pin_search(spark, sf_dir):
    hay = F.lower(F.concat_ws(" ", "name", "brand", "color"))
    return products(spark, sf_dir).where(F.contains(hay, F.lit("gear"))).orderBy("product_id").limit(12).select("product_id", "name")


@query(f"WITH {OFFERS}, s AS (SELECT * FROM v_offers ORDER BY product_id, ord LIMIT 100) SELECT product_id, ord FROM s WHERE stock IN ('in_stock', 'out_of_stock')")
def stock_update_valid(spark, sf_dir):
    """The first hundred updates are taken, and only then filtered."""
    return offers(spark, sf_dir).orderBy("product_id", "ord").limit(100).where(F.col("stock").isin("in_stock", "out_of_stock")).select("product_id", "ord")


@query(f"WITH {OFFERS} SELECT product_id, ord, NOT EXISTS (SELECT 1 FROM v_offers k WHERE k.url = o.url AND k.stock = 'in_stock') AS fresh FROM v_offers o WHERE stock = 'unknown'")
def candidate_mark(spark, sf_dir):
    o = offers(spark, sf_dir)
    known = o.where("stock = 'in_stock'").select("url").distinct().withColumn("known", F.lit(True))
    return o.where("stock = 'unknown'").join(known, "url", "left").select("product_id", "ord", F.col("known").isNull().alias("fresh"))


@query(f"WITH {PRODUCTS} SELECT DISTINCT color FROM v_products WHERE brand = 'Brand#11' AND color NOT IN (SELECT color FROM v_products WHERE brand = 'Brand#12' AND color IS NOT NULL)")
def category_anti(spark, sf_dir):
    p = products(spark, sf_dir)
    return p.where("brand = 'Brand#11'").join(p.where("brand = 'Brand#12'"), "color", "left_anti").select("color").distinct()


@query(f"""WITH {OFFERS}, p AS (SELECT shop_id, ord // 10 AS page, avg((stock = 'out_of_stock')::int) >= 0.5 AS bad FROM v_offers GROUP BY 1, 2),
 i AS (SELECT *, sum((NOT bad)::int) OVER (PARTITION BY shop_id ORDER BY page) AS island FROM p), r AS (SELECT shop_id, page, bad, sum(bad::int) OVER (PARTITION BY shop_id, island ORDER BY page) AS run FROM i)
 SELECT shop_id, min(page) FILTER (run >= 2) AS stop FROM r GROUP BY 1""")
def oos_pages(spark, sf_dir):
    """The page at which a crawl of a shop stops: the second bad page in a row."""
    page = F.floor(F.col("ord") / 10)
    p = offers(spark, sf_dir).groupBy("shop_id", page.alias("page")).agg((F.avg((F.col("stock") == "out_of_stock").cast("int")) >= 0.5).alias("bad"))
    i = p.withColumn("island", F.sum((~F.col("bad")).cast("int")).over(Window.partitionBy("shop_id").orderBy("page")))
    r = i.withColumn("run", F.sum(F.col("bad").cast("int")).over(Window.partitionBy("shop_id", "island").orderBy("page")))
    return r.groupBy("shop_id").agg(F.min(F.when(F.col("run") >= 2, F.col("page"))).alias("stop"))


@query(f"WITH {PRODUCTS} SELECT brand, list_sort(list(DISTINCT color))[1:5] AS colors FROM v_products GROUP BY 1")
def unique_colors(spark, sf_dir):
    return products(spark, sf_dir).groupBy("brand").agg(F.slice(F.sort_array(F.collect_set("color")), 1, 5).alias("colors"))


@query(f"WITH {OFFERS}, r AS (SELECT product_id, ord, row_number() OVER (PARTITION BY product_id ORDER BY price, ord) AS rn, count(*) OVER (PARTITION BY product_id) AS n FROM v_offers) SELECT product_id, ord, rn = 1 AS best, 1.0 / n AS share FROM r")
def best_tag(spark, sf_dir):
    w = Window.partitionBy("product_id")
    r = offers(spark, sf_dir).select("product_id", "ord", F.row_number().over(w.orderBy("price", "ord")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    return r.select("product_id", "ord", (F.col("rn") == 1).alias("best"), (F.lit(1.0) / F.col("n")).cast("double").alias("share"))


@query(f"WITH {PRODUCTS} SELECT brand, polymer, max(variant) AS rel, min(list_price) AS low FROM v_products GROUP BY 1, 2 ORDER BY rel DESC, low, brand, polymer LIMIT 20")
def group_rank(spark, sf_dir):
    g = products(spark, sf_dir).groupBy("brand", "polymer").agg(F.max("variant").alias("rel"), F.min("list_price").alias("low"))
    return g.orderBy(F.desc("rel"), "low", "brand", "polymer").limit(20)


@query(f"WITH {PRODUCTS} SELECT CASE WHEN kind = 'filament' AND color = 'old' THEN 'printer' ELSE kind END AS shelf, count(*) AS n FROM v_products GROUP BY 1")
def shelf_move(spark, sf_dir):
    shelf = F.when((F.col("kind") == "filament") & (F.col("color") == "old"), "printer").otherwise(F.col("kind"))
    return products(spark, sf_dir).groupBy(shelf.alias("shelf")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OFFERS}, {PRODUCTS}, o AS (SELECT * FROM v_offers WHERE NOT (product_id % 10 = 1 AND ord <= 3)) SELECT product_id, (SELECT count(*) FROM o WHERE o.product_id = p.product_id) AS n FROM v_products p WHERE EXISTS (SELECT 1 FROM o WHERE o.product_id = p.product_id)")
def delete_rows(spark, sf_dir):
    left = offers(spark, sf_dir).where(~((F.col("product_id") % 10 == 1) & (F.col("ord") <= 3))).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return products(spark, sf_dir).join(left, "product_id").select("product_id", "n")


@query(f"""WITH {PRODUCTS}, t AS (SELECT product_id, string_split(lower(name), ' ') AS w FROM v_products) SELECT a.product_id, len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) + len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) AS d
 FROM t a JOIN t b ON b.product_id = a.product_id + 1""")
def token_set_diff(spark, sf_dir):
    t = products(spark, sf_dir).select("product_id", F.split(F.lower("name"), " ").alias("w"))
    n = t.select((F.col("product_id") - 1).alias("product_id"), F.col("w").alias("v"))
    gone = lambda a, b: F.size(F.filter(a, lambda x: ~F.array_contains(F.col(b), x)))
    return t.join(n, "product_id").select("product_id", (gone("w", "v") + gone("v", "w")).cast("long").alias("d"))


@query(f"WITH {PRODUCTS}, p AS (SELECT product_id, name, product_id % 2 AS half FROM v_products) SELECT product_id, name FROM p WHERE half = 0 UNION ALL SELECT product_id, name FROM p WHERE half = 1")
def source_union(spark, sf_dir):
    p = products(spark, sf_dir).select("product_id", "name")
    return p.where("product_id % 2 = 0").unionByName(p.where("product_id % 2 = 1"), allowMissingColumns=True)


@query(f"""WITH {PRODUCTS}, o(polymer, pos) AS (VALUES ('standard', 1), ('economy', 2), ('promo', 3)) SELECT p.polymer, coalesce(min(pos), 1000) AS pos, count(*) AS n FROM v_products p LEFT JOIN o ON o.polymer = p.polymer GROUP BY 1""")
def facet_order(spark, sf_dir):
    order = spark.createDataFrame([("standard", 1), ("economy", 2), ("promo", 3)], "polymer string, pos int")
    f = products(spark, sf_dir).groupBy("polymer").agg(F.count(F.lit(1)).alias("n"))
    return f.join(order, "polymer", "left").select("polymer", F.coalesce("pos", F.lit(1000)).alias("pos"), "n")


@query(f"""WITH RECURSIVE {PRODUCTS}, e AS (SELECT a.product_id AS x, b.product_id AS y FROM v_products a JOIN v_products b ON a.name = b.name OR (a.brand = b.brand AND a.color = b.color AND a.polymer = b.polymer AND a.variant = b.variant)),
 r AS (SELECT product_id AS x, product_id AS y FROM v_products UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
 SELECT x AS product_id, min(y) AS cluster FROM r GROUP BY 1""")
def dup_clusters(spark, sf_dir):
    """Products joined by equal names or equal identity, transitively."""
    p = products(spark, sf_dir)
    stars = [clusters.star_edges(p, "product_id", keys) for keys in (["name"], ["brand", "color", "polymer", "variant"])]
    return clusters.connected(p.select(F.col("product_id").alias("node")), stars[0].unionByName(stars[1])).select(F.col("node").alias("product_id"), F.col("cluster"))


@query(None)
def leader_clusters(spark, sf_dir):
    """Titles of one brand and kind grouped by likeness to the earliest title of each group."""
    p = products(spark, sf_dir).select("product_id", "name", "brand", "kind", "polymer")
    return clusters.lead(p, ["brand", "kind", "polymer"], "product_id", "name", 0.75)


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>\\s*(.*?)\\s*</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\\b')) AS links, len(regexp_extract_all(html, '(?i)<img\\b')) AS images FROM pages")
def page_parts(spark, sf_dir):
    return G.parts(table(spark, sf_dir, "pages"))


@query(None)
def link_shapes(spark, sf_dir):
    """Shapes of link paths that stand for three different links of a page or more."""
    return G.link_shapes(table(spark, sf_dir, "pages"))


@query(None)
def product_page(spark, sf_dir):
    """Name, brand, kind, image, price with its source, tax and stock with its evidence that each page offers."""
    return H.read_product_page(table(spark, sf_dir, "pages"))
