"""Queries on landed HTML and JSON of shops.

The table of pages holds prose, so list and product pages are written from the catalogue, one
way of markup for each few products; what is read back from them must be the catalogue again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import identity as I
from shelfwise.functions.stock import checked_page, stock_of_html
from shelfwise.operators import offers as O
from shelfwise.plans.base import collection
from shelfwise.sources import cards as C
from shelfwise.sources import markup as H
from shelfwise.sources import pages as G
from shelfwise.sources import paging
from shelfwise.sources import walks as K
from shelfwise.sources.views import OFFERS, PRODUCTS, offers, products, spread, table

QUERIES, ORACLES, query = collection()

#: Cards of a list page, and cards that a task reads, about: their rows are few bytes, but reading them is slow.
PAGE_CARDS, TASK_CARDS = 20, 100_000


def _text(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def money(c) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, page and html: each product's offers as cards, marked by a class or, for odd products, by nothing."""
    j = offers(spark, sf_dir, TASK_CARDS).join(products(spark, sf_dir).select("product_id", "name"), "product_id")
    odd = F.col("product_id") % 2 == 1
    url = F.when(odd, F.concat(F.lit("https://shop"), _text("shop_id"), F.lit(".example/p/item-"), _text(F.col("ord") + 100000))).otherwise(F.concat("url", F.lit("/"), _text("ord")))
    buttons = F.when(F.col("stock") == "in_stock", "<button>Sepete Ekle</button>").when(F.col("stock") == "out_of_stock", "<em>Tükendi</em>").otherwise("<button disabled>Sepete Ekle</button>")
    inside = F.concat(
        F.lit('<a href="'), url, F.lit('"><img src="/img/logo.png" data-src="https://img.example/'), _text("shop_id"), F.lit('.jpg"></a><h3>'), "name", F.lit("</h3><del>"), money("was"), F.lit(' TL</del><span class="price">'), money("price"), F.lit(" TL</span>"), buttons,
    )
    card = F.when(odd, F.concat(F.lit("<li>"), inside, F.lit("</li>"))).otherwise(F.concat(F.lit('<div class="grid product-item">'), inside, F.lit("</div>")))
    cards = j.select("product_id", F.floor((F.col("ord") - 1) / PAGE_CARDS).alias("page"), "ord", card.alias("card"))
    # a page has PAGE_CARDS cards at most
    made = cards.groupBy("product_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "card"))).alias("c"))
    head, tail = '<html><body><nav><ul><li><a href="/about">About</a></li><li><a href="/sepet">Sepet 10 TL</a></li></ul></nav><ul>', "</ul><footer>x</footer></body></html>"
    return made.select("product_id", "page", F.concat(F.lit(head), F.array_join(F.transform("c", lambda x: x["card"]), ""), F.lit(tail)).alias("html"))


_CARDS = f"""{OFFERS}, {PRODUCTS}, v_src AS (SELECT o.product_id, (ord - 1) // {PAGE_CARDS} AS page, ord, price, stock, shop_id, name, CASE WHEN o.product_id % 2 = 1 THEN 'https://shop' || shop_id || '.example/p/item-' || (ord + 100000) ELSE url || '/' || ord END AS link FROM v_offers o JOIN v_products USING (product_id)),
 v_card AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY product_id, page) AS n_cards, bool_or(stock = 'in_stock') OVER (PARTITION BY product_id, page) AS with_cart FROM v_src WINDOW w AS (PARTITION BY product_id, page ORDER BY ord) QUALIFY product_id % 2 = 0 OR count(*) OVER (PARTITION BY product_id, page) >= 3),
 v_said AS (SELECT *, CASE stock WHEN 'in_stock' THEN 'add-to-cart' WHEN 'out_of_stock' THEN 'page' ELSE CASE WHEN n_cards > 1 AND NOT with_cart THEN 'product-page-required' ELSE 'no-add-to-cart' END END AS evidence FROM v_card),
 v_read AS (SELECT *, CASE evidence WHEN 'add-to-cart' THEN 'in_stock' WHEN 'product-page-required' THEN 'unknown' ELSE 'out_of_stock' END AS seen,
  CASE WHEN seen = 'unknown' THEN 'stock unknown' WHEN seen <> 'in_stock' THEN 'out of stock' WHEN price <= 0 THEN 'no price' WHEN {I.product_type_sql('name')} NOT IN ('filament', 'other') THEN 'other kind' END AS reason FROM v_said)"""


def _read(spark, sf_dir) -> DataFrame:
    return H.listing_cards(C.cards_of(list_pages(spark, sf_dir)).drop("html"), "filament", ["product_id", "page"])


@query(f"WITH {_CARDS} SELECT product_id, page, place, link AS url, name, CASE WHEN price > 0 THEN price END AS amount, seen AS stock, evidence, 'https://img.example/' || shop_id || '.jpg' AS image FROM v_read")
def html_cards(spark, sf_dir):
    """Every card of the list pages: link, name, price, stock with its evidence, picture."""
    return _read(spark, sf_dir).select("product_id", "page", F.col("place").cast("long").alias("place"), "url", "name", "amount", "stock", "evidence", "image")


@query(f"WITH {_CARDS} SELECT CASE WHEN reason IS NULL THEN 'product' WHEN reason = 'other kind' THEN 'mismatch' WHEN reason = 'stock unknown' THEN 'open' ELSE 'rejected' END AS outcome, reason, count(*) AS n FROM v_read GROUP BY 1, 2")
def harvest_split(spark, sf_dir):
    """A harvest's cards by what becomes of them."""
    return _read(spark, sf_dir).groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CARDS} SELECT link AS url, price AS amount FROM v_read WHERE reason IS NULL AND price >= 1")
def card_to_listing(spark, sf_dir):
    """Cards that may go on as listings."""
    return H.admissible(_read(spark, sf_dir)).select("url", "amount")


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id and html: the price said in one of nine ways, the stock in one of four, the picture in one of five."""
    way, p = F.col("product_id") % 9, F.col("list_price")
    price, dear = F.concat(money(p), F.lit(" TL")), lambda x: F.concat(money(F.floor(p * x * 100 + 0.5) / 100), F.lit(" TL"))
    plain = p.cast("decimal(20,2)").cast("string")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"WebSite","name":"w"},{"@type":"Product","name":"'), "name", F.lit('","image":["https://img.example/ld/'), _text("product_id"), F.lit('.jpg"],"offers":{"price":"'), plain, F.lit('","priceCurrency":"TRY"}}]}</script>'))
    said = (
        F.when(way == 0, ld).when(way == 1, F.concat(F.lit('<meta itemprop="price" content="'), plain, F.lit('"><meta itemprop="priceCurrency" content="TRY">')))
        .when(way == 2, F.concat(F.lit('<meta content="'), plain, F.lit('" property="product:price:amount">'))).when(way == 3, F.concat(F.lit('<b data-price="'), plain, F.lit('"></b>')))
        .when(way == 4, F.concat(F.lit('<form data-cart-price="'), price, F.lit('">'), dear(3), F.lit("</form>"))).when(way == 5, F.concat(dear(0.5), F.lit(" <b>"), price, F.lit("</b> (KDV Dahil)")))
        .when(way == 6, F.concat(F.lit("<p>"), money(p), F.lit(" TL + KDV</p>"))).when(way == 7, F.concat(ld, F.lit("<p>"), dear(1.2), F.lit("</p>"))).otherwise(F.concat(ld, F.lit("<p>"), dear(2), F.lit("</p>")))
    )
    s = F.col("product_id") % 4
    stock = F.when(s == 0, "<button>Sepete Ekle</button>").when(s == 1, "<p>Tükendi</p>").when(s == 2, "<p>Stok miktarı: 3</p>").otherwise("<p>Ön sipariş</p><button>Sepete Ekle</button>")
    i, id_ = F.col("product_id") % 5, _text("product_id")
    image = (
        F.when(i == 0, F.concat(F.lit('<picture><source srcset="https://img.example/s/'), id_, F.lit('.jpg 100w, https://img.example/l/'), id_, F.lit('.jpg 900w"></picture>')))
        .when(i == 1, F.concat(F.lit('<img src="/placeholder.gif" data-src="https://img.example/d/'), id_, F.lit('.jpg">'))).when(i == 2, F.concat(F.lit('<i style="background-image:url(https://img.example/b/'), id_, F.lit('.jpg)"></i>')))
        .when(i == 3, F.concat(F.lit('<meta property="og:image" content="https://img.example/m/'), id_, F.lit('.jpg">'))).otherwise('<img src="/logo.png">')
    )
    html = F.concat(F.lit("<html><head>"), said, F.lit("</head><body><h1>"), "name", F.lit("</h1>"), image, stock, F.lit("<p>"), F.repeat(F.lit("lorem "), 400), F.lit("</p></body></html>"))
    return spread(products(spark, sf_dir).select("product_id", "list_price", "name"), "product_id").select("product_id", "list_price", html.alias("html"))


@query(f"""WITH {PRODUCTS} SELECT product_id, CASE product_id % 9 WHEN 6 THEN floor(list_price * 1.2 * 100 + 0.5) / 100 WHEN 7 THEN floor(list_price * 1.2 * 100 + 0.5) / 100 ELSE list_price END AS price,
 (['json-ld', 'microdata', 'meta', 'attribute', 'cart-price', 'vat-included-price', 'page-text', 'page-text', 'json-ld'])[product_id % 9 + 1] AS method FROM v_products""")
def page_price(spark, sf_dir):
    """The price that a customer pays and where it stands, from all the evidence of a page."""
    return product_pages(spark, sf_dir).select("product_id", F.inline_outer(F.array(H.arbitrated(F.col("html"), F.lit(1.0))))).select("product_id", "price", "method")


@query(f"WITH {PRODUCTS} SELECT product_id, name, 'https://img.example/ld/' || product_id || '.jpg' AS image, list_price AS price FROM v_products WHERE product_id % 9 IN (0, 7, 8)")
def json_ld(spark, sf_dir):
    """The product nodes of pages' JSON-LD graphs."""
    n = product_pages(spark, sf_dir).select("product_id", H.json_ld_product(F.col("html")).alias("n")).where("n is not null")
    return n.select("product_id", "n.name", F.get_json_object("n.image", "$[0]").alias("image"), F.get_json_object("n.offers", "$.price").cast("double").alias("price"))


@query(f"""WITH {PRODUCTS} SELECT product_id, CASE product_id % 5 WHEN 0 THEN 'https://img.example/l/' || product_id || '.jpg' WHEN 1 THEN 'https://img.example/d/' || product_id || '.jpg' WHEN 2 THEN 'https://img.example/b/' || product_id || '.jpg'
 ELSE CASE WHEN product_id % 9 IN (0, 7, 8) THEN 'https://img.example/ld/' || product_id || '.jpg' WHEN product_id % 5 = 3 THEN 'https://img.example/m/' || product_id || '.jpg' END END AS image FROM v_products""")
def image_pick(spark, sf_dir):
    """A product's picture by the order of sources, junk left out."""
    return product_pages(spark, sf_dir).select("product_id", H.image_of(F.col("html")).alias("image"))


_CART, _TEXT = "<button>Sepete Ekle</button>", "lorem ipsum " * 60
#: html, badge, filtered, alone, cartless, and what must be read: every rule of stock_of_html once at least.
STOCK_CASES = (
    ("<p>Ön Sipariş</p>" + _CART, None, False, True, False, "preorder", "preorder-buy-box"),
    ("<b>Tükendi</b>" + _CART, None, False, False, False, "unknown", "product-page-required"),
    ("<b>Tükendi</b>", None, False, True, False, "out_of_stock", "page"),
    ("<p>Stok miktarı: 0</p>", None, False, True, False, "out_of_stock", "page"),
    ("<p>x</p>", "Stokta yok", False, True, False, "out_of_stock", "badge"),
    ("<p>x</p>", "Dropshipping", False, True, False, "dropshipping", "badge"),
    ("<p>1.000,00 TL</p>", None, False, False, True, "unknown", "product-page-required"),
    ('<p>1.000,00 TL</p><a class="btn disabled" href="#">Sepete Ekle</a><input type="submit" disabled value="Sepete Ekle">', None, True, True, False, "out_of_stock", "no-add-to-cart"),
    ("<p>x</p>", None, True, True, False, "in_stock", "retailer-stock-only-filter"),
    ("<p>Stok Miktarı 5</p>", None, False, True, False, "in_stock", "stok-miktari"),
    ("<p>Stok Durumu <b>Var</b></p>", None, False, True, False, "in_stock", "stok-durumu"),
    ("<script>Tükendi</script>" + _CART, None, False, True, False, "in_stock", "add-to-cart"),
    ("<p>x</p>", "Stokta", False, True, False, "in_stock", "badge"),
    ("<p>x</p>", None, False, True, False, "unknown", "short-html"),
    (f"<p>{_TEXT}</p>", None, False, True, False, "out_of_stock", "no-add-to-cart"),
)
_PAD = "<p>" + "lorem " * 400 + "</p>"
#: HTTP status, html, rendered, and what must be read: every rule of checked_page.
VISIT_CASES = (
    (200, _CART + _PAD, False, "in_stock", "buy-box"),
    (200, "<p>Ön sipariş, tükendi</p>" + _CART + _PAD, False, "preorder", "buy-box-preorder"),
    (200, "<p>Tükendi</p>" + _CART + _PAD, False, "out_of_stock", "buy-box"),
    (200, '<i data-x="btn_sepet_ekle"></i>' + _PAD, True, "in_stock", "rendered-buy-box"),
    (200, '<script>{"availability": "https://schema.org/BackOrder"}</script>' + _PAD, False, "preorder", "structured"),
    (200, '<link itemprop="availability" href="http://schema.org/OutOfStock">' + _PAD, False, "out_of_stock", "structured"),
    (200, '<script>{"availability":"LimitedAvailability"}</script><p>Tükendi</p>' + _PAD, False, "in_stock", "structured"),
    (200, "<p>Tükendi</p>" + _PAD, False, "out_of_stock", "page-no-cart"),
    (200, "<p>Tükendi</p>" + _PAD, True, "out_of_stock", "rendered-out-of-stock"),
    (200, "<nav>Ön sipariş</nav><footer>Tükendi</footer>" + _PAD, False, "unknown", "no-evidence"),
    (200, "<p>Tükendi</p><p>Sepetim</p>" + _PAD, False, "unknown", "no-evidence"),
    (200, "<p>1.000,00 TL</p><button disabled>Sepete Ekle</button>" + _PAD, True, "out_of_stock", "rendered-no-buy-control"),
    (200, "<p>1.000,00 TL</p><button disabled>Sepete Ekle</button>" + _PAD, False, "unknown", "no-evidence"),
    (200, '<p>Tükendi</p><script>{"availability":"InStock"}</script>' + _CART + _PAD, False, "unknown", "conflicting-signals"),
    (200, _CART, False, "unknown", "short-page"),
    (404, "", False, "out_of_stock", "http-404"),
    (503, _PAD, False, "unknown", "http-503"),
)


def _case(cases, field: int, kind: str) -> Column:
    """A field of the case that a product is given by its id."""
    return F.element_at(F.array(*[F.lit(c[field]).cast(kind) for c in cases]), (F.col("product_id") % len(cases) + 1).cast("int"))


def _case_sql(cases, field: int) -> str:
    return f"([{', '.join(repr(c[field]) for c in cases)}])[product_id % {len(cases)} + 1]"


@query(f"WITH {PRODUCTS} SELECT product_id, {_case_sql(STOCK_CASES, 5)} AS status, {_case_sql(STOCK_CASES, 6)} AS evidence, CASE product_id % {len(STOCK_CASES)} WHEN 3 THEN 0 WHEN 9 THEN 5 END AS quantity FROM v_products")
def stock_html(spark, sf_dir):
    """Stock by a card's HTML, with the evidence: each way that a card may say it, on all products."""
    f = lambda i, kind="boolean": _case(STOCK_CASES, i, kind)
    html = F.concat(F.lit("<h3>"), "name", F.lit("</h3>"), f(0, "string"))
    cards = spread(products(spark, sf_dir).select("product_id", "name"), "product_id").select("product_id", html.alias("html"), f(1, "string").alias("badge"), f(2).alias("filtered"), f(3).alias("alone"), f(4).alias("cartless"))
    read = stock_of_html(F.col("html"), F.col("badge"), F.col("filtered"), F.col("alone"), F.col("cartless"))
    return cards.select("product_id", F.inline(F.array(read))).select("product_id", "status", "evidence", "quantity")


@query(f"WITH {PRODUCTS} SELECT product_id, {_case_sql(VISIT_CASES, 3)} AS status, {_case_sql(VISIT_CASES, 4)} AS method FROM v_products")
def stock_page(spark, sf_dir):
    """Stock by a visit of a product's page: HTTP status, buy box, declared availability, text; each way on all products."""
    html = F.concat(F.lit("<html><h1>"), "name", F.lit("</h1>"), _case(VISIT_CASES, 1, "string"))
    visits = spread(products(spark, sf_dir).select("product_id", "name"), "product_id").select("product_id", _case(VISIT_CASES, 0, "int").alias("http"), html.alias("html"), _case(VISIT_CASES, 2, "boolean").alias("rendered"))
    return visits.select("product_id", F.inline(F.array(checked_page(F.col("http"), F.col("html"), F.col("rendered"))))).select("product_id", "status", "method")


@query(f"""WITH {PRODUCTS} SELECT product_id, name, split_part(name, ' ', 1) AS brand, CASE product_id % 9 WHEN 6 THEN floor(list_price * 1.2 * 100 + 0.5) / 100 WHEN 7 THEN floor(list_price * 1.2 * 100 + 0.5) / 100 ELSE list_price END AS amount,
 CASE WHEN product_id % 4 = 2 AND product_id % 9 >= 4 THEN 'out_of_stock' ELSE (['in_stock', 'out_of_stock', 'in_stock', 'preorder'])[product_id % 4 + 1] END AS stock, outcome FROM (SELECT *, CASE WHEN {I.product_type_sql('name')} NOT IN ('filament', 'other') THEN 'mismatch' ELSE 'product' END AS outcome FROM v_products)""")
def page_reading(spark, sf_dir):
    """Whole product pages read at once: the product again, or another kind than the list's. A page that prints a price and has no cart is sold out."""
    pages = product_pages(spark, sf_dir).select("product_id", F.concat(F.lit("https://shop.example/x-"), _text("product_id")).alias("url"), "html")
    read = H.read_product_page(pages, "filament")
    return read.select("product_id", "name", "brand", "amount", "stock", "outcome")


@query(f"WITH {PRODUCTS} SELECT product_id, true AS there, false AS other FROM v_products")
def price_evidence(spark, sf_dir):
    """Whether a price stands on its page, in whatever way it is written; one that is ten thousand times as high does not."""
    html, p = F.col("html"), F.col("list_price")
    return product_pages(spark, sf_dir).select("product_id", H.price_on_page(html, p).alias("there"), H.price_on_page(html, p * 10000 + 1).alias("other"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref=["'']([^"''#]+)', 1))) AS href FROM pages)
 SELECT page_id, count(*) FILTER (length(regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', '')) > 1 AND NOT regexp_matches(href, '(?i)/(cart|sepet|login|account|uye|blog|iletisim|contact|hakkimizda|about|search|arama)(/|$)|[.](jpg|png|svg|pdf|css|js)$|^(javascript|mailto|tel):')
  AND NOT regexp_matches(regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', ''), '[0-9]{3,}$') AND regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', '') <> regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '/+$', '')) AS nav FROM l GROUP BY 1""")
def nav_links(spark, sf_dir):
    """How many of a page's links may lead to other lists."""
    links = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]+", "").alias("path"), F.explode(G.links(F.col("html"))).alias("href"))
    return links.groupBy("page_id").agg(F.count_if(H.is_nav_link(F.col("href"), F.col("path"))).alias("nav"))


@query(f"WITH {PRODUCTS} SELECT product_id, CASE WHEN variant % 2 = 0 THEN '/list?stok=1' END AS stock_link, CASE WHEN variant % 3 = 0 THEN 4 WHEN variant % 3 = 1 THEN 1 ELSE 0 END AS pages FROM v_products")
def list_links(spark, sf_dir):
    """The stock filter and the further pages of a list: by a total, by rel=next, or none."""
    v = F.col("variant")
    html = F.concat(F.when(v % 2 == 0, '<a href="/list?stok=1">Stokta</a>').otherwise('<a href="/list?sort=1">Sort</a>'), F.when(v % 3 == 0, "<p>Sayfa 2 / 6</p>").when(v % 3 == 1, '<a rel="next" href="/list?p2">next</a>').otherwise("<p>end</p>"))
    made = products(spark, sf_dir).select("product_id", html.alias("html"))
    return made.select("product_id", H.stock_filter_link(F.col("html")).alias("stock_link"), F.size(H.next_pages(F.lit("https://s.example/list?page=2"), F.col("html"), F.lit(2))).alias("pages"))


@query("""WITH p AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS u, page_id % 6 AS w FROM pages)
 SELECT page_id, CASE w WHEN 0 THEN u || '?page=3' WHEN 1 THEN u || '/page/3/' WHEN 2 THEN u || '?sort=a&sayfa=3' WHEN 3 THEN u || '?pg=48' WHEN 4 THEN u || '/3' END AS third FROM p""")
def page_patterns(spark, sf_dir):
    """The third page of lists, whose first two pages number themselves in five ways, or not at all."""
    u, w = F.split("url", "[?#]")[0], F.col("page_id") % 6
    ways = [("", "?page=2"), ("/", "/page/2/"), ("?sort=a", "?sort=a&sayfa=2"), ("?pg=0", "?pg=24"), ("", "/2"), ("?id=1", "?id=2")]
    pick = lambda k: F.concat(u, F.element_at(F.array(*[F.lit(x[k]) for x in ways]), (w + 1).cast("int")))
    lists = table(spark, sf_dir, "pages").select("page_id", pick(0).alias("first"), pick(1).alias("second"))
    return lists.select("page_id", paging.page_at(paging.pattern(F.col("first"), F.col("second")), F.lit(3), F.col("first")).alias("third"))


@query(f"""WITH {PRODUCTS}, n AS (SELECT brand AS shop, name, 'https://s.example/' || product_id AS url FROM v_products UNION ALL SELECT brand, color, NULL FROM v_products)
 SELECT shop, coalesce(url, 'title:' || lower(name)) AS key, min(name) AS name FROM n GROUP BY 1, 2""")
def schema_free_walk(spark, sf_dir):
    """Listings out of nested JSON of any shape: objects with a name or a title, once for each address, else for each title of a shop."""
    inner = F.struct(F.col("color").alias("title"), F.col("list_price").alias("price"))
    doc = F.to_json(F.struct(F.struct(F.array(F.struct("name", F.concat(F.lit("https://s.example/"), _text("product_id")).alias("url"), F.struct(F.array(inner).alias("more")).alias("rest"))).alias("items")).alias("data")))
    rows = K.named_objects(products(spark, sf_dir).select(F.col("brand").alias("shop"), doc.alias("doc")), "shop", "doc")
    return rows.groupBy("shop", F.coalesce("url", F.concat(F.lit("title:"), F.lower("name"))).alias("key")).agg(F.min("name").alias("name"))


@query(f"WITH {OFFERS} SELECT product_id, ord, price FROM v_offers WHERE price > 0 AND stock <> 'out_of_stock' QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, ord) <= 3 ORDER BY price, product_id, ord LIMIT 12")
def stock_preview(spark, sf_dir):
    """Three cheapest offers of each product, and of these the twelve cheapest."""
    live = offers(spark, sf_dir).where(O.is_live(F.col("price"), F.col("stock"))).select("product_id", "ord", "price")
    return O.top_n(live, ["product_id"], [F.asc("price"), F.asc("ord")], 3).orderBy("price", "product_id", "ord").limit(12).select("product_id", "ord", "price")
