"""Cards, prices, stock and pictures out of small pages."""

from pyspark.sql import functions as F

from shelfwise.functions.stock import checked_page, stock_of_html
from shelfwise.plans import markup as P
from shelfwise.sources import cards as C
from shelfwise.sources import markup as H
from shelfwise.sources import sinks as S


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_cards_by_marks_and_by_links():
    marked = '<div class="product-item a"><div class="product-item">x</div></div><p>y<div class=\'product-item\'>z'
    assert C.cards_in(marked) == ['<div class="product-item a"><div class="product-item">x</div></div>', "<div class='product-item'>z"]
    assert C.cards_in('<li class="product">a</li><b data-product-id=1>c</b>') == ["<b data-product-id=1>c</b>"]  # the first mark that a page has
    assert C.cards_in('<div class="urun-kutu">a<img src=x></div><div class="product-title">b</div>') == ['<div class="urun-kutu">a<img src=x></div>']
    grid = "".join(f'<li><div><a href="/p/a-{n}">n</a></div> {n} TL{" <b>Sepete Ekle</b>" if n % 2 else ""}</li>' for n in range(100, 106))
    page = f'<ul><li><a href="/about">1 TL</a></li></ul><ul>{grid}</ul>'
    assert len(C.cards_in(page)) == 6 and all(c.startswith("<li><div><a") for c in C.cards_in(page))
    assert C.cards_in(page.replace("TL", "")) == [] and C.cards_in("") == [] and C.cards_in("<a href='/p/x-100'>1 TL</a>") == []


def test_shapes():
    cases = {"/p/k2-1001": "p/*", "https://x/p/k2-1001": "p/*", "x-u126396": "*", "/about": "", "/k-12": "", "/marka-123": "", "fdm-yazicilar-ka434": "", "/d.aspx?id=12&b=x": "d.aspx?id", "javascript:x(123)": "", "": "", "p-12345": "*"}
    assert {h: C.shape_of(h) for h in cases} == cases


def test_prices_and_their_evidence(spark):
    ld = '<script type="application/ld+json">{}</script>'
    pages = [
        ld.format('[{"@type":"Organization"},{"@type":["Product"],"offers":[{"lowPrice":"1.250,00","priceCurrency":"try"}]}]'), ld.format('{"@type":"Product","price":99.5}'), ld.format("{broken"), None, '<meta content="12,50" itemprop="price">',
        '<i data-price="77,00">', '<script>{"sepetFiyatStr":"1.000,00 TL"}</script><p>900 TL</p>', "<b>KDV Dahil: 120,00 TL</b> 100,00 TL", "<p>no price</p>",
    ]
    got = one(spark, pages, lambda c: H.arbitrated(c, F.lit(10.0)))
    assert [(r.price, r.method) if r else None for r in got] == [(1250.0, "json-ld"), (99.5, "json-ld"), None, None, (12.5, "microdata"), (77.0, "attribute"), (1000.0, "cart-price"), (120.0, "vat-included-price"), None]
    assert one(spark, pages[:1], lambda c: H.arbitrated(c, F.lit(5000.0))) == [None]  # under the floor
    assert [r.amount for r in one(spark, ['<del>90,00 TL</del><span class="price">%10 80,00 TL</span>', "<b>K2 Pro 100</b> 55,00 TL", '<span class="old-price">99,00 TL</span> 70,00 TL'], H.card_price)] == [80.0, 55.0, 70.0]
    swapped = one(spark, ['<b class="sale-price">120,00 TL</b><b class="old-price">100,00 TL</b>', "<p>1.000,00 TL + KDV</p>"], H.page_price)
    assert (swapped[0].amount, swapped[0].was) == (100.0, 120.0) and swapped[1].amount == 1200.0
    assert one(spark, ["a 1.234,50 TL", "1,234.50", "11234,50", "1.234,501"], lambda c: H.price_on_page(c, F.lit(1234.5))) == [True, True, False, False]


def test_stock_of_html(spark):
    """The cases of the queries, and what they can't say."""
    for cases, f in ((P.STOCK_CASES, lambda r: stock_of_html(F.col("html"), F.col("badge"), F.col("filtered"), F.col("alone"), F.col("cartless"))),):
        rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, html string, badge string, filtered boolean, alone boolean, cartless boolean")
        got = rows.select("i", F.inline(F.array(f(rows)))).orderBy("i").collect()
        assert [(r.status, r.evidence) for r in got] == [c[5:7] for c in cases]
        assert all(r.verified == (r.status != "unknown") for r in got)
    visits = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(P.VISIT_CASES)], "i int, http int, html string, rendered boolean")
    got = visits.select("i", F.inline(F.array(checked_page(F.col("http"), F.col("html"), F.col("rendered"))))).orderBy("i").collect()
    assert [(r.status, r.method) for r in got] == [c[3:5] for c in P.VISIT_CASES]
    odd = one(spark, [None, "", "<p>Ön sipariş</p>", "<p>Tükenmiş</p>" + "x" * 500, "<button aria-disabled='true'>Sepete Ekle</button>5 TL", "Tükendi, stoktan teslim <button>Add to cart</button>"], lambda c: stock_of_html(c, F.lit(None).cast("string")))
    assert [r.evidence for r in odd] == ["short-html", "short-html", "short-html", "no-add-to-cart", "no-add-to-cart", "stok-durumu"]
    far = "x " * 600
    assert one(spark, [f"<p>Tükendi</p>{far}<button>Sepete Ekle</button>{far}", f"{far}<p>Tükendi <button>Sepete Ekle</button></p>{far}"], lambda c: checked_page(F.lit(200), c).status) == ["in_stock", "out_of_stock"]


def test_lists_of_several_cards(spark):
    """Contradictory cards and lists without carts are left to the product's page; copies of a link and shared pictures go."""
    card = lambda n, more, img="a": f'<div class="product-item"><a href="https://s.example/p/x-{n}">l</a><h3>Filament {n}</h3><img src="/{img}.jpg"><b class="price">{n},00 TL</b>{more}</div>'
    cart, gone = "<button>Sepete Ekle</button>", "<i>Tükendi</i>"
    pages = [(1, card(1001, cart) + card(1002, cart + gone, "b") + card(1001, cart) + card(1003, "", "c") + card(1004, cart, "b")), (2, card(1005, "") + card(1006, "")), (3, card(1007, cart + gone)), (4, card(1008, "")), (5, "")]
    got = H.listing_cards(C.cards_of(spark.createDataFrame(pages, "page int, html string")).drop("html"), "filament", ["page"]).collect()
    assert {(r.page, r.url[-4:]): (r.outcome, r.evidence) for r in got} == {
        (1, "1001"): ("product", "add-to-cart"), (1, "1002"): ("open", "product-page-required"), (1, "1003"): ("rejected", "no-add-to-cart"), (1, "1004"): ("product", "add-to-cart"),
        (2, "1005"): ("open", "product-page-required"), (2, "1006"): ("open", "product-page-required"), (3, "1007"): ("rejected", "page"), (4, "1008"): ("rejected", "no-add-to-cart"),
    }
    assert len(got) == 8 and {r.url[-4:]: r.image for r in got if r.page == 1} == {"1001": "/a.jpg", "1002": None, "1003": "/c.jpg", "1004": None}


def test_whole_product_pages(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","name":"Creality K2 Plus - STOKTAN","brand":{"name":"Creality"},"image":"/k2.jpg","offers":{"price":100.5,"priceCurrency":"TRY","availability":"InStock"}}</script>'
    cart = "<button>Sepete Ekle</button>"
    pages = [
        (1, "https://shop.example/k2-plus-1001", ld + cart), (2, "https://shop.example/bambu-lab-a1-1002.html", '<meta property="og:title" content="Shop"><div class="brand">Bambu Lab</div><p>500,00 TL KDV dahil</p>' + cart),
        (3, "https://shop.example/x", "<h1>Anet A8</h1>"), (4, "https://shop.example/e", '<meta property="og:title" content="Esun PLA Filament"><p>300,00 TL</p>' + cart), (5, "https://shop.example/", None),
    ]
    got = {r.id: r for r in H.read_product_page(spark.createDataFrame(pages, "id int, url string, html string"), "printer").collect()}
    assert (got[1].name, got[1].brand, got[1].amount, got[1].price_source, got[1].image, got[1].stock) == ("Creality K2 Plus", "Creality", 100.5, "json-ld", "/k2.jpg", "in_stock")
    assert (got[2].name, got[2].brand, got[2].amount, got[2].vat, got[2].price_source) == ("Bambu Lab A1", "Bambu Lab", 500.0, "included", "vat-included-price")
    assert (got[3].outcome, got[3].reason) == ("incomplete", "no believable price") and got[3].name == "Anet A8"
    assert (got[4].outcome, got[4].kind) == ("mismatch", "filament") and (got[5].outcome, got[5].name, got[5].stock) == ("incomplete", None, "unknown")


def test_pictures_and_links(spark):
    pages = [
        '<img src="/logo.png"><img src="data:x" data-src="/a.jpg">', '<source srcset="/s.jpg 100w, /l.jpg 900w">', '<i style="background: url(/b.jpg)">', '<meta name="og:image" content="/m.jpg">', None,
    ]
    assert one(spark, pages, H.image_of) == ["/a.jpg", "/l.jpg", "/b.jpg", "/m.jpg", None]
    assert one(spark, ['<a href="/l?a=1">x</a><a href="/l?stok=1">y</a>', "<a href='/l'>x</a>"], H.stock_filter_link) == ["/l?stok=1", None]
    nav = spark.createDataFrame([("/list/a",), ("/sepet",), ("/p/k2-1001",), ("/here/",), ("/a.pdf",), ("#",)], "u string")
    assert [r[0] for r in nav.select(H.is_nav_link(F.col("u"), F.lit("/here"))).collect()] == [True, False, False, False, False, False]
    pages = one(spark, ["Sayfa 2 / 4", '<a href="?page=5">5</a>', '<a rel="next" href="/n">', "x"], lambda c: H.next_pages(F.lit("https://s/l?page=2"), c, F.lit(2)))
    assert [len(p) for p in pages] == [2, 3, 1, 0] and pages[0][0] == "https://s/l?page=3" and pages[2] == ["/n"]


def test_restore_keeps_what_was_current(spark, tmp_path):
    root = str(tmp_path / "c")
    S.snapshot(spark.range(3), root, "one")
    S.publish(spark, root, "one")
    S.snapshot(spark.range(5), root, "two")
    S.publish(spark, root, "two")
    S.restore(spark, root, "one", "before")
    assert S.current(spark, root).count() == 3 and spark.read.parquet(f"{root}/versions/before").count() == 5
    S.write_run({"held": spark.range(2), "placed": spark.range(4)}, f"{tmp_path}/run", "r1")
    assert spark.read.parquet(f"{tmp_path}/run/r1/held").count() == 2
    assert {r.part: r.n for r in spark.read.json(f"{tmp_path}/run/r1/summary").collect()} == {"held": 2, "placed": 4}
