"""F7, F8, F9: the quick ways of reading cards say what the slow ones say."""

import random

from pyspark.sql import functions as F

from shelfwise.functions import money as M
from shelfwise.functions import text as X
from shelfwise.sources import cards as C

PIECES = ["<ul>", "</ul>", "<li>", "</li>", "<LI class=\"product-item a\">", "<a href=\"/p/x-123\">", "</a>", "</p>", "<img src=\"/a.jpg\" alt>", "<br>", "</br>", "<div data-Product-Id=\"1\">", "</div >", " 12,50 TL ", "Sepete Ekle", "x &amp; y"]
ODD = ["<a href='/p/1'>", "<br/>", "<script>if (a<b) x</script>", "<!-- <li> -->", "a < b", "<p title=\"a>b\">", "<i x=\"&lt;\">", "<b", "</ul x>", "<title>"]


def test_plain_pages_have_the_parsers_elements():
    draw = random.Random(7)
    for _ in range(300):
        page = "".join(draw.choices(PIECES, k=draw.randrange(25)))
        assert C.plain_elements(page) == C.Page(page).elements
        at = draw.randrange(len(page) + 1) if "<" not in page else page.index("<")
        odd = page[:at] + draw.choice(ODD) + page[at:]
        assert C.elements_of(odd) == C.Page(odd).elements
    assert all(C.plain_elements("<ul>" + x + "</ul>") is None for x in ODD)


def test_single_prices_are_picked_alike(spark):
    texts = ["12,50 TL", "1.234,50 TL", "1,234.50$", "0,00 TL", "1.234.567,89 eur", "999.999,99 ₺", "12.50 CHF", "1234,50 TL", "12,50", "1.2,50 TL", "12,50 TL\n", " 12,50 TL", "12,505 TL", "%12,50 TL", "12,50  TL", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").orderBy("i")
    quick, slow = rows.select(M.pick_money(F.col("v"))).collect(), rows.select(X.let(F.coalesce("v", F.lit("")), M._picked)).collect()
    assert quick == slow
    assert [bool(r[0]) for r in rows.select(F.col("v").rlike(M.SINGLE)).collect()][:8] == [True] * 7 + [False]


def test_letters_as_translate(spark):
    rows = spark.createDataFrame([("İIıŞĞÇÜÖşğçüö Straße ÂIŞ",), ("",), (None,)], "v string")
    low = F.translate(F.lower(F.translate(F.coalesce("v", F.lit("")), "İI", "iı")), X.TR_FROM, X.TR_TO)
    assert all(a == b for a, b in rows.select(X.lower_tr(F.col("v")), low).collect())
