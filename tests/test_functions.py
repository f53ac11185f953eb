"""Scalar functions against tables of expected values."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import identity as I
from shelfwise.functions import money as M
from shelfwise.functions import search as S
from shelfwise.functions import similarity as L
from shelfwise.functions import stock as K
from shelfwise.functions import text as T


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def pairs(spark, values, f):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    return [r.out for r in rows.select("i", f(F.col("a"), F.col("b")).alias("out")).orderBy("i").collect()]


def test_parse_money(spark):
    cases = {
        "1.250,00 TL": 1250.0, "1,250.00": 1250.0, "1.250": 1250.0, "12,50": 12.5, "2.146,24 TL": 2146.24, "$1,234.56": 1234.56, "%21 46.236,14 TL": None,
        "58.526,76 TL 46.236,14 TL": None, "K2 Combo 100": None, "K2": None, "0 TL": None, "": None, "600.000,00 TL": 600000.0, "1.234.567": 1234567.0, "12.5": 12.5,
    }
    assert one(spark, list(cases), M.parse_money) == list(cases.values())
    assert one(spark, [None], M.parse_money) == [None]


def test_pick_money(spark):
    texts = [
        "%21 58.526,76 TL 46.236,14 TL 4.858,65 TL 'den başlayan taksitlerle", "2500 TL ÜZERİ ALIŞVERİŞTE KARGO ÜCRETSİZ", "Creality K2 Plus 3D 10W", None, "9.133.172,77 TL", "price 19,99 then 10,00 EUR",
    ]
    got = one(spark, texts, M.pick_money)
    assert (got[0].amount, got[0].was, got[0].currency, got[0].suspect) == (46236.14, 58526.76, "TRY", False)
    assert got[1] is None and got[2] is None and got[3] is None
    assert got[4].suspect and got[5].amount == 10.0 and got[5].currency == "EUR"


def test_currency_and_format(spark):
    assert one(spark, ["1 TL 2 $ 3 $", "5 € 6 TL", "none", None], M.detect_currency) == ["USD", "EUR", "", ""]
    assert one(spark, ["TL", "₺", "usd", "x", None], M.currency_of) == ["TRY", "TRY", "USD", "", ""]
    assert one(spark, [1234.5, 0.0, 1000000.0], M.format_price, "double") == ["1.234,50 TL", "0,00 TL", "1.000.000,00 TL"]


def test_folds(spark):
    assert one(spark, ["YAZICI İşÇ Ğü", "K2ProCombo", "k2pro", None, " a--b "], T.fold) == ["yazici isc gu", "k2 pro combo", "k2 pro", "", "a b"]
    assert one(spark, ["PLA+ Siyah", "AMS'siz", "Bambu Lab A1 AMS ile", "1,75 mm", "1000 gr makaralı"], T.title_rules) == ["pla plus siyah", "bare", "bambu lab a1 combo", "175mm", "1kg spool"]
    assert one(spark, ["Creality K2 Plus 3D Yazıcı k2 2024 x"], T.tokens) == [["creality", "k2", "plus"]]
    assert one(spark, ["Çé ß İI", None], T.fold_locale) == ["ce ss ii", ""]
    assert one(spark, ["für den Drucker", "yazıcı", "la impresora", "printer", None, ""], T.detect_lang) == ["de", "tr", "es", "en", "en", "en"]
    assert one(spark, ["<p>a&amp;b<!-- x --><script>no()</script> <b>c</b></p>", None], T.visible_text) == ["a&b c", ""]
    assert one(spark, ["k2 pro max", "a b", "pro plus pro"], T.variant_tag) == ["max pro", "", "plus pro"]


def test_stock_and_vat(spark):
    cases = {"Stoktan Teslim": "in_stock", "TÜKENDİ": "out_of_stock", "Ön Sipariş": "preorder", "Sepete Ekle": "in_stock", "stokta yok": "out_of_stock", "Stokta": "in_stock", "": "unknown", "dropshipping": "dropshipping"}
    assert one(spark, list(cases), K.stock_from_text) == list(cases.values())
    assert one(spark, ["KDV dahil", "+ KDV", "KDV hariç", "x", None], K.vat_from_text) == ["included", "excluded", "excluded", "unknown", "unknown"]
    rows = spark.createDataFrame([(404, "x"), (500, "x"), (200, "short"), (200, "Sepete Ekle " + "y" * 2000), (200, "Sepete Ekle Tükendi " + "y" * 2000)], "s int, h string")
    assert [r[0] for r in rows.select(K.page_status(F.col("s"), F.col("h"))).collect()] == ["out_of_stock", "unknown", "unknown", "in_stock", "unknown"]


def test_likeness(spark):
    assert pairs(spark, [("creality", "crealty"), ("abc", "abd"), ("a", "a"), ("printers", "pointers")], L.similar) == [True, False, True, True]
    assert pairs(spark, [("plsu", "plus"), ("plus", "pls"), ("plus", "puls"), ("abcd", "badc"), ("k2", "k3")], L.near) == [True, False, True, False, False]
    score = pairs(spark, [("K2 Plus Combo", "combo k2 plus"), ("K2 Combo", "K2 Plus Combo"), ("", ""), ("a b", "")], L.title_score)
    assert score[0] == 1.0 and score[1] == pytest.approx(2 / 3) and score[2] == 1.0 and score[3] == 0.0
    assert pairs(spark, [("Creality K2", "Creality K2 outdoor"), ("Creality K2", "Creality K2 Plus")], L.title_subset) == [True, False]
    assert one(spark, ["00000000000000ff", "zz", "ffffffffffffffff"], lambda c: L.hamming(L.hash_bits(c), F.lit(0).cast("long"))) == [8, 64, 64]


def test_search(spark):
    rows = [
        ("creality k2 plus combo", "Creality K2 Plus Combo 3D Yazıcı", True), ("creality k2 plus combo", "k2 plus", True), ("creality k2 plus combo", "3d yazıcı", True), ("creality k2 plus combo", "yazici k2 plus", True),
        ("creality k2 plus combo", "k2 ultra", False), ("creality k2 plus combo", "p1s", False), ("Creality K2 Combo 3D Yazıcı", "K2 Plus", False), ("Bambu Lab A1 Mini", "a1mini", True), ("Creality Ender 3 V3 Ürün İnceleme", "urun inceleme", True), ("Anycubic Kobra 3 V2 Combo", "KOBRA", True), ("x", "", True),
    ]
    df = spark.createDataFrame(rows, "name string, q string, want boolean")
    for r in df.select("name", "q", "want", S.matches(F.col("name"), F.col("name"), F.col("q")).alias("got")).collect():
        assert r.got == r.want, r
    scores = pairs(spark, [("creality k2", "creality k2"), ("k2 creality x", "creality k2"), ("a k2 pro", "k2"), ("k2 plus", "k2 pro"), ("foo bar", "foo baz qux")], lambda a, b: S.search_score(a, a, b))
    assert scores == [100, 88, 84, 45, 0]


def test_axes(spark):
    assert one(spark, ["PLA Siyah", "Kırmızı ve mavi", "x", None], I.color_of) == ["black", "blue", "", ""]
    assert one(spark, ["1 kg", "1000 gr", "750g", "none"], I.grams) == ["1000", "1000", "750", ""]
    assert one(spark, ["H2D Laser 10W", "H2D 40 Watt combo", "350W", "Güç kaynağı 60W", "x"], I.laser_watts) == ["10", "40", "", "", ""]
    assert one(spark, ["Bambu Lab A1 tarzı", "A1 nozzle yedek parça", "Çift nozul yazıcı", "A1"], I.is_lookalike) == [True, True, False, False]
    assert one(spark, ["1.75 mm", "2,85mm", "x"], I.diameter_of) == ["175", "285", ""]


def test_decisions(spark):
    cases = [
        ("Creality K2 Plus Combo", "printer", "Creality K2 PlusCombo 3D Yazıcı", "printer", "merge"), ("Creality K2 Combo", "printer", "Creality K2 Plus Combo", "printer", "create"), ("Ender 3 kit", "printer", "Ender 3 montajlı", "printer", "create"),
        ("Bambu A1", "printer", "Bambu A1 Combo", "printer", "create"), ("Esun PLA Siyah 1kg", "filament", "Esun PLA Black 1000 gr", "filament", "merge"), ("PLA Siyah 1kg", "filament", "PLA Siyah 1kg makaralı", "filament", "review"),
        ("A1", "printer", "A1 nozzle yedek", "printer", "create"), ("H2D laser 10W", "printer", "H2D laser 40W", "printer", "create"),
    ]
    df = spark.createDataFrame(cases, "a string, ak string, b string, bk string, want string").withColumn("brand", F.lit("Acme"))
    both = df.select("a", "b", "want", I.features(F.col("a"), F.col("ak"), F.col("brand")).alias("x"), I.features(F.col("b"), F.col("bk"), F.col("brand")).alias("y"))
    for r in I.decided(both, "x", "y").collect():
        assert r.action == r.want, r


def test_money_tokens_in_blocks(spark):
    """Places do not depend on how many matches are placed at once, and many take time in proportion."""
    import random
    import time

    rng = random.Random(1)
    parts = ["12", " ", "1.234,50", "TL", "$", "€", "x", "%", "  ", "ı", "İ", "taksit", "3,5", "\n", "USD", "9", "."]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))),) for _ in range(300)], "t string")
    both = df.select("t", M.raw_tokens(F.col("t"), 2).alias("a"), M.raw_tokens(F.col("t")).alias("b"))
    assert both.where("a is distinct from b").count() == 0
    for r in both.collect():
        for t in r.b:
            assert r.t[: t.end].endswith(t.raw) and t.number in r.t[t.start : t.end] and r.t[: t.start].endswith(t.before) and len(t.before) == min(3, t.start)
            assert r.t[r.t.index(t.number, t.start) + len(t.number) :].startswith(t.after)
    long = spark.createDataFrame([(" ".join(f"{i},50 TL x" for i in range(20_000)),)], "t string")
    began = time.time()
    assert long.select(F.size(M.money_tokens(F.col("t")))).first()[0] == 20_000 and time.time() - began < 60
