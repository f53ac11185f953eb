"""All axes, conflicts and the stable id, by titles with known answers."""

from pyspark.sql import functions as F

from shelfwise.operators import whole as W
from shelfwise.sources.dictionary import dictionary

ROWS = [
    # id, name, kind, brand, url, identity
    (1, "Bambu Lab P1S Combo", "printer", "Bambu Lab", None, "bambu/p1s/combo/ams"),
    (2, "BambuLab P1S AMS 2 Pro Combo 3D Yazıcı", "printer", "BambuLab", None, "bambu/p1s/combo/ams-2-pro"),
    (3, "Bambu Lab A1 mini", "printer", "Bambu", None, "bambu/a1-mini/bare/mini"),
    (4, "H2D Laser Full Combo 10W", "printer", "Bambu Lab", None, "bambu/h2d/combo/ams/laser-10w/laser"),
    (5, "H2D Lazer Full Combo 40 Watt", "printer", "Bambu Lab", None, "bambu/h2d/combo/ams/laser"),
    (6, "Creality Ender 3 kurulu", "printer", "Creality", None, "creality/ender-3/bare/assembled"),
    (7, "Creality Ender 3 DIY", "printer", "Creality", None, "creality/ender-3/bare/kit"),
    (8, "Acme KP3S Pro Yazıcı", "printer", "Acme", None, "unknown/kp3s-pro/bare/pro"),
    (9, "Elegoo Saturn 4 Ultra", "printer", "Elegoo", None, "elegoo/saturn-4-ultra/bare/resin/ultra"),
    (10, "Bambu Lab", "printer", "Bambu Lab", "https://s.example/urun/bambu-lab-x1c-combo?x=1", "bambu/x1c/combo/ams"),
    (11, "Anycubic Kobra S1 ACE 2 Pro Combo", "printer", "Anycubic", None, "anycubic/kobra-s1/combo/ace-2-pro"),
    (12, "Voron 2.4 350 mm kit", "printer", "Voron", None, "voron/2-4/size-350/bare"),
    (13, "Esun PLA+ Siyah 1 kg 1.75 mm makaralı", "filament", "Esun", None, "esun/siyah-1/bare/plus"),
    (14, "Creality K2", "printer", "Creality", None, "creality/k2/bare"),
    (15, "Creality K2 Plus", "printer", "Creality", None, "creality/k2-plus/bare/plus"),
    (16, "Bambu Lab P1S AMS'siz", "printer", "Bambu Lab", None, "bambu/p1s/bare/ams"),
    (17, "", "printer", None, None, "unknown/unnamed/bare"),
    (18, None, None, None, None, "unknown/unnamed/bare"),
    (19, "Esun PETG Kırmızı 1kg", "filament", "Esun", None, "esun/unnamed/bare"),
    (20, "Nova A1 yazıcı", "printer", "Nova", None, "unknown/a1/bare"),
    (21, "Orion A1 yazıcı", "printer", "Orion", None, "unknown/a1/bare"),
    (22, "Prusa MK4S + Bambu Lab P1S hediyeli lazer", "printer", "Prusa", None, None),
]


def table(spark):
    df = spark.createDataFrame([r[:5] for r in ROWS], "id int, name string, kind string, brand string, url string")
    return W.with_identity(df.withColumn("axes_", F.lit("x")).withColumn("a.b", F.lit("y")), dictionary(spark))


def test_identities(spark):
    got = {r.id: r for r in table(spark).collect()}
    assert {i: got[i].identity for i, *_, want in ROWS if want} == {i: want for i, *_, want in ROWS if want}
    assert set(got[1].axes.asDict()) == set(W.AXES) and len(W.AXES) == 26 and got[1]["a.b"] == "y"
    a = {i: r.axes for i, r in got.items()}
    assert (a[10].title_incomplete, a[10].url_model_core, a[1].title_incomplete) == (True, "x1c", False)
    assert (a[13].polymer, a[13].variant, a[13].color, a[13].weight, a[13].diameter, a[13].packaging) == ("pla", "plus", "black", "1000", "175", "spool")
    assert (a[2].feeder_named, a[1].feeder_named, a[2].ams, a[4].laser_w, a[5].laser_w, a[20].generic_core) == (True, False, "ams 2", "10", "40", True)
    assert W.with_identity(spark.createDataFrame([], "id int, name string, kind string, brand string"), dictionary(spark)).count() == 0


def test_conflicts_and_gaps(spark):
    t = table(spark).select("id", "axes")
    pairs = spark.createDataFrame([(1, 2), (3, 1), (4, 5), (6, 7), (9, 14), (14, 15), (13, 19), (1, 16), (1, 1), (20, 21), (12, 14), (1, 13), (14, 10)], "a int, b int")
    both = pairs.join(t.select(F.col("id").alias("a"), F.col("axes").alias("x")), "a").join(t.select(F.col("id").alias("b"), F.col("axes").alias("y")), "b")
    got = {(r.a, r.b): (set(r.c), set(r.g)) for r in both.select("a", "b", W.all_conflicts(F.col("x"), F.col("y")).alias("c"), W.all_gaps(F.col("x"), F.col("y")).alias("g")).collect()}
    assert got[1, 1] == (set(), set()) and got[1, 2] == ({"feeder"}, set())
    assert got[3, 1][0] == {"model", "combo", "mini"} and got[4, 5][0] == {"laser"} and got[6, 7][0] == {"kit"}
    assert got[9, 14][0] == {"model", "technology", "variant"} and got[14, 15][0] == {"model", "variant"} and got[1, 16][0] == {"combo"}
    assert got[13, 19] == ({"polymer", "color", "variant"}, {"diameter", "packaging", "variant"})
    assert "unknown-brand" in got[20, 21][0] and "model" in got[14, 10][0] and "kind" in got[1, 13][0]
