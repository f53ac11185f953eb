import random

from pyspark.sql import functions as F

from shelfwise.functions.identity import decided, features
from shelfwise.operators import placement as P

LISTING = "id long, title string, kind string, brand string, url string"


def test_place(spark):
    catalogue = spark.createDataFrame([(1, "Creality K2 Plus Combo", "printer", "Creality"), (2, "Bambu Lab A1 mini", "printer", "Bambu Lab"), (3, "Esun PLA Siyah 1kg", "filament", "Esun")], "id long, title string, kind string, brand string")
    offers = spark.createDataFrame([(2, "https://s/a1")], "product_id long, url string")
    rows = [
        (10, "anything", "printer", "x", "https://s/a1"), (11, "CREALITY K2 PlusCombo 3D Yazıcı", "printer", "Creality", "u11"), (12, "Esun PLA Black 1000 gr", "filament", "Esun", "u12"),
        (13, "Prusa Core One", "printer", "Prusa", "u13"), (14, "prusa core one", "printer", "Prusa", "u14"), (15, "Esun PLA Siyah 1kg makaralı", "filament", "Esun", "u15"), (16, None, None, None, None), (17, "Creality K2 Combo", "printer", "Creality", "u17"),
    ]
    audit = P.place(spark.createDataFrame(rows, LISTING), catalogue, offers)
    got = {r.id: (r.action, r.target) for r in audit.collect()}
    assert got == {10: ("updated", "2"), 11: ("merged", "1"), 12: ("merged", "3"), 13: ("created", "new-13"), 14: ("merged", "new-13"), 15: ("held", "3"), 16: ("held", None), 17: ("created", "new-17")}
    assert tuple(P.summary(audit).first()) == (3, 2, 1, 2)


def test_against_one_by_one(spark):
    """Every listing in turn against the catalogue and what earlier ones made."""
    rng = random.Random(6)
    base = [
        ("Creality K2 Plus Combo", "printer", "Creality"), ("CREALITY K2 PlusCombo 3D Yazıcı", "printer", "Creality"), ("Creality K2 Plus", "printer", "Creality"), ("Creality K2 Plus yazici", "printer", "Creality"), ("Bambu Lab A1 mini", "printer", "Bambu Lab"),
        ("BambuLab A1 Mini Combo", "printer", "Bambu"), ("eSUN PLA Plus Black 1000 gr 1,75mm", "filament", "Esun"), ("PLA+ Siyah 1 kg 1.75 mm Filament", "filament", "Esun"), ("Esun PLA+ Siyah", "filament", "Esun"), ("Esun PLA Plus Siyah 1kg makaralı", "filament", "Esun"),
        ("Prusa Core One", "printer", "Prusa"), ("prusa core one", "printer", "Prusa"), ("Original Prusa Core One kit", "printer", "Prusa"), ("Ender 3 kit", "printer", "Creality"), ("Ender 3", "printer", "Creality"), ("", "printer", "x"),
    ]
    rows = [(100 + i, *rng.choice(base), f"u{i}") for i in range(40)]
    shelf = [(1, *base[3]), (2, *base[8])]
    got = {r.id: (r.action, r.target) for r in P.place(spark.createDataFrame(rows, LISTING).repartition(3), spark.createDataFrame(shelf, "id long, title string, kind string, brand string"), spark.createDataFrame([(2, "u5")], "product_id long, url string")).collect()}
    every = spark.createDataFrame([r[:4] for r in rows] + shelf, "id long, title string, kind string, brand string")
    f = lambda t: features(F.col(f"{t}.title"), F.col(f"{t}.kind"), F.col(f"{t}.brand"))
    pairs = every.alias("a").crossJoin(every.alias("b")).where("a.id > 99 and a.id > b.id").select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), f("a").alias("p"), f("b").alias("q"))
    said = {(r.i, r.j): (r.action, r.score) for r in decided(pairs, "p", "q").collect()}
    want, made = {}, []
    for i, title, _, _, url in rows:
        if url == "u5":
            want[i] = ("updated", "2")
        elif not title:
            want[i] = ("held", None)
        else:
            found = [(said[i, j][0] != "merge", -said[i, j][1], j > 99, j) for j in [1, 2, *made] if said[i, j][0] != "create"]
            if found:
                review, _, new, j = min(found)
                want[i] = ("held" if review else "merged", f"new-{j}" if new else str(j))
            else:
                want[i] = ("created", f"new-{i}")
                made.append(i)
    assert got == want and {a for a, _ in want.values()} == {"updated", "held", "merged", "created"}


OFFER = "product_id long, store string, url string, price double"


def test_union_is_idempotent_and_keeps_urls_once(spark):
    live = spark.createDataFrame([(1, "a", "u1", 5.0), (2, "b", "u2", 6.0)], OFFER)
    candidate = spark.createDataFrame([(1, "a", "u1", 4.0), (1, "a", "u3", 4.0), (9, "b", "u2", 1.0), (9, "b", "u4", 1.0), (7, "c", "u5", None)], OFFER)
    once = P.union_offers(live, candidate)
    assert sorted((r.product_id, r.url) for r in once.collect()) == [(1, "u1"), (1, "u3"), (2, "u2"), (2, "u4"), (7, "u5")]
    assert P.union_offers(once, candidate).exceptAll(once).count() == 0


def test_purge_and_merge(spark):
    o = spark.createDataFrame([(1, "Shop A", "https://a.example/1", 5.0), (1, "b", "https://b.example/1", 6.0), (2, None, None, 7.0), (2, "b", "https://b.example/1", 3.0)], OFFER)
    assert P.purge(o, ["shop a"], []).count() == 3 and P.purge(o, [], ["B.example"]).count() == 2
    merged = P.merge_rows(o, spark.createDataFrame([(2, 1)], "product_id long, into long"))
    assert sorted((r.product_id, r.price) for r in merged.collect()) == [(1, 3.0), (1, 5.0), (1, 7.0)]
    assert P.merge_rows(o, spark.createDataFrame([], "product_id long, into long")).count() == o.count()
    assert merged.where(F.col("product_id") == 2).count() == 0
