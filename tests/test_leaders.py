"""Greedy groups in rounds against the loop."""

import random

from pyspark.sql import functions as F

from shelfwise.functions.identity import decided, features
from shelfwise.operators import leaders as L


def loop(order, pairs):
    near = {frozenset(p) for p in pairs}
    leaders, out = [], {}
    for n in order:
        out[n] = next((g for g in leaders if frozenset((n, g)) in near), n)
        if out[n] == n:
            leaders.append(n)
    return out


def test_random_pairs(spark):
    rng = random.Random(1)
    for n, m in ((40, 30), (40, 200), (60, 61), (1, 0)):
        place = rng.sample(range(1000), n)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 61 else [(i, i + 1) for i in range(n - 1)]
        nodes = spark.createDataFrame([(i, p) for i, p in enumerate(place)], "node int, place int")
        got = dict(map(tuple, L.first_independent(nodes, spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:5]], "x int, y int")).collect()))
        assert got == loop(sorted(range(n), key=place.__getitem__), [p for p in pairs if p[0] != p[1]])
    empty = spark.createDataFrame([], "node int, place int")
    assert L.first_independent(empty, spark.createDataFrame([], "x int, y int")).count() == 0


def test_whole_decision_in_price_order(spark):
    rng = random.Random(2)
    base = [
        ("Creality K2 Plus Combo", "printer", "Creality"), ("CREALITY K2 PlusCombo 3D Yazıcı", "printer", "Creality"), ("Creality K2 Plus", "printer", "Creality"), ("Bambu Lab A1 mini", "printer", "Bambu Lab"), ("BambuLab A1 Mini Combo", "printer", "Bambu"),
        ("eSUN PLA Plus Black 1000 gr 1,75mm", "filament", "Esun"), ("PLA+ Siyah 1 kg 1.75 mm Filament", "filament", "Esun"), ("PETG Kırmızı Filament 1kg", "filament", "Esun"), ("Esun PLA+ Siyah", "filament", "Esun"), ("", "printer", None), (None, None, None), ("Ender 3 kit", "printer", "Creality"), ("Ender 3", "printer", "Creality"),
    ]
    rows = [(i, *rng.choice(base), rng.choice([None, 5.0, 7.0, 9.0, float(i)])) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, title string, kind string, brand string, price double").repartition(3)
    pairs = df.alias("a").crossJoin(df.alias("b")).where("a.id < b.id")  # brute force of a small table
    f = lambda s: features(F.col(f"{s}.title"), F.col(f"{s}.kind"), F.col(f"{s}.brand"))
    merges = [tuple(r) for r in decided(pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), f("a").alias("p"), f("b").alias("q")), "p", "q").where("action = 'merge'").select("x", "y").collect()]
    want = loop([r[0] for r in sorted(rows, key=lambda r: (r[4] is None, r[4] or 0, r[0]))], merges)
    got = dict(map(tuple, L.led(df, F.col("price")).collect()))
    assert got == want and 5 < len(set(want.values())) < 60
