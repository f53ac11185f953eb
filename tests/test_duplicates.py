"""Duplicate groups against all pairs."""

import random

from pyspark.sql import functions as F

from shelfwise.functions.similarity import similar, title_words, words_score, words_subset
from shelfwise.functions.text import fold
from shelfwise.operators import duplicates as D
from shelfwise.operators.whole import all_conflicts, with_identity
from shelfwise.sources.dictionary import dictionary

NAMES = [
    ("Creality K2 Plus Combo", "printer", "Creality"), ("CREALITY K2 PlusCombo 3D Yazıcı", "printer", "Creality"), ("Creality K2 Plus", "printer", "Creality"), ("creality k2plus", "printer", "Creality"), ("Bambu Lab P1S", "printer", "Bambu Lab"),
    ("Bambu Lab P1S Combo", "printer", "Bambu Lab"), ("BambuLab P1S 3D Yazıcı", "printer", "Bambu"), ("Ender 3 kit", "printer", "Creality"), ("Ender 3", "printer", "Creality"), ("Enderr 3", "printer", "Creality"), ("eSUN PLA Siyah 1kg", "filament", "Esun"),
    ("Esun PLA Black 1 kg", "filament", "Esun"), ("Esun PLA Siyah 1kg makaralı", "filament", "Esun"), ("Esun PLA Kırmızı 1kg", "filament", "Esun"), ("nozzle seti", "accessory", "x"), ("Nozzle Seti", "printer", "x"), ("ab cd ef gh", None, None), ("abcd efgh", None, None), ("", "printer", None), (None, None, None),
]


def test_groups_and_blocked_pairs(spark):
    rng = random.Random(4)
    rows = [(i, *n, rng.randrange(4)) for i, n in enumerate([*NAMES, *rng.choices(NAMES, k=15)])]
    df = spark.createDataFrame(rows, "id int, name string, kind string, brand string, offers int").repartition(3)
    sides = with_identity(df, dictionary(spark)).select("id", F.when(F.coalesce("kind", F.lit("")) == "", "printer").otherwise(F.col("kind")).alias("k"), title_words(F.col("name")).alias("w"), fold(F.coalesce("name", F.lit(""))).alias("f"), "axes")
    pairs = sides.alias("x").crossJoin(sides.alias("y")).where("x.id < y.id and x.k = y.k").where(D.numbers_of(F.col("x.w.tokens")) == D.numbers_of(F.col("y.w.tokens")))  # brute force of a small table
    enough = (F.size("x.w.tokens") >= 2) & (F.size("y.w.tokens") >= 2)
    near = similar(F.col("x.f"), F.col("y.f")) | (words_score(F.col("x.w"), F.col("y.w")) >= D.NEAR) | (enough & words_subset(F.col("x.w"), F.col("y.w")))
    worded = (F.size("x.w.tokens") > 0) & (F.size("y.w.tokens") > 0)
    said = {(r.a, r.b): set(r.c) for r in pairs.where(near & worded).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), all_conflicts(F.col("x.axes"), F.col("y.axes")).alias("c")).collect()}
    folded = {r.id: r.f for r in sides.collect()}
    label = {i: i for i in folded}
    links = [p for p, c in said.items() if not c] + [(a, b) for a in folded for b in folded if a < b and folded[a] == folded[b] != ""]
    links += [(a, b) for a, b in ((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1:4] == y[1:4])]
    for _ in range(40):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    groups, blocked = D.duplicate_groups(df, dictionary(spark))
    want = {}
    for i, c in label.items():
        mine = [j for j in label if label[j] == c]
        if len(mine) > 1:
            want[i] = (max(mine, key=lambda j: (rows[j][4], -j)), len(mine), len({folded[j] for j in mine}) == 1)
    assert {r.id: (r.keeper, r.rows, r.exact) for r in groups.collect()} == want and len({v[0] for v in want.values()}) > 4
    apart = {(a, b) for (a, b), c in said.items() if c and label[a] != label[b]}
    first = {i: min(r[0] for r in rows if r[1:4] == rows[i][1:4]) for i in folded}
    assert {(r.a, r.b) for r in blocked.collect()} == {tuple(sorted((first[a], first[b]))) for a, b in apart} and len(apart) > 3
    assert all(a.count() == 0 for a in D.duplicate_groups(df.limit(0), dictionary(spark)))
