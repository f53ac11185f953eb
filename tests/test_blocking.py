"""Candidate pairs against all pairs."""

import random

from pyspark.sql import functions as F

from shelfwise.functions.identity import decided, features
from shelfwise.functions.similarity import similar
from shelfwise.functions.text import fold
from shelfwise.operators import identity as D
from shelfwise.operators import placement as P
from shelfwise.plans.titles import TITLES

ROW = "id long, title string, kind string, brand string"


def listings(seed: int, n: int) -> list[tuple]:
    """Listings of a brand so large that every token stands in over 50 rows, and of others."""
    rng = random.Random(seed)
    some = lambda words: rng.choice(words)
    rows = []
    for i in range(n):
        if i % 5:
            rows.append((i, f"Creality {some(['K2', 'Ender', 'Endr', 'Hi'])} {some(['', 'Plus', 'Pro'])} {some(['Combo', '', 'mini'])} {some(['hotbed', 'hotbeds', 'frame', ''])}", "printer", some(["Creality", "creality", "Crealty"])))
        else:
            rows.append((i, f"{some(['Esun', ''])} {some(['PLA', 'PETG', 'Matte'])} {some(['Siyah', 'red', ''])} {some(['1kg', '1000 gr', ''])} {some(['quality', 'qualitty', 'spool', ''])}", "filament", some(["Esun", "", None, "Bambu", "Bambu Lab"])))
    return [*rows, *[(1000 + i, t, k, b) for i, t, k, b in TITLES]]


def all_pairs(left, right):
    """What is not 'create' among all pairs of the pool, without blocking."""
    a, b = (d.select(F.col("id").alias(f"{p}_id"), F.col("title").alias(f"{p}t"), fold(F.col("brand")).alias(f"{p}f"), features(F.col("title"), F.col("kind"), F.col("brand")).alias(p)) for d, p in ((left, "l"), (right, "r")))
    known = {"bambu lab": "bambu", "bambulab": "bambu", "flash forge": "flashforge"}
    c = lambda x: F.when(F.col(x).isin(*known), F.element_at(F.create_map(*[F.lit(v) for kv in known.items() for v in kv]), F.col(x))).otherwise(F.col(x))
    glued = lambda x: F.replace(F.col(x), F.lit(" "))
    inside = (F.col("lf") != "") & F.contains(F.concat(F.lit(" "), fold(F.col("rt")), F.lit(" ")), F.concat(F.lit(" "), "lf", F.lit(" ")))
    same = (c("lf") == c("rf")) | inside | ((F.col("lf") != "") & (F.col("rf") != "") & similar(glued("lf"), glued("rf")))
    pairs = decided(a.crossJoin(b).where("l_id != r_id"), "l", "r")
    return pairs.where("action != 'create'").where(same | (F.col("score") >= D.LEAST_SCORE) | (fold(F.col("lt")) == fold(F.col("rt"))))


def test_no_pair_is_lost_in_a_large_brand(spark):
    t = spark.createDataFrame(listings(5, 300), ROW)
    want = {(r.l_id, r.r_id, r.action) for r in all_pairs(t, t).collect()}
    pairs = D.blocked_pairs(t, t).where("l_id != r_id")
    got = {(r.l_id, r.r_id, r.action) for r in D.judged(pairs, t, t).where("action != 'create'").collect()}
    assert got == want and len(want) > 2000
    assert (1003, 1004) in {(a, b) for a, b, _ in got}  # 'Bambu' and 'Bambu Lab'


def test_similar_words_meet(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(400)})
    w = spark.createDataFrame([(x,) for x in words], "node string")
    want = w.withColumnRenamed("node", "x").crossJoin(w.withColumnRenamed("node", "y")).where("x != y").where(similar(F.col("x"), F.col("y")))
    assert {tuple(r) for r in D.alike_words(w).collect()} == {tuple(r) for r in want.collect()}


def test_a_merge_in_a_large_brand_is_no_new_product(spark):
    rows = [(i, f"Creality K2 Plus frame{i:04d}x{i * 7919 % 9973:04d}", "printer", "Creality") for i in range(80)]
    catalogue = spark.createDataFrame([*rows, (900, "Creality K2 Plus", "printer", "Creality")], ROW)
    new = spark.createDataFrame([(1, "Creality K2 Plus yeni kasa rafli", "printer", "Creality", "u")], ROW + ", url string")
    got = P.place(new, catalogue, spark.createDataFrame([], "product_id long, url string")).first()
    assert (got.action, got.target) == ("merged", "900")
