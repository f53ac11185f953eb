"""Near pictures against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from shelfwise.functions.images import _hex
from shelfwise.operators import pictures as V


def far(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def table(seed, n):
    rng, base = random.Random(seed), random.Random(9)
    base = [base.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    rows = []
    for i in range(n):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.choice([0, 0, 1, 5, 9, 10, 11, 14])):
            h ^= 1 << b
        rows.append((i, rng.choice("xy"), f"{h:016x}"))
    return rows + [(n, "x", None), (n + 1, "x", "xyz"), (n + 2, "y", "ABCDEF0123456789")]


def test_all_pairs_within_a_distance(spark):
    a, b = table(1, 120), table(2, 150)
    left, right = (spark.createDataFrame(r, "id int, g string, hash string").repartition(3) for r in (a, b))
    ok = lambda h: h is not None and len(h) == 16 and h == h.lower()
    for most in (0, 3, 6, 10, 13):
        want = {(x, y, far(x, y)) for _, _, x in a for _, _, y in b if ok(x) and ok(y) and far(x, y) <= most}
        assert set(map(tuple, V.near_hashes(left, right, most).collect())) == want and (most == 0 or len(want) > 50)
    want = []
    for i, g, x in a:
        near = sorted((far(x, y), j) for j, g2, y in b if ok(x) and ok(y) and g == g2 and i != j and far(x, y) <= 10)[:3]
        want += [(g, i, j, d, k + 1) for k, (d, j) in enumerate(near)]
    assert sorted(map(tuple, V.near_pictures(left, right, within=["g"]).collect())) == sorted(want)
    assert V.near_pictures(left.limit(0), right).count() == 0


def test_blocks_can_lose_no_pair():
    for most in range(0, 20):
        r = V.radii(most)
        assert sum(x + 1 for x in r) == most + 1 or most + 1 < V.PARTS  # blocks that all differ by more differ by more than most together
        assert sum(x + 1 for x in r) > most
    assert len(V.masks(2)) == 1 + 16 + 120


def test_hash_of_values(spark):
    rng = np.random.default_rng(4)
    values = [rng.normal(size=64).tolist() for _ in range(5)] + [[1.0] * 64]
    got = [r.h for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>").orderBy("i").select(V.median_hash(F.col("v")).alias("h")).collect()]
    assert got == _hex(np.array(values))
    assert spark.createDataFrame([([1.0],), (None,)], "v array<double>").select(V.median_hash(F.col("v"))).collect() == [(None,), (None,)]
