import numpy as np
from pyspark.sql import functions as F

from shelfwise.functions.filament import classify
from shelfwise.functions.images import grey_hashes, sniff
from shelfwise.functions.similarity import hamming, hash_bits


def test_hashes(spark):
    rng = np.random.default_rng(1)
    one = rng.integers(0, 256, 1024)
    rows = [(1, one.tolist()), (2, np.clip(one + rng.integers(-3, 4, 1024), 0, 255).tolist()), (3, rng.integers(0, 256, 1024).tolist()), (4, [1, 2]), (5, None), (6, [7] * 1024)]
    got = {r.id: r.h for r in spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in rows], "id int, x array<double>").select("id", grey_hashes("x").alias("h")).collect()}
    means = one.reshape(8, 4, 8, 4).mean(axis=(1, 3)).reshape(-1)
    bits = "".join(str(int(v > np.sort(means)[32])) for v in means)
    assert got[1].a == f"{int(bits, 2):016x}"
    assert got[4].p is None and got[5].p is None and got[6].a == "0" * 16
    df = spark.createDataFrame([(got[1].p, got[2].p, got[3].p)], "a string, b string, c string")
    near, far = df.select(hamming(hash_bits(F.col("a")), hash_bits(F.col("b"))), hamming(hash_bits(F.col("a")), hash_bits(F.col("c")))).first()
    assert near < 8 < far


def test_sniff(spark):
    kinds = {b"\x89PNG" + b"\0" * 9: "image/png", b"\xff\xd8" + b"\0" * 12: "image/jpeg", b"GIF89a" + b"\0" * 9: "image/gif", b"RIFF\0\0\0\0WEBP": "image/webp", b"\0\0\0\0ftypavif": "image/avif", b"short": "", b"plain text bytes": ""}
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(kinds)], "i int, b binary")
    assert [r[0] for r in rows.orderBy("i").select(sniff(F.col("b"))).collect()] == list(kinds.values())


def test_classify(spark):
    cases = {"PLA+ Siyah 1 kg": ("pla", "plus", "black", "1000", "175"), "PA-CF 2,85 mm": ("pa", "cf", "", "", "285"), "İpek PLA": ("pla", "silk", "", "", "175"), "unknown": ("other", "standard", "", "", "175"), "PLABS basic": ("plabs", "basic", "", "", "175")}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [(r.polymer, r.subtype, r.color, r.weight, r.diameter) for r in rows.orderBy("i").select(classify(F.col("t")).alias("c")).select("c.*").collect()] == list(cases.values())
