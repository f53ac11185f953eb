"""Dictionary scans against a plain loop over all phrases, and the dictionary itself."""

import random

from pyspark.sql import functions as F

from shelfwise.operators import scans
from shelfwise.sources.dictionary import ALIASES, LONGEST, dictionary


def slow(title, phrases):
    """Every phrase in turn, longest first, cut out of the text wherever it stands."""
    hay, found = f" {title} ", []
    for phrase, id_ in sorted(phrases, key=lambda p: (-len(p[0]), p[0])):
        if f" {phrase} " in hay:
            found.append((phrase, id_))
            hay = " ".join(hay.split(f" {phrase} "))
    return found


def test_dictionary():
    by_role = {role: [a for a in ALIASES if a[1] == role] for role in ("brand", "model", "feeder")}
    assert len(by_role["model"]) > 180 and len({(a, of) for a, role, _, of in ALIASES if role == "model"}) == len(by_role["model"])
    assert LONGEST == 4 and ("k2 plus", "model", "k2-plus", "creality") in ALIASES and ("falcon", "model", "falcon", "creality") not in ALIASES
    assert ("a350", "model", "snapmaker-2-a350", "snapmaker") in ALIASES and ("ams 2 pro", "feeder", "ams-2-pro", "bambu") in ALIASES


def test_consuming_scan_against_all_phrases(spark):
    rng = random.Random(3)
    words = ["k2", "plus", "pro", "se", "ender", "3", "v3", "5", "max", "x", "hi", "combo", "falcon2", "s", "k1"]
    mine = [(a, i) for a, role, i, of in ALIASES if role == "model" and of == "creality"]
    trie = scans.Trie(mine)
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    for t in titles:
        assert scans.consume(t.split(), trie) == slow(t, mine), t
    rows = [(i, rng.choice(["creality", "bambu", None, "none"]), t) for i, t in enumerate(titles[:200])] + [(500, "creality", None), (500, "creality", "K2 Plüs, K2+Pro")]
    df = spark.createDataFrame(rows, "id int, brand string, title string").withColumn("alias", F.lit("x")).withColumn("key", F.lit("y"))
    small = scans.model_cores(df, "id", "title", "brand", dictionary(spark))
    joined = scans.model_cores(df, "id", "title", "brand", dictionary(spark), most=3)
    a, b = (sorted(map(tuple, d.collect()), key=repr) for d in (small, joined))
    assert a == b and len(a) == len(rows)
    by_id = {r.id: r for r in small.where("id < 500").collect()}
    for i, brand, t in rows[:200]:
        own = [(x, y) for x, role, y, of in ALIASES if role == "model" and of == brand]
        assert by_id[i].cores == list(dict.fromkeys(y for _, y in slow(t, own)))
    assert scans.model_cores(df.limit(0), "id", "title", "brand", dictionary(spark)).count() == 0
    assert {tuple(r.cores) for r in scans.model_cores(df, "id", "title", "brand", dictionary(spark).limit(0)).collect()} == {()}


def test_one_phrase_for_all_scopes(spark):
    df = spark.createDataFrame([(1, "big red gear box"), (2, "gear")], "id int, name string")
    d = spark.createDataFrame([("red gear", "a"), ("gear", "b"), ("big box", "c")], "alias string, id string")
    got = {r.id: r.ids for r in scans.phrases_in(df, "id", "name", d).collect()}
    assert got == {1: ["a", "c"], 2: ["b"]}


def test_translation(spark):
    df = spark.createDataFrame([("Tekerlek takımı",), ("küçük  dişli kutu",), (None,)], "name string")
    got = [r.name for r in scans.translated(df, "name", {"Tekerlek takımı": "Wheel set"}, [("küçük", "small"), ("dişli", "gear"), ("", "x")]).collect()]
    assert got == ["Wheel set", "small gear kutu", None]
