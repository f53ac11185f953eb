"""The trained pair scorer: labels, features, held-out accuracy, a saved model, the gate."""

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import identity as D
from shelfwise.operators import scoring as S
from shelfwise.plans import decisions as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark):
    pairs = P.training_pairs(spark, "/root/testdata/sf0.01").persist()
    return pairs, S.fit(pairs.where(~S.held_out(F.col("a"), F.col("b"))), steps=40)


def test_labels(spark):
    rows = [(i, "b", f"m{i % 3} x", f"m{i % 3}") for i in range(9)] + [(20, "c", "alone", "z"), (21, None, "n", "z"), (22, "b", None, "z")]
    got = S.labelled(spark.createDataFrame(rows, "k int, g string, t string, i string"), "k", "t", "g", "i", F.lit("red")).collect()
    same, other = ([r for r in got if r.label == x] for x in (1.0, 0.0))
    assert len(same) == 11 and len(other) == 6  # of a ring of three identities the last has no next one
    assert all(r.a.endswith(" red") and r.b.lower().rstrip().endswith("red") for r in got)
    assert all(r.a.split()[0] not in r.b.lower().replace("-", " ").split() for r in other)


def test_held_out_accuracy_and_saved_model(spark, trained, tmp_path):
    pairs, model = trained
    out = S.scored(pairs.where(S.held_out(F.col("a"), F.col("b"))), model).select("a", "b", "label", "probability").persist()
    seen = out.agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("probability") >= S.THRESHOLD) == (F.col("label") == 1.0)).cast("double")).alias("right"), F.count_if((F.col("probability") >= S.THRESHOLD) & (F.col("label") == 0.0)).alias("wrong")).first()
    assert seen.n > 500 and seen.right > 0.95 and seen.wrong < 0.03 * seen.n
    S.save(model, f"{tmp_path}/model")
    again = S.scored(pairs.where(S.held_out(F.col("a"), F.col("b"))), S.load(f"{tmp_path}/model"))
    key = lambda df: sorted((r.a, r.b, round(r.probability, 9)) for r in df.collect())
    assert key(again) == key(out)


def test_features_of_odd_titles(spark, trained):
    rows = spark.createDataFrame([("", ""), ("K2", "K2"), ("x " * 3000, "K2 Plus")], "a string, b string")
    got = {r.a[:5]: r for r in S.scored(rows, trained[1]).collect()}
    assert len(got) == 3 and all(0 <= r.probability <= 1 for r in got.values())
    f = {r.a[:5]: r.features for r in S.with_features(rows).collect()}
    assert all(len(v) == 2 * S.HASHES + 7 for v in f.values()) and list(f["K2"][: S.HASHES]) == [0.0] * S.HASHES and abs(sum(f["K2"][S.HASHES : 2 * S.HASHES]) - 1) < 1e-9


def test_gate(spark):
    rows = spark.createDataFrame([(0.9, False, False), (0.77, False, True), (0.77, False, False), (0.05, False, True), (0.99, True, True), (0.05, True, False)], "s double, c boolean, m boolean")
    assert [r[0] for r in rows.select(D.scorer_gate(F.col("s"), F.col("c"), F.col("m"))).collect()] == ["merge", "merge", "hold", "create", "hold", "create"]
