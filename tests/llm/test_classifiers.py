import random
import zlib

import numpy as np
from helpers import clashing, frame, prose

from shelfwise.llm import quality, toxicity

BAD = ["zorg", "blarg", "fnord"]


def toxic_rows():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        text = prose(rng, 40).split(" ")
        if bad:
            for _ in range(3 if i % 2 else 6):
                text[rng.randrange(len(text))] = rng.choice(BAD) + rng.choice(["", "ly", "est"])
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, i % 2, int(bad)))
    return rows + [(300, None, None, None, None), (301, "", None, None, None), (None, "zorg blarg fnord zorgly blargly fnordest " * 900, None, None, None), rows[0]], labels


def test_severity_is_learned_and_ordered(spark):
    rows, labels = toxic_rows()
    docs, known = clashing(frame(spark, rows)), spark.createDataFrame(labels + [(None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, toxicity.graded(known))
    assert (np.diff(model.thresholds) >= 0).all()
    out = toxicity.score(docs, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    truth = {i: t for i, _, t in labels}
    assert np.mean([by[i].toxic == t for i, t in truth.items()]) > 0.97
    assert all(abs(r.severity - r.p_toxic - r.p_severe) < 1e-9 and r.p_toxic >= r.p_severe for r in out)
    assert by[300].severity == by[301].severity and by[None].toxic == 1
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(r.toxic == 0 for r in out)


def test_no_labels_and_empty_tables(spark):
    docs = frame(spark, [(1, "a b", "en", "s", 3)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, toxicity.graded(none))
    assert not model.weights.any() and toxicity.score(frame(spark, []), model).count() == 0
    flat = quality.learn(docs, none)
    assert quality.score(docs, flat).first().score == 0.5 and quality.score(frame(spark, []), flat).count() == 0


def test_quality_on_held_out_rows(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = prose(rng, 30) if good else " ".join(w + "###" for w in prose(rng, 30).split()) if rng.random() < 0.5 else (prose(rng, 1) + " ") * 25
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(good), 0))
    rows += [(400, None, None, None, None), (401, "", None, None, None), rows[3], (None, "x", None, None, None)]
    clashing(frame(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.op9_subword_quality(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
