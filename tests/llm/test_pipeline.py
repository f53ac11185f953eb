import random

from helpers import SCHEMA, frame, prose
from test_bpe import flat
from test_secrets import spans

import corpus_pipeline
from shelfwise.llm import bpe


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    item = prose(rng, 30) + "."
    rows = [(i, prose(rng, 60), "en", "s", 1) for i in range(150)]
    labels = [(i, 1, 0) for i in range(150)]
    for i in range(150, 180):
        rows.append((i, prose(rng, 20) + " zorg blarg " + prose(rng, 20), "en", "s", 1))
        labels.append((i, i % 2, 1))
    rows += [(200, rows[7][1], "en", "s", 1), (201, rows[8][1] + " end", "en", "s", 1), (202, prose(rng, 9) + " " + item + " " + prose(rng, 9), "en", "s", 1)]
    rows += [(203, prose(rng, 30) + " token = abcdefgh " + prose(rng, 5), "en", "s", 1), (204, None, None, None, None), (205, "", "en", "s", 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(150), 203, 204, 205}  # toxic, near copies and leaks are gone
    enc = bpe.Encoder(*bpe.vocabulary())
    for i, t, *_ in rows:
        if i in got:
            text, at = "", 0
            for a, _, b, _ in spans(t):
                text, at = text + t[at:a] + "[SECRET]", b
            assert got[i] == flat(enc.encode((text + (t or "")[at:]).encode()))


def test_stages_carry_columns(spark, tmp_path):
    from helpers import clashing

    docs = clashing(spark.createDataFrame([(1, "secret = abcdefg", "en", "s", 16), (2, None, None, None, None)], SCHEMA))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 2
    text = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.redact_secrets(spark, docs, str(tmp_path)).collect()}
    assert text == {1: ("[SECRET]", 8), 2: (None, None)}


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    rng = random.Random(4)
    a, b, c, d, item = (prose(rng, n) for n in (60, 60, 60, 60, 30))
    rows = [(1, a), (None, a + " end"), (None, b), (None, c), (None, c), (2, d), (2, d), (2, prose(rng, 40)), (None, prose(rng, 9) + " " + item + "."), (3, item + "."), (3, prose(rng, 50)), (None, None), (None, None)]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, a), (None, b), (None, c), (2, d), rows[7], (None, None), (None, None), *rows[8:11]], key=repr)
    spark.createDataFrame([(1, item + ".")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted([*rows[:8], *rows[10:]], key=repr)
