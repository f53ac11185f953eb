"""Which tokens op3 goes on with: those of two different texts, copies of one text count once."""

import numpy as np

from shelfwise.llm import jaccard


def _text(k: int, odd: str = "") -> str:
    return " ".join(f"w{k}x{i}" for i in range(60)) + odd


def test_copies_of_one_text_have_no_live_tokens(spark, monkeypatch):
    lives = []
    plain = jaccard.live_tokens
    monkeypatch.setattr(jaccard, "live_tokens", lambda *a: lives.append(plain(*a)) or lives[-1])
    docs = spark.createDataFrame([(10 * k + c, _text(k)) for k in range(20) for c in range(6)], "doc_id long, text string").repartition(7)
    found = jaccard.components(docs).collect()
    assert all(r.component_id == r.doc_id // 10 * 10 for r in found) and len(found) == 120
    assert not lives[0].any()


def test_one_row_of_each_text_keeps_its_links(spark):
    near = _text(1, " tail")
    rows = [(5, _text(1)), (5, _text(1)), (None, _text(1)), (None, near), (None, near), (9, near), (3, near), (None, _text(2)), (None, _text(2)), (None, _text(2, " tail")), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = sorted(((r.doc_id, r.component_id) for r in jaccard.components(docs).collect()), key=str)
    assert found == sorted([(5, 3), (5, 3), (None, 3), (None, 3), (None, 3), (9, 3), (3, 3), (None, None), (None, None), (None, None), (7, 7), (8, 8)], key=str)


def test_sorted_tokens_packed_as_steps_come_back():
    rng = np.random.default_rng(4)
    for token in (np.zeros(0, np.uint32), np.array([0, 0, 7, 2**32 - 1], np.uint32), np.sort(rng.integers(0, 2**32, 5000).astype(np.uint32))):
        assert (jaccard._summed(np.ascontiguousarray(jaccard._steps(token)).tobytes()) == token).all()


def test_live_tokens_are_found_and_few_others_are():
    rng = np.random.default_rng(5)
    bits, live, other = 20, rng.integers(0, 2**64, 40_000, np.uint64), rng.integers(0, 2**64, 100_000, np.uint64)
    table = np.zeros((jaccard.LIVE_SLICES, (1 << bits) // jaccard.LIVE_SLICES), bool)
    for at in jaccard._live_places((live >> np.uint64(24)).astype(np.uint32), bits):
        table[(live >> np.uint64(56)).astype(np.int64), at] = True
    packed = np.packbits(table.reshape(-1))
    assert jaccard._are_live(live, packed).all()
    assert jaccard._are_live(other, packed).mean() < 0.01
