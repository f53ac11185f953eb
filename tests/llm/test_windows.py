import random

import numpy as np
import pytest
from helpers import clashing, corpus, frame, prose, words

from shelfwise.llm import windows
from shelfwise.llm.textkit import Words


def brute(rows):
    first = {}
    order = lambda i: float("inf") if i is None else i
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, float("inf")), order(i))
    out = []
    for i, text, *_ in rows:
        w, gone = words(text), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < order(i):
                gone.update(range(k, k + 50))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(df):
    return sorted([tuple(r) for r in windows.remove_repeats(df).collect()], key=str)


def test_against_brute_force(spark):
    assert run(clashing(frame(spark))) == brute(corpus())


@pytest.mark.parametrize("block", [1 << 9, 1 << 22])
def test_a_passage_in_a_third_of_all_rows(spark, monkeypatch, block):
    monkeypatch.setattr("shelfwise.llm.textkit.BLOCK_BYTES", block)
    rng = random.Random(4)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, 20) + " " + passage + " " + prose(rng, 60) if i % 3 == 0 else prose(rng, 90), "en", "s", 0) for i in range(150)]
    assert run(frame(spark, rows)) == brute(rows)


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of 2**n letters that polynomials modulo powers of two take for one another."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_long_words_that_differ(spark):
    rng = random.Random(8)
    around = prose(rng, 30), prose(rng, 30)
    rows = [(i, f"{around[0]} {w} {around[1]}", "en", "s", 0) for i, w in enumerate([*thue_morse(10), *thue_morse(12)])]
    assert run(frame(spark, rows)) == brute(rows)
    assert all(r[2] == 0 for r in run(frame(spark, rows)))


def test_windows_whose_hashes_agree(spark, monkeypatch):
    """With useless hashes the words themselves decide."""
    monkeypatch.setattr(windows, "rolled", lambda words, width, base: np.zeros(max(0, len(words) - width + 1), np.uint64))
    rng = random.Random(2)
    passage = prose(rng, 60)
    texts = [prose(rng, 70), passage + " " + prose(rng, 20), prose(rng, 5) + " " + passage]
    w = Words([t.encode() for t in texts])
    first, count, _ = windows.super_kmers(w, np.zeros(1 << 18, np.uint8))
    doc = w.doc[first]
    batches = windows._pack(np.zeros(len(first), np.int64), doc, doc, first - w.first[doc], count, [w.raw[a:b] for a, b in zip(w.start[first], w.end[first + count + 48], strict=True)])
    gone = {}
    for row in [r for b in windows._covered((0,), batches) for r in b.to_pylist()]:
        for s in row["spans"]:
            gone.setdefault(row["id"], set()).update(range(s["start"], s["end"]))
    assert {i: len(x) for i, x in gone.items()} == {2: 60}


def test_empty_table(spark):
    assert run(frame(spark, [])) == []


def test_super_kmers_hold_every_window_once():
    rng = random.Random(5)
    texts = [prose(rng, n).encode() for n in (10, 49, 50, 51, 400)] + [b"a " * 300]
    w = Words([b" ".join(t.split()) for t in texts])
    first, count, least = windows.super_kmers(w, np.zeros(1 << 18, np.uint8))
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count, strict=True)])
    want = np.concatenate([np.arange(s, s + max(0, n - 49)) for s, n in zip(w.first[:-1], w.counts, strict=True)])
    assert sorted(covered.tolist()) == want.tolist()
    assert len(first) < len(want) / 4 and len(least) == len(first)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 300)
    for width in (1, 2, 3, 7, 46, 300, 301):
        want = [x[i : i + width].min() for i in range(len(x) - width + 1)]
        assert windows.sliding_min(x, width).tolist() == want
