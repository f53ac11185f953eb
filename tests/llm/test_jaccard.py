import numpy as np
from helpers import clashing, corpus, edited, frame, prose, words

import random
import re

from shelfwise.llm import jaccard
from shelfwise.llm.runcounts import RunCounts


def brute(rows):
    """(id, set size, component) by comparing all pairs; ids may repeat or be null."""
    sets = []
    for _, text, *_ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = []
    for a, row in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((row[0], len(sets[a]), (min(ids) if ids else None) if sets[a] else row[0]))
    return sorted(out, key=str)


def run(df, **more):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df, **more).collect()], key=str)


def test_against_all_pairs(spark):
    assert run(clashing(frame(spark))) == brute(corpus())


def test_a_dense_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(9)
    base, rows = prose(rng, 150), []
    for i in range(120):
        rows.append((i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 9])), "en", "s", 0))
    rows += [(1000 + i, prose(rng, 30) + " " + base[:300], "en", "s", 0) for i in range(20)]
    rng.shuffle(rows)
    want = brute(rows)
    for rounds in (0, 2):  # the last round alone must find all links
        assert run(frame(spark, rows), star_rounds=rounds) == want
    monkeypatch.setattr(jaccard, "LONG_LIST", 7)  # lists dealt over tasks
    monkeypatch.setattr(jaccard, "SENT_LABELS", 0)  # and components too
    assert run(frame(spark, rows), star_rounds=1) == want


def test_empty_tables(spark):
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [(1, None, None, None, None), (2, " ", None, None, None)])) == [(1, 0, 1), (2, 0, 2)]


def test_listed_prefixes_share_enough():
    for x in [*range(1, 400), 999, 1000, 5001]:
        y = np.arange(-(-4 * x // 5), 5 * x // 4 + 1)
        n = np.full(len(y), x)
        o = -(-4 * (n + y) // 9)
        can = o <= np.minimum(n, y)
        shared = np.minimum(jaccard.prefix_lengths(n) - (n - o), jaccard.prefix_lengths(y) - (y - o))[can]
        assert not len(shared) or shared.min() >= jaccard.largest_level(np.array([x]))[0]


def test_levels_follow_cost():
    first = np.array([0, 100, 200])
    token = np.arange(200, dtype=np.uint64) << np.uint64(46)
    counts = RunCounts(200, 250.0, np.where(np.arange(1 << 18) < 100, 0, 1).astype(np.uint8))
    level = jaccard.levels_of(token, first, counts)
    assert set(level) <= {1, 2, 4, 8, 16} and level[0] > 1
