import zlib
from collections import Counter

import numpy as np
from helpers import clashing, corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import sharding


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
def test_a_permutation_with_an_inverse(n, seed):
    there = sharding.permute(np.arange(n), n, seed)
    assert sorted(there.tolist()) == list(range(n))
    assert (sharding.permute(there, n, seed, back=True) == np.arange(n)).all()


def test_place_and_row_at():
    for row in range(37):
        assert sharding.row_at(*sharding.place(row, 37, 5, 8), 37, 5, 8) == row


def test_shards_of_a_table(spark):
    rows = corpus()
    out = sharding.shard_rows(clashing(frame(spark)), 16).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    per = Counter(r.shard for r in out)
    assert max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert all((r.shard, r.slot) == sharding.place(r.row_number, len(rows), 16, 20240229) for r in out)
    again = sharding.shard_rows(frame(spark).repartition(7), 16).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, out), key=str) == sorted(map(key, again), key=str)


def test_one_row_many_times_and_none(spark):
    same = frame(spark, [(1, "x", "en", "s", 1)] * 25_003)
    per = Counter(r.shard for r in sharding.shard_rows(same, 4).collect())
    assert sorted(per.values()) == [6250, 6251, 6251, 6251]
    assert sharding.shard_rows(frame(spark, []), 4).count() == 0
