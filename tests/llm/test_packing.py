import random
import zlib

import numpy as np
import pytest
from helpers import clashing, corpus, frame
from pyspark.sql import functions as F

from shelfwise.llm import packing
from shelfwise.llm.packing import SIZE


@pytest.fixture(scope="module")
def library():
    return packing.Vocabulary(packing.word_vocabulary()).library


def check_places(rows, size=SIZE):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= size
    return len(by)


def test_pieces_and_places(spark, library):
    rows = [*corpus(), (500, "word " * 9000, None, None, None)]
    parts = packing.pieces(clashing(frame(spark, rows)), packing.word_vocabulary()).persist()
    got = packing.packed(parts).collect()
    want = []
    for i, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(p := ids[at : at + SIZE]), zlib.crc32(np.array(p, "<u4").tobytes()), p) for k, at in enumerate(range(0, len(ids), SIZE))]
    key = lambda x: (x[0] is not None, x)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)
    n = check_places(got)
    assert n == -(-sum(r.length for r in got) // SIZE)
    made = {r.sequence_id: r.ids for r in packing.sequences(packing.packed(parts)).collect()}
    assert len(made) == n and max(len(x) for x in made.values()) <= SIZE
    assert sum(list(x).count(0) for x in made.values()) == len(rows)  # the vocabulary gives 0 for "!" only
    assert packing.packed(packing.pieces(frame(spark, []), packing.word_vocabulary())).count() == 0


def test_words_have_the_librarys_ids(library, monkeypatch):
    rng = random.Random(1)
    letters = "aZé ß\t\n\x1c\x85 ΣςİIıé̈中😀'sll19٣_-.,\x00ẞǅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcXYZéÉÿŒ019.,!?-()' ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["x <|endoftext|> y<|startoftext|>z <|EndOfText|>", "<|endof text|>", "́ a", "ὈΔΥΣΣΕΎΣ ΟΔΟΣ Σ", "é" * 500, ""]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]

    def check():
        voc = packing.Vocabulary(packing.word_vocabulary())
        for a in range(0, len(texts), 700):
            part = [t.encode() for t in texts[a : a + 700]]
            ids, bounds = voc.encode(part)
            assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == want[a : a + 700]

    check()
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    check()
    real = packing.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda *a: real(*a) % np.uint64(97))  # most words share a hash with others
    check()


def test_bins_against_plain_best_fit():
    rng = random.Random(2)
    for most in (1, 3, 1000):
        bins, plain, closed = packing.Bins(50, most), {}, 0
        for n in [rng.randrange(1, 51) for _ in range(2000)]:
            b, offset = bins.put(n)
            fits = [f for f in plain.values() if f >= n]
            if fits:
                assert plain[b] == min(fits) and offset == 50 - plain[b]
            else:
                if len(plain) == most:
                    full = min(plain.values())
                    open_ = {x for at in bins.at for x in at} | {b}
                    gone = [x for x in plain if x not in open_]
                    assert len(gone) == 1 and plain.pop(gone[0]) == full
                    closed += 1
                assert b not in plain and offset == 0
            plain[b] = 50 - offset - n
            if not plain[b]:
                del plain[b]
            assert len(plain) <= most
        assert (closed > 0) == (most < 1000)


def test_few_sequences_in_many_groups(spark):
    rng = random.Random(3)
    lengths = [rng.choice([5, 40, 300, 700, 1100, 2048, rng.randrange(1, 2049)]) for _ in range(9000)]
    parts = spark.createDataFrame(list(enumerate(lengths)), "id long, length long").withColumn("offset_", F.lit(1))
    free = []
    for n in sorted(lengths, reverse=True):  # best fit, largest first, of all pieces at once
        fits = [f for f in free if f >= n]
        free.append((min(fits) if fits else SIZE) - n)
        if fits:
            free.remove(min(fits))
    for tokens in (1 << 30, 1 << 18):
        groups = -(-sum(lengths) // tokens)
        assert 0 <= check_places(packing.packed(parts, group_tokens=tokens).collect()) - len(free) <= (groups if groups > 1 else 0)
