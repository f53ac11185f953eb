import hashlib
import random

import pytest
from helpers import clashing, corpus, frame, prose
from pyspark.sql import functions as F

from shelfwise.llm import bpe


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(*bpe.vocabulary())


def flat(parts):
    return [i for p in parts for i in p.ids]


def test_ids_are_the_librarys(enc):
    rng = random.Random(3)
    alphabet = [*"ab Z'sd  \n\t.,!?19éñ中😀", "\u0085", "²", "ſ", "ǅ", "　", "\x1c", "\x00", "<|endoftext|>", " the", " we'll", "   "]
    for k in range(600):
        text = "".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 50, 400, 1500])))
        if k % 3:
            text = text.replace("<|endoftext|>", "")
        want = enc.library.encode(text, add_special_tokens=False).ids
        parts = enc.encode(text.encode())
        assert flat(parts) == want
        assert enc.decode(want) == enc.library.decode(want, skip_special_tokens=False) == b"".join(p.decoded for p in parts).decode()


def test_chunks_are_cut_by_content():
    rng = random.Random(4)
    shared = prose(rng, 2000).encode()
    cut = lambda t: {t[a:b] for a, b in zip([0, *bpe.cuts(t)], bpe.cuts(t), strict=False)}
    one, two = cut(prose(rng, 50).encode() + b" " + shared), cut(prose(rng, 70).encode() + b" " + shared)
    assert len(one & two) > 0.6 * min(len(one), len(two))
    text = ("é中😀 " * 900).encode()
    assert b"".join(text[a:b] for a, b in zip([0, *bpe.cuts(text)], bpe.cuts(text), strict=False)) == text
    for a, b in zip([0, *bpe.cuts(text)], bpe.cuts(text), strict=False):
        text[a:b].decode()


def test_a_full_cache_changes_nothing(enc, monkeypatch):
    text = prose(random.Random(5), 3000).encode()
    want = flat(enc.encode(text))
    monkeypatch.setattr(bpe, "CACHE_BYTES", 10)
    assert flat(enc.encode(text)) == want


def test_joins_widen_until_they_agree(enc, monkeypatch):
    """Edges with wrong ids agree with nothing: the chunks that have them are given up."""
    rng = random.Random(6)
    text = prose(rng, 4000).encode()
    want = enc.library.encode(text.decode(), add_special_tokens=False).ids
    fresh = bpe.Encoder(*bpe.vocabulary())
    real, met = fresh.chunk, []

    def spoiled(chunk):
        found = real(chunk)
        met.append(found)
        if found is None or len(met) % 4 == 0:
            return found
        ids = found.part.ids[:]
        for place, wrong in ((0, len(met) % 4 == 1), (-1, len(met) % 4 == 2)):
            if wrong:
                ids[place] ^= 1
        return found._replace(part=found.part._replace(ids=ids))

    monkeypatch.setattr(fresh, "chunk", spoiled)
    assert flat(fresh.encode(text)) == want and len(met) > 20
    monkeypatch.setattr(bpe, "SYNC", bpe.re.compile(rb"(?!)"))  # no sync points at all
    assert flat(bpe.Encoder(*bpe.vocabulary()).encode(text)) == want


def test_frames(spark, enc):
    paths = bpe.vocabulary()
    out = bpe.encode_texts(clashing(frame(spark)), *paths)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    want = []
    for i, t, *_ in corpus():
        ids = enc.library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    texts = {r.doc_id: r.decoded for r in bpe.decode_ids(out.where(F.col("doc_id") > 3), *paths).collect()}
    assert all(texts[i] == (t or "") for i, t, *_ in corpus() if i is not None and i > 3)
    assert bpe.encode_texts(frame(spark, []), *paths).count() == 0
