import hashlib
import zlib

import numpy as np
from helpers import clashing, corpus, frame

from shelfwise.llm import media


def test_round_trip_and_figures(spark):
    got = {}
    for r in media.media_columns(clashing(frame(spark))).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in corpus():
        body = (text or "").encode()
        payload = body + b" " * (-len(body) % 192 if body else 192)
        for r in [x for x in got[i] if x.n_bytes == len(body)]:
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert r.media_bytes == len(media.to_wav(payload)) and media.from_wav(media.to_wav(payload)) == payload
            assert len(r.pairs) == len(r.frames) and list(r.frames) == sorted(r.frames)
    assert sum(map(len, got.values())) == len(corpus())
    assert media.media_columns(frame(spark, [])).count() == 0


def test_peaks_of_a_tone_and_of_blocks(monkeypatch):
    tone = (128 + 100 * np.sin(2 * np.pi * 20 / media.FRAME * np.arange(40_000))).astype(np.uint8)
    tone[:10_000] = 128
    _, bins = media.peaks(tone)
    assert np.mean(np.abs(bins[bins >= 17][bins[bins >= 17] < 33] - 20) <= 1) > 0.9
    noise = np.random.default_rng(1).integers(0, 256, 50_000, dtype=np.uint8)
    whole = media.fingerprint(noise)
    monkeypatch.setattr(media, "BLOCK_FRAMES", 7)
    assert all((a == b).all() for a, b in zip(whole, media.fingerprint(noise), strict=True))


def test_a_shared_passage_shares_pairs():
    rng = np.random.default_rng(2)
    passage, noise = rng.integers(97, 123, 128 * 60, dtype=np.uint8), [rng.integers(97, 123, 128 * 40, dtype=np.uint8) for _ in range(3)]
    one, two, other = (set(media.fingerprint(x)[0].tolist()) for x in (np.concatenate([noise[0], passage]), np.concatenate([noise[1], passage]), noise[2]))
    assert len(one & two) > 3 * len(one & other)
