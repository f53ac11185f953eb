"""The thin queries over a whole table, each held against its definition."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from test_licenses import brute as licenses_in

import __spark_entry__ as entry
from shelfwise.llm import bpe, media

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall())


def rows(spark, name):
    return {r.doc_id: r for r in entry.queries()[name](spark, FOLDER).collect()}


def slow_pairs(samples):
    """The fingerprint by plain loops and a plain Fourier sum."""
    n = max(1, 1 + -(-(len(samples) - media.FRAME) // media.HOP))
    x = np.zeros((n - 1) * media.HOP + media.FRAME)
    x[: len(samples)] = samples.astype(float) - 128
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME), np.arange(129)) / media.FRAME)
    power = np.stack([np.abs((x[i * media.HOP : i * media.HOP + media.FRAME] * np.hanning(media.FRAME)) @ turn) ** 2 for i in range(n)])
    best = [(power[:, a:b].argmax(axis=1) + a, power[:, a:b].max(axis=1)) for a, b in zip(media.BANDS, media.BANDS[1:])]
    peaks = sorted((t, int(at[t])) for at, top in best for t in range(n) if top[t] > top.mean() * (1 + 1e-5))
    pairs = []
    for i, (t, f) in enumerate(peaks):
        pairs += [(t, f << 16 | g << 8 | (u - t)) for u, g in peaks[i + 1 : i + 1 + media.FAN] if u - t < media.REACH]
    return sorted(pairs)


def test_media(spark, texts):
    got = rows(spark, "op2_wav_fingerprints")
    for i, t in texts.items():
        raw = t.encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
    same = tried = 0
    for t in [t for t in texts.values() if 0 < len(t) < 4000][:25]:
        code, time = media.fingerprint(np.frombuffer(media.payload_of(t.encode()), np.uint8))
        want = set(slow_pairs(np.frombuffer(media.payload_of(t.encode()), np.uint8)))
        mine = set(zip(time.tolist(), code.tolist(), strict=True))
        same, tried = same + len(mine & want), tried + len(mine | want)
    assert same >= 0.99 * tried  # single and double precision may part at a tie


def test_shards(spark, texts):
    got = rows(spark, "op4_feistel_shards")
    assert set(got) == set(texts)
    sizes = np.bincount([r.shard for r in got.values()], minlength=16)
    assert sizes.max() - sizes.min() <= 1
    for shard in range(16):
        assert sorted(r.slot for r in got.values() if r.shard == shard) == list(range(sizes[shard]))
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[i].encode()) + 1, zlib.crc32(texts[i].encode()), "rows", None) for i, r in got.items())


def test_licenses(spark, texts):
    got = {(r.doc_id, r.license) for r in entry.queries()["op8_license_bands"](spark, FOLDER).collect()}
    assert got == {(i, k) for i, t in texts.items() for k in licenses_in(t)}


def test_bpe(spark, texts):
    got, library = rows(spark, "op10_chunked_bpe"), bpe.Encoder(*bpe.vocabulary()).library
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_classifiers_and_leaks(spark, texts):
    labels = {i: (q, t) for i, q, t in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{FOLDER}/labels.parquet'").fetchall()}
    toxic = rows(spark, "op6_ordinal_toxicity")
    assert set(toxic) == set(texts) and all(0 <= r.p_severe <= r.p_toxic <= 1 and abs(r.severity - r.p_toxic - r.p_severe) < 1e-9 for r in toxic.values())
    assert np.mean([toxic[i].toxic == t for i, (_, t) in labels.items()]) > 0.9
    good = rows(spark, "op9_subword_quality")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in good.items())
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall())
    leaks = {(r.doc_id, r.item_id) for r in entry.queries()["op7_template_decontamination"](spark, FOLDER).collect()}
    plain = {(i, k) for i, t in texts.items() for k, item in items.items() if item in t}
    assert plain <= leaks and all(i in texts and k in items for i, k in leaks)
