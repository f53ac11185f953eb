import random

import numpy as np
import pytest
from helpers import clashing

from shelfwise.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(seed=1, n=400, d=7):
    """Vectors of unlike spread, with repeats (one holds a third of all rows), nulls and what has no number."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ (np.diag(np.logspace(0, -1.5, d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]) + rng.normal(size=d)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(base.astype(np.float32))]
    rows += [(1000 + i, rows[0][1], 2) for i in range(n // 2)] + [rows[5], (None, rows[6][1], None)]
    rows += [(-1, None, 1), (-2, [None, *rows[0][1][1:]], 1), (-3, [float("nan"), *rows[0][1][1:]], 1), (-4, [*rows[0][1][1:], float("-inf")], 1)]
    random.Random(seed).shuffle(rows)
    return rows


def expected(rows, width=None):
    """By the eigenvectors of the covariance."""
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = width or max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (width - len(v)) for _, v in kept], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), fit.sum(axis=0)
    c = (fit * n - sums).astype(float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    z = (x * n - sums).astype(float) / n @ v
    return kept, n, ((x * n - sums) ** 2).sum(axis=1), z, e


def compare(got, rows, comps, usable=None):
    kept, n, deviation, z, e = expected(rows)
    usable = comps if usable is None else usable
    assert len(got) == len(kept) * comps
    for k in range(comps):
        mine = sorted(((r.vec_id is not None, r.vec_id, r.deviation, r.whitened) for r in got if r.component == k + 1), key=str)
        want = sorted([(i is not None, i, d, x) for (i, _), d, x in zip(kept, deviation, z[:, k], strict=True)], key=str)
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        if k < usable:
            a, b = np.array([m[3] for m in mine]), np.array([w[3] for w in want]) / np.sqrt(e[k])
            # rows with equal keys may be in another order, but hold the same value
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        else:
            assert {m[3] for m in mine} == {None}
    for r in got:
        assert r.n == n and (r.component > usable or abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9) and (not usable or r.identity_error < 1e-9)


def run(spark, rows, **more):
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    return whitening.whitened(df, whitening.learn(df, **more)).collect()


def test_against_eigenvectors(spark, monkeypatch):
    compare(run(spark, table()), table(), 4)
    monkeypatch.setattr(whitening, "BLOCK_VALUES", 40)  # many blocks
    compare(run(spark, table(2), count=7), table(2), 7)


def test_few_dimensions_rank_and_lengths(spark):
    flat = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)]
    compare(run(spark, flat), flat, 3, usable=1)
    one = [(i, [1.0, 2.0], 0) for i in range(3)]
    got = run(spark, one)
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, None, None)] * 6
    ragged = [(0, [1.0, 2.0, -1.0], 0), (1, [3.0, 1.0], 0), (2, [], 0), (3, [0.5], 0), (4, [2.0, 2.0, 2.0], 0), (5, [0.5, 0.0, 0.0], 0)]
    compare(run(spark, ragged), ragged, 3)
    assert run(spark, [(1, [], 0)]) == [] and run(spark, []) == [] and run(spark, [(1, None, 0)]) == []


def test_exact_far_from_zero(spark):
    far = [(i, [3e12 + 2e6 * i, 1.0 * (i * i % 7), -5e11], 0) for i in range(40)]
    got = run(spark, far)
    _, _, deviation, _, _ = expected(far)
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}
    huge = run(spark, [(0, [3e38, 1.0], 0), (1, [-3e38, 1.0], 0), (2, [0.0, 2.0], 0)])
    assert len(huge) == 6 and [r.deviation for r in huge].count(None) == 4


def test_rotations_against_lapack():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        r = np.linalg.qr(rng.normal(size=(60, n)) * np.logspace(0, -12, n), mode="r")
        norms, v = whitening.jacobi(r)
        s = np.linalg.svd(r, compute_uv=False)
        assert np.abs(norms / s - 1).max() < 1e-3 and np.abs(v.T @ v - np.eye(n)).max() < 1e-13
        assert norms[:1] == pytest.approx(s[:1], rel=1e-13)
    pairs = [tuple(sorted(p)) for n in (7, 8) for a, b in whitening.rounds_of_pairs(n) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(pairs) == len(set(pairs)) + 21 == 21 + 28
