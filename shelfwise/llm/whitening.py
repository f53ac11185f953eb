"""Whitening of embeddings by a one-sided Jacobi SVD.

An entry c becomes the integer floor(256 * c). The fit list is each distinct integer vector
once. Its sums are exact, so rows can be centred exactly. Centred rows are compressed to R by
a blockwise TSQR: each task takes the QR of its R so far on top of its next block, and the Rs
of tasks are put together in three rounds of groups, to one of d x d for d dimensions. Plane
rotations then make the columns of R orthogonal (one-sided Jacobi, disjoint pairs at a time).
The columns' norms are the standard deviations times sqrt(n), small ones as accurate as large
ones since no square of the data is ever formed, and the accumulated rotations are the components.

What is collected is one row for each dimension and for each component, so memory follows the
dimensions (d x d numbers in a task) and not the rows. Blocks have BLOCK_VALUES numbers.

Vectors that are null or hold a null, NaN or infinite entry give no rows. Where lengths differ,
a shorter vector is one with zeros behind it; an empty vector is all zeros. Equal vectors are
one of the fit list, and each row of theirs is returned. Integers beyond 64 bits are their nearest.
deviation is null where it is beyond 64 bits. A component without deviation (as with one
vector, or with fewer different vectors than dimensions) has null whitened; explained is null if nothing
deviates. Components of equal deviation may be any of their plane. An empty table, or one without
vectors to keep, gives no rows. Only the key and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.state import checkpointed

#: Steps of an entry that are told apart, to 1.
STEPS = 256
COMPONENTS = 4
#: Numbers of a block, at most (one row at least).
BLOCK_VALUES = 1 << 20
#: Groups in which Rs are put together, round by round.
ROUNDS = (256, 16, 1)
#: Two columns are orthogonal if their cosine is at most this; rotations go on for so many sweeps at most.
COSINE, SWEEPS = 1e-15, 60
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums (of each dimension), and the components: directions (a column for each),
    scales (their standard deviations, 0 for none), explained (their shares) and identity_error."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    scales: np.ndarray
    explained: tuple[float | None, ...]
    identity_error: float | None = None


def whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and x (integers) of the rows whose vector has finite entries only."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return rows.where(ok).select(F.col(key).alias("key"), F.transform(v, lambda c: F.floor(c * STEPS)).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows, zeros behind the short ones."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == len(column) * width:
        sizes = np.diff(column.offsets.to_numpy())
        if (sizes == width).all():
            return values.reshape(-1, width)
    out, at = np.zeros((len(column), width), np.int64), 0
    for row, v in zip(out, np.diff(column.offsets.to_numpy()).tolist(), strict=True):
        row[:v] = values[at : at + v]
        at += v
    return out


def blocks_of(batches: Iterator[pa.RecordBatch], width: int, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, BLOCK_VALUES // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, matrix(part.column(column), width)


def off_centre(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit integers where they are sure to fit, else Python's."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return off_centre(x, n, sums).astype(float) / n


def squares(y: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row, None if it takes more than 64 bits."""
    if y.dtype != object and y.shape[1] * float(np.abs(y).max(initial=0)) ** 2 < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (y.astype(object) ** 2).sum(axis=1).tolist()]


def sums_of(vectors: DataFrame, width: int) -> tuple[int, ...]:
    """The exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for _, x in blocks_of(batches, width, 0):
            half = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()  # neither can overflow
            total = [t + (a << 32) + b for t, a, b in zip(total, *half, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(map(str, total)), pa.string())], ["at", "total"])

    found = vectors.mapInArrow(run, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return tuple(int(r.total) for r in sorted(found, key=lambda r: r.at))


def upper(rows: np.ndarray, more: np.ndarray) -> np.ndarray:
    """R of some rows on top of others."""
    return np.linalg.qr(np.concatenate([rows, more]), mode="r")


def compressed(vectors: DataFrame, n: int, sums: tuple[int, ...]) -> DataFrame:
    """One row (part, r): R of all centred vectors, as bytes of doubles, by TSQR."""
    width = len(sums)

    def block_r(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for _, x in blocks_of(batches, width, 0):
            r = upper(r, centred(x, n, sums))
        if len(r):
            yield _row(TaskContext.get().partitionId(), r)

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for x in batch.column("r"):
                r = upper(r, np.frombuffer(x.as_buffer()).reshape(-1, width))
        yield _row(key[0].as_py(), r)

    rs = vectors.mapInArrow(block_r, "part long, r binary")
    for groups in ROUNDS:
        rs = rs.withColumn("part", F.col("part") % groups).groupBy("part").applyInArrow(merged, "part long, r binary")
    return rs


def _row(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["part", "r"])


def rounds_of_pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs: all but the first move on in a circle."""
    ring = np.arange(n + n % 2)
    for _ in range(len(ring) - 1):
        a, b = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
        real = np.maximum(a, b) < n
        yield np.minimum(a, b)[real], np.maximum(a, b)[real]
        ring = np.concatenate([ring[:1], np.roll(ring[1:], 1)])


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors (columns), by plane rotations."""
    b, v = np.array(r, float), np.eye(r.shape[1])
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds_of_pairs(r.shape[1]):
            x, y = b[:, p], b[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            todo = np.abs(xy) > COSINE * np.sqrt(xx) * np.sqrt(yy)
            if not todo.any():
                continue
            turned = True
            p, q, xx, yy, xy = p[todo], q[todo], xx[todo], yy[todo], xy[todo]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (b, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if not turned:
            break
    norms = np.sqrt((b * b).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order], v[:, order]


def components(r: DataFrame, n: int, width: int, count: int) -> list:
    """The first components of a compressed table: place, scale, explained (null if nothing deviates) and direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("r"):
                norms, v = jacobi(np.frombuffer(x.as_buffer()).reshape(-1, width))
                least = norms[:1].max(initial=0) * width * np.finfo(float).eps  # below: what rounding leaves of nothing
                scale = np.where(norms > least, norms, 0) / np.sqrt(n)
                trace = (norms**2).sum() / n
                k = min(count, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(k), pa.int32()), pa.array(scale[:k]), pa.array([float(s * s / trace) if trace else None for s in scale[:k]], pa.float64()), pa.array(list(v[:, :k].T), pa.list_(pa.float64()))],
                    ["place", "scale", "explained", "direction"],
                )

    return sorted(r.select("r").mapInArrow(run, "place int, scale double, explained double, direction array<double>").collect(), key=lambda c: c.place)


def projected(x: np.ndarray, w: Whitening) -> np.ndarray:
    """The whitened values of some vectors; NaN for components without deviation."""
    with np.errstate(divide="ignore", invalid="ignore"):
        z = centred(x, w.n, w.sums) @ w.directions / w.scales
    z[:, w.scales == 0] = np.nan
    return z


def distance_from_identity(vectors: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity."""
    k, width = int((w.scales > 0).sum()), len(w.sums)
    if not k:
        return None
    a, b = (i.ravel() for i in np.indices((k, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in blocks_of(batches, width, 0):
            z = projected(x, w)[:, :k]
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total.ravel())], ["a", "b", "total"])

    found = vectors.mapInArrow(run, "a int, b int, total double").groupBy("a", "b").agg(F.sum("total").alias("total")).collect()
    return max(abs(r.total / w.n - (r.a == r.b)) for r in found)


def distinct_vectors(x: DataFrame) -> DataFrame:
    """The fit list. Tasks leave out what repeats in them before anything is shuffled."""
    return checkpointed(x.select("x").distinct())


def learn(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table's vectors; None if there are none."""
    fit = distinct_vectors(whole_vectors(rows, key, vector))
    size: Column = F.size("x")
    known = fit.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most")).first()
    if not known.n:
        return None
    n, width = known.n, known.most
    if known.least < width:
        fit = distinct_vectors(fit.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - size)).alias("x")))
        n = fit.count()
    if not width:
        return Whitening(n, (), np.zeros((0, 0)), np.zeros(0), ())
    sums = sums_of(fit, width)
    found = components(compressed(fit, n, sums), n, width, count)
    w = Whitening(n, sums, np.array([c.direction for c in found]).T, np.array([c.scale for c in found]), tuple(c.explained for c in found))
    return Whitening(w.n, w.sums, w.directions, w.scales, w.explained, distance_from_identity(fit, w))


def whitened(rows: DataFrame, w: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each kept vector and component, with the columns of SCHEMA behind the key."""
    kept = whole_vectors(rows, key, vector)
    kind = kept.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.scales) if w else 0
        for part, x in blocks_of(batches, len(w.sums), 1) if k else ():
            m = part.num_rows
            deviation = squares(off_centre(x, w.n, w.sums))
            z = projected(x, w).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, w.n), pa.int64()),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                    pa.array(z, from_pandas=True),
                    pa.array(list(w.explained) * m, pa.float64()),
                    pa.array([w.identity_error] * (m * k), pa.float64()),
                ],
                ["key", *[c.split()[0] for c in SCHEMA.split(", ")]],
            )

    return kept.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first four whitened components."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitened(rows, learn(rows))
