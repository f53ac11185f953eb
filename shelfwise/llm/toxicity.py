"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A text's features are the hashed words that occur in it (letters and digits, lowered) and
the words' beginnings of PREFIXES bytes, so that a stem is known with endings that no
labelled text has. One weight vector w is shared by all thresholds: P(grade <= k) =
sigmoid(theta_k - w.x) with theta_0 <= theta_1 <= ...; the fit is penalised by the sum of
absolute weights, so few features keep one. A score gives the expected grade (severity),
the chance of each grade being passed, and the likelier side of the first threshold (toxic).

The model is fitted on a bounded sample of labelled ids (sample_rows, those with the
least hash; of labels that differ the greater, of an id's texts one); every text is scored whole. Null and empty texts have no features
and get the thresholds' own chances. Rows without an id are scored and never learned
from; repeated rows get equal scores. Without labels every weight is zero
and no text is toxic. A very long text is
a block of its own; a chance of exactly one half counts as toxic. An empty table
gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.textkit import Words, blocks, lanes_of, lowered, mix, span_hashes

BITS = 20
SAMPLE_ROWS = 8000
PREFIXES = (4, 5, 6)
#: Standard errors by which a feature's share must differ to enter the fit.
SCREEN = 3.0

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and beginning of the texts, repeats included."""
    w = Words(texts, _NOT_WORD)
    low = lowered(w.raw)
    lanes = lanes_of(low)
    hashes, docs = [span_hashes(low, w.start, w.end, lanes)], [w.doc]
    for n in PREFIXES:
        longer = w.end - w.start > n
        start = w.start[longer]
        hashes.append(mix(span_hashes(low, start, start + n, lanes) + np.uint64(1)))
        docs.append(w.doc[longer])
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


@dataclass
class OrdinalModel:
    """Weights by bucket and the ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def passed(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold, from the texts' sums of weights."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def fit(buckets: np.ndarray, sizes: np.ndarray, grades: np.ndarray, levels: int, penalty: float = 1e-4, steps: int = 600) -> OrdinalModel:
    """Accelerated proximal gradient on the penalised likelihood.

    buckets: the distinct buckets of all texts, text by text; sizes: how many each text has;
    grades: 0 to levels - 1.
    """
    thresholds = 2.0 * np.arange(1, levels)
    weights = np.zeros(1 << BITS, np.float32)
    n = len(sizes)
    if not n:
        return OrdinalModel(weights, thresholds)
    share = np.array([(np.sum(grades <= k) + 0.5) / (n + 1) for k in range(levels - 1)])
    thresholds = np.maximum.accumulate(np.log(share / (1 - share)))
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    # screening: a feature stays if its share differs between grade 0 and the others
    df, bad = np.bincount(buckets, minlength=1 << BITS), np.bincount(buckets[(grades > 0)[row]], minlength=1 << BITS)
    n_bad, p = max(1, np.sum(grades > 0)), (df + 0.5) / (n + 1)
    apart = bad / n_bad - (df - bad) / max(1, n - n_bad)
    keep = (df >= 3) & (np.abs(apart) >= SCREEN * np.sqrt(p * (1 - p) * (1 / n_bad + 1 / max(1, n - n_bad))))
    if not keep.any():
        return OrdinalModel(weights, thresholds)
    ids = np.flatnonzero(keep)
    place = np.cumsum(keep) - 1
    used = keep[buckets]
    col, row, dims = place[buckets[used]], row[used], len(ids)
    times = lambda w: np.bincount(row, weights=w[col], minlength=n)
    back = lambda g: np.bincount(col, weights=g[row], minlength=dims)
    v = np.ones(dims)
    for _ in range(12):  # the largest curvature, by power iteration
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    step = 1 / (0.25 * top / n + 0.25)
    y = grades.astype(int)
    w = look = np.zeros(dims)
    theta = look_t = thresholds.copy()
    t = 1.0
    for _ in range(steps):
        z = times(look)
        edge = np.concatenate([[-np.inf], look_t, [np.inf]])
        with np.errstate(over="ignore"):
            up, low = 1 / (1 + np.exp(z - edge[y + 1])), 1 / (1 + np.exp(z - edge[y]))
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up), low * (1 - low)
        g = back((d_up - d_low) / p) / n
        g_t = np.array([np.sum(np.where(y == k, -d_up / p, 0) + np.where(y == k + 1, d_low / p, 0)) for k in range(levels - 1)]) / n
        new = look - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_t = np.maximum.accumulate(look_t - step * g_t + np.arange(levels - 1) * 1e-6)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_t = new + (t - 1) / t_next * (new - w), np.maximum.accumulate(new_t + (t - 1) / t_next * (new_t - theta))
        w, theta, t = new, new_t, t_next
    weights[ids] = w
    return OrdinalModel(weights, theta)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade from the two labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 1, 1).otherwise(2)
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", grade.alias("grade"))


def learn(docs: DataFrame, grades: DataFrame, levels: int = 3, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> OrdinalModel:
    """Fit on at most sample_rows labelled rows; tasks make their features, one task fits."""
    sample = grades.groupBy(F.col(key).alias("key")).agg(F.max(F.col("grade").cast("int")).alias("grade")).orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    # the sample is bounded by its limit, so it may be sent to every task; of an id's texts one is learned from
    found = slim.join(F.broadcast(sample), "key").select("key", F.struct("grade", F.xxhash64("key", "body").alias("h"), "body").alias("row"))
    joined = found.groupBy("key").agg(F.min_by("row", "row.h").alias("row")).select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                bucket, doc = word_buckets(texts[a:b])
                pairs = np.unique(doc << np.int64(BITS) | bucket)
                parts = np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(pairs >> BITS, np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in (0, 1)], pa.array(parts, pa.list_(pa.int32()))], ["grade", "h", "buckets"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches, pa.schema([("grade", pa.int32()), ("h", pa.int64()), ("buckets", pa.list_(pa.int32()))]))
        # sorted, so that it does not matter in which order tasks end
        found = found.sort_by([("grade", "ascending"), ("h", "ascending")])
        lists = found.column("buckets").combine_chunks()
        sizes = np.asarray(lists.value_lengths(), np.int64)
        model = fit(np.asarray(lists.flatten(), np.int32), sizes, np.asarray(found.column("grade"), np.int64), levels)
        ids = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, model.weights[ids], model.thresholds)], ["ids", "weights", "thresholds"])

    # sample_rows bound what the one task that fits reads; the driver gets the weights alone
    fitted = joined.mapInArrow(run, "grade int, h long, buckets array<int>").repartition(1).mapInArrow(train, "ids binary, weights binary, thresholds binary").collect()
    model = fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), levels)
    for row in fitted:  # one, or none where Spark knows that there are no labels
        model.weights[np.frombuffer(row["ids"], np.int64)] = np.frombuffer(row["weights"], np.float32)
        model.thresholds = np.frombuffer(row["thresholds"], np.float64)
    return model


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input
    rows = docs.select(F.struct("*").alias("row"))  # one column, so theirs may have any names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in pc.struct_field(batch.column(0), text).cast(pa.binary()).to_pylist()]
            clean = [chances(sent.value, texts[a:b])[:, 0] < 0.5 for a, b in blocks(texts)]
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return rows.mapInArrow(run, rows.schema).select("row.*")


def chances(model: OrdinalModel, texts: list[bytes]) -> np.ndarray:
    """P(grade > k) of some texts, a row for each."""
    bucket, doc = word_buckets(texts)
    hit = np.flatnonzero(model.weights[bucket])
    pairs = np.unique(doc[hit] << np.int64(BITS) | bucket[hit])
    return model.passed(np.bincount(pairs >> BITS, weights=model.weights[pairs & ((1 << BITS) - 1)], minlength=len(texts)))


def score(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, severity (expected grade), p_toxic, p_severe and toxic (0 or 1) of every row."""
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    kind = slim.schema["key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                p = chances(m, texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array((p[:, 0] >= 0.5).astype(np.int32))], ["key", "severity", "p_toxic", "p_severe", "toxic"])

    return slim.mapInArrow(run, f"key {kind}, severity double, p_toxic double, p_severe double, toxic int").withColumnRenamed("key", key)


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model)
