"""Quality classifier: supervised subword embeddings.

A text's features are its words, its pairs of neighbouring words (a word said twice is one
pair, whatever the word), and the runs of 3 and 4 bytes inside words, all hashed into one table of learned vectors. The text's vector is the
mean of its features' vectors; a softmax over two classes follows. Vectors and output
weights are learned together by stochastic gradient descent in numpy. As the output is
linear before the softmax, scoring adds up one number for each feature (its vector times
the difference of the two classes' weights) instead of its whole vector.

Learning takes a bounded sample (sample_rows, those with the least hash) of the labelled ids
that are not held out; of labels that differ the greater, of an id's texts one. Every text is
scored whole. Null and empty texts have
no features and score as the bias alone. A row without an id counts as held out. Repeated
rows get equal scores. Without labels every score is 0.5. An empty table gives no rows.
A very long text is a block of its own. A score of exactly the threshold counts as good. Only the id and the text are
read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.textkit import Words, blocks, mix

BITS, DIMS = 18, 16
SAMPLE_ROWS = 6000
#: The hash of every pair of equal words, whatever the word.
DOUBLED = np.uint64(0x5851F42D4C957F2D)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of the features of some texts, one kind after the other."""
    w = Words(texts)
    if not len(w.start):
        return
    shift = np.uint64(64 - BITS)
    words = w.hashes()
    yield (words >> shift).astype(np.int32), w.doc
    two = np.where(words[:-1] == words[1:], DOUBLED, mix(words[:-1] * np.uint64(3) + words[1:]))
    same = w.doc[:-1] == w.doc[1:]
    yield (two[same] >> shift).astype(np.int32), w.doc[:-1][same]
    left = np.zeros(len(w.buf) + 1, np.int32)  # bytes from here to the end of the word
    lengths = w.end - w.start
    at = np.repeat(w.start - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    left[at] = np.repeat(w.end, lengths) - at
    doc_of = np.repeat(w.doc, lengths).astype(np.int32)
    b = w.buf.astype(np.uint32)
    code = np.zeros(len(b), np.uint32)
    code[: len(b) - 2] = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    for n, salt in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        fits = left[at] >= n
        x = code[at[fits]]
        if n == 4:
            x = x | b[at[fits] + 3] << np.uint32(24)
        x = x * np.uint32(salt)
        yield ((x ^ x >> np.uint32(15)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS)).astype(np.int32), doc_of[fits]


@dataclass
class SubwordModel:
    """What each bucket adds to the difference of the two classes' outputs, and the bias."""

    scores: np.ndarray
    bias: float


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 4, rate: float = 0.6, seed: int = 11) -> SubwordModel:
    """bags: distinct buckets of each text and how often each occurs; labels: 0 or 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS)).astype(np.float32)
    out, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    total, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, counts = bags[i]
            lr = rate * (1 - done / total)
            done += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            rows = vectors[ids]
            mean = share @ rows if len(ids) else np.zeros(DIMS, np.float32)
            o = mean @ out + bias
            p = np.exp(o - o.max())
            p /= p.sum()
            p[labels[i]] -= 1  # the gradient of the loss by the outputs
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            if len(ids):
                # a vector's own share is small: its step is by share over the largest share
                vectors[ids] = rows - lr * np.outer(share / share.max(), back)
    return SubwordModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of five."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> SubwordModel:
    """Fit on at most sample_rows labelled rows that are not held out; tasks make their features, one task fits."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    sample = known.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    # the sample is bounded by its limit, so it may be sent to every task; of an id's texts one is learned from
    found = slim.join(F.broadcast(sample), "key").select("key", F.struct("label", F.xxhash64("key", "body").alias("h"), "body").alias("row"))
    joined = found.groupBy("key").agg(F.min_by("row", "row.h").alias("row")).select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts, 1 << 20):
                kinds = list(features(texts[a:b]))
                code = np.concatenate([doc.astype(np.int64) << BITS | bucket for bucket, doc in kinds]) if kinds else np.zeros(0, np.int64)
                pairs, counts = np.unique(code, return_counts=True)
                at = np.searchsorted(pairs >> BITS, np.arange(1, b - a))
                ids, times = np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), at), np.split(counts.astype(np.int32), at)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in (0, 1)], pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["label", "h", "ids", "counts"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches, pa.schema([("label", pa.int32()), ("h", pa.int64()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))
        if not found.num_rows:
            return
        # sorted, so that it does not matter in which order tasks end
        found = found.sort_by([("label", "ascending"), ("h", "ascending")])
        lists = [found.column(c).combine_chunks() for c in ("ids", "counts")]
        cut = np.cumsum(np.asarray(lists[0].value_lengths()))[:-1]
        bags = list(zip(*[np.split(np.asarray(x.flatten(), np.int32), cut) for x in lists], strict=True))
        model = fit(bags, np.asarray(found.column("label"), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.scores.tobytes()], pa.binary()), pa.array([model.bias])], ["scores", "bias"])

    # sample_rows bound what the one task that fits reads; the driver gets the scores alone
    fitted = joined.mapInArrow(run, "label int, h long, ids array<int>, counts array<int>").repartition(1).mapInArrow(train, "scores binary, bias double").collect()
    for row in fitted:
        return SubwordModel(np.frombuffer(row["scores"], np.float32), row["bias"])
    return SubwordModel(np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model: SubwordModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (chance of class 1) of every row."""
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    kind = slim.schema["key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts, 2 << 20):
                total, count = np.zeros(b - a), np.zeros(b - a)
                for bucket, doc in features(texts[a:b]):
                    total += np.bincount(doc, weights=m.scores[bucket], minlength=b - a)
                    count += np.bincount(doc, minlength=b - a)
                p = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + m.bias, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], ["key", "score"])

    return slim.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
