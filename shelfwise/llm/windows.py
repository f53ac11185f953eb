"""Substring dedup by super-k-mer partitioning of word windows.

A window is WINDOW consecutive words of one document. Its minimiser is the least of its
runs of MMER words, by how frequent the run is in all documents (rare first, see
runcounts) and then by hash; so a window holds a frequent passage's run as minimiser only
if it holds nothing rarer. Consecutive windows with one minimiser are a super-k-mer: their
words travel as one packed string to the minimiser's bucket. Equal windows have equal
minimisers, so a bucket sees all of them; there the windows are sorted by two hashes, those
that meet are compared byte by byte, and those that also start in a document with a smaller
id are found exactly. Words under such windows are removed.

Within a task, equal super-k-mers are sent once: a later one travels only if its id is
smaller than all before it, the others are known to be covered already. So a passage or a
text with very many copies sends its bucket about a row for each task, not for each copy.

Ids are integers. Null ids come after all others and are not smaller than one another; rows
with the same id are one document for the comparison (neither removes the other's words)
and are each returned. Null and empty texts have no words. An empty table gives no rows.
Very long texts are cut into windows a block at a time, and their kept words joined in one row. Only the id and the text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.runcounts import run_counts, slot
from shelfwise.llm.state import bitmap, checkpointed
from shelfwise.llm.textkit import WORD_BASE, Words, blocks, mix, powers, span_hashes, window_hashes

WINDOW, MMER = 50, 5
#: Words that travel to one bucket, about.
BUCKET_WORDS = 500_000
MARK_BITS = 23
#: Super-k-mers that a task remembers, about.
KNOWN = 500_000
LAST = 2**63 - 1

PACKED = "bucket long, ids binary, uids binary, starts binary, counts binary, body binary"
SPANS = "id long, uid long, spans array<struct<start:int,end:int>>"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, by doubling."""
    n, have = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def rolled(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """The polynomial of each run of width word hashes, from differences of prefix sums."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    up, down = powers(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def super_kmers(w: Words, heavy: np.ndarray, window: int = WINDOW, mmer: int = MMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser) of each super-k-mer of some texts."""
    runs = window_hashes(w.hashes(), mmer)
    order = heavy[slot(runs, len(heavy))].astype(np.uint64) << np.uint64(58) | runs >> np.uint64(6)
    least = sliding_min(order, window - mmer + 1)
    if not len(least):
        none = np.zeros(0, np.int64)
        return none, none, least
    whole = w.doc[: len(least)] == w.doc[window - 1 :]
    at = np.flatnonzero(whole)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (w.doc[at[1:]] != w.doc[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.concatenate([first, [len(at)]])), least[at[first]]


def _pack(bucket: np.ndarray, ids: np.ndarray, uids: np.ndarray, starts: np.ndarray, counts: np.ndarray, bodies: list[bytes] | None) -> Iterator[pa.RecordBatch]:
    """One row for each bucket of a block."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    press = zstandard.ZstdCompressor(level=3)
    rows = [(int(bucket[g[0]]), ids[g].tobytes(), uids[g].tobytes(), starts[g].astype(np.int32).tobytes(), counts[g].astype(np.int32).tobytes(), None if bodies is None else press.compress(b"\n".join([bodies[i] for i in g.tolist()]))) for g in np.split(order, cut)]
    kinds = [pa.int64(), *[pa.binary()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "ids", "uids", "starts", "counts", "body"])


def packed(rows: DataFrame, heavy: Broadcast, buckets: int) -> DataFrame:
    """Super-k-mers of rows (id, uid, body) by bucket; without a body: known to be covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least_id: dict[bytes, int] = {}  # smallest id of each super-k-mer of this task
        seen: set[tuple[int, int]] = set()  # rows of one id and text have one answer
        for batch in batches:
            fresh = []
            for i, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if row not in seen:
                    seen.add(row)
                    fresh.append(i)
            if len(seen) > KNOWN:
                seen.clear()
            batch = batch.take(pa.array(fresh, pa.int64()))
            ids, uids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in blocks(texts):
                if len(least_id) > KNOWN:
                    least_id.clear()
                w = Words([b" ".join(t.split()) for t in texts[a:b]])
                first, count, least = super_kmers(w, heavy.value)
                begin, end = w.start[first], w.end[first + count + WINDOW - 2]
                doc = w.doc[first]
                at = first - w.first[doc]
                bodies = [w.raw[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
                own = ids[a:b][doc]
                names = [hashlib.blake2b(x, digest_size=16).digest() for x in bodies]
                for name, i in zip(names, own.tolist(), strict=True):
                    if least_id.get(name, LAST) >= i:
                        least_id[name] = i
                # without a body: a smaller id has the same words
                goes = np.fromiter((least_id[x] for x in names), np.int64, len(names)) == own
                bucket = (mix(least) % np.uint64(buckets)).astype(np.int64)
                covered = ~goes
                yield from _pack(bucket[goes], own[goes], uids[a:b][doc][goes], at[goes], count[goes], [x for x, g in zip(bodies, goes.tolist(), strict=True) if g])
                yield from _pack((mix(uids[a:b][doc][covered].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), own[covered], uids[a:b][doc][covered], at[covered], count[covered], None)

    return rows.mapInArrow(run, PACKED)


def _same_bytes(w: Words, at: np.ndarray, run: np.ndarray, order: np.ndarray, edge: np.ndarray) -> bool:
    """Whether every window equals the first of its group, compared by stretches of windows."""
    head = np.empty(len(order), np.int64)
    head[order] = np.repeat(order[edge], np.diff(np.concatenate([edge, [len(order)]])))
    other = np.flatnonzero(head != np.arange(len(head)))
    if not len(other):
        return True
    to = head[other]
    new = np.ones(len(other), bool)
    new[1:] = (np.diff(other) != 1) | (np.diff(to) != 1) | (run[other[1:]] != run[other[:-1]]) | (run[to[1:]] != run[to[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(other)]]) - 1
    spans = [x.tolist() for x in (w.start[at[other[first]]], w.end[at[other[last]] + WINDOW - 1], w.start[at[to[first]]], w.end[at[to[last]] + WINDOW - 1])]
    return all(w.raw[a:b] == w.raw[c:d] for a, b, c, d in zip(*spans, strict=True))


def _named(w: Words, at: np.ndarray) -> np.ndarray:
    """A number for each window, the same for equal words only."""
    names: dict[bytes, int] = {}
    return np.array([names.setdefault(w.raw[a:b], len(names)) for a, b in zip(w.start[at].tolist(), w.end[at + WINDOW - 1].tolist(), strict=True)], np.int64)


def _covered(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word spans of one bucket that are covered by windows of smaller ids."""
    own: list[list[np.ndarray]] = [[], [], [], []]
    done: list[list[np.ndarray]] = [[], [], [], []]
    bodies: list[bytes] = []
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            to = done if row["body"] is None else own
            for out, name, kind in zip(to, ("ids", "uids", "starts", "counts"), (np.int64, np.int64, np.int32, np.int32), strict=True):
                out.append(np.frombuffer(row[name], kind))
            if row["body"] is not None:
                bodies.append(unpack.decompress(row["body"]))
    found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in done]
    spans = [(found[0], found[1], found[2], found[2] + found[3] + WINDOW - 1)]
    if bodies:
        ids, uids, starts, counts = (np.concatenate(x) for x in own)
        w = Words(b"\n".join(bodies).split(b"\n"))
        h = w.hashes()
        one, two = rolled(h, WINDOW, WORD_BASE), rolled(mix(h), WINDOW, WORD_BASE)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        run = np.repeat(np.arange(len(counts)), counts)
        at = w.first[:-1][run] + offset
        one, two, doc = one[at], two[at], ids[run]
        order = np.argsort(one, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], one[order][1:] != one[order][:-1]]))
        if (np.minimum.reduceat(two[order], edge) != np.maximum.reduceat(two[order], edge)).any() or not _same_bytes(w, at, run, order, edge):
            # different windows with an equal hash: by their words
            name = _named(w, at)
            order = np.argsort(name, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(name[order]) != 0]))
        smallest = np.empty(len(doc), np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(doc[order], edge), np.diff(np.concatenate([edge, [len(doc)]])))
        hit = np.flatnonzero(doc > smallest)
        if len(hit):
            new = np.concatenate([[True], (np.diff(hit) != 1) | (run[hit[1:]] != run[hit[:-1]])])
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:], [len(hit)]]) - 1
            r = run[hit[head]]
            spans.append((ids[r], uids[r], starts[r] + offset[hit[head]], starts[r] + offset[hit[tail]] + WINDOW))
    i, u, s, e = (np.concatenate(x) for x in zip(*spans, strict=True))
    if len(i):
        order = np.lexsort((u, i))
        i, u, s, e = i[order], u[order], s[order], e[order]
        head = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (u[1:] != u[:-1])]))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([head, [len(i)]]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["start", "end"]))
        yield pa.RecordBatch.from_arrays([pa.array(i[head]), pa.array(u[head]), lists], ["id", "uid", "spans"])


def covered_spans(rows: DataFrame) -> DataFrame:
    """id, uid and the spans of words to remove, for rows (id, uid, body) that have some."""
    counts = run_counts(rows, "body", MMER, lower=False)
    buckets = max(1, counts.total * 3 // BUCKET_WORDS)
    heavy = rows.sparkSession.sparkContext.broadcast(counts.heavy)  # of a bounded size
    found = packed(rows, heavy, buckets).groupBy("bucket").applyInArrow(_covered, SPANS)
    out = checkpointed(found.groupBy("id", "uid").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    heavy.destroy()
    return out


def _place(ids: np.ndarray, uids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64) * np.uint64(3) + uids.view(np.uint64)) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def marks_of(spans: DataFrame) -> np.ndarray:
    """2**MARK_BITS flags, set for the rows that have spans: of a fixed size, false alarms only."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield _place(batch.column(0).to_numpy(), batch.column(1).to_numpy())

    return np.unpackbits(bitmap(spans.select("id", "uid"), places, MARK_BITS)).astype(bool)


KEPT = "id long, missing boolean, n_words long, n_removed long, kept binary"


def _kept(texts: list[bytes], spans: list) -> tuple[list[int], list[int], list[bytes]]:
    words, removed, kept = [], [], []
    for text, found in zip(texts, spans, strict=True):
        parts = text.split()
        words.append(len(parts))
        if found:
            gone = np.zeros(len(parts) + 1, np.int32)
            np.add.at(gone, [s["start"] for s in found], 1)
            np.add.at(gone, [s["end"] for s in found], -1)
            stays = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            removed.append(len(parts) - len(stays))
            parts = [parts[i] for i in stays.tolist()]
        else:
            removed.append(0)
        kept.append(b" ".join(parts))
    return words, removed, kept


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """key, n_words, n_removed and kept (the words that stay, joined by a space; its SHA-256 if digest).

    Rows that have nothing to remove are finished where they are read; only the others'
    texts are shuffled to meet their spans.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text), F.col(key).isNull()).alias("uid"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"), F.col(key).isNull().alias("missing"))
    spans = covered_spans(rows.select("id", "uid", "body"))
    sent = docs.sparkSession.sparkContext.broadcast(marks_of(spans))

    def batch_of(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        words, removed, kept = _kept(part.column("body").to_pylist(), found)
        if digest:
            kept = [hashlib.sha256(x).hexdigest().encode() for x in kept]
        return pa.RecordBatch.from_arrays([part.column("id"), part.column("missing"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "missing", "n_words", "n_removed", "kept"])

    def marked(part: pa.RecordBatch) -> np.ndarray:
        return sent.value[_place(part.column("id").to_numpy(), part.column("uid").to_numpy())]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~marked(batch)))
            for i in range(0, part.num_rows, 500):
                piece = part.slice(i, 500)
                yield batch_of(piece, [None] * piece.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(batch)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                piece = batch.slice(i, 500)
                yield batch_of(piece, piece.column("spans").to_pylist())

    here = rows.mapInArrow(finish, KEPT)
    away = rows.mapInArrow(touched, "id long, uid long, body binary, missing boolean").join(spans, ["id", "uid"], "left").mapInArrow(cut, KEPT)
    return here.unionByName(away).select(F.when(~F.col("missing"), F.col("id")).alias(key), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def op5_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when repeated windows of 50 words go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
