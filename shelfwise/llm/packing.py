"""Best-fit packing of token sequences in bounded space.

A document is its ids and id END; one of more than SIZE ids is cut into pieces of SIZE, the last
may be shorter. Pieces are dealt evenly into groups of about GROUP_TOKENS tokens, and a task
packs each group online: pieces come largest first and go into the open bin with the least free
space that holds them, so as few sequences as can be are needed. Open bins are kept by their free space: bit f of one
integer says whether there is a bin with f tokens free, so the best bin is found by a shift and
the lowest set bit. At most OPEN bins are open; if all are and a piece fits in none, the fullest
closes. A group has fewer sequences than that, so in it best fit is not held back; the bound
keeps a task's memory fixed whatever it is given. Each group may leave one bin part empty:
SIZE of GROUP_TOKENS tokens.

The ids are those of the tokenizers library. White space never lies inside one of this
vocabulary's pre-tokens, so a text's ids are those of its words. A plain word (Latin letters, digits and
marks, none of them an apostrophe or a bar) is further cut where the vocabulary's pre-tokenizer cuts it: into runs of letters,
single digits and runs of marks, with A-Z lowered. A worker asks the library for such a part once and keeps it
(CACHE_WORDS, of which the less used half goes when they are full). Parts are found equal by a hash and then
compared byte by byte; a text with one that only shares another's hash is given to the library whole.

Nulls: null and empty texts are the one id END. Repeated rows are packed like others, as
pieces of their own; which of two equal pieces lies where doesn't matter. Very long texts are
encoded a block at a time (one text at least). An empty table gives no rows. Only the key and
the text are read, so other columns may have any names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfwise.llm.state import checkpointed
from shelfwise.llm.textkit import BLANK, Words, blocks, lanes_of, span_hashes

SIZE, END = 2048, 0
#: Bins that may be open in a task at once.
OPEN = 8192
#: Tokens of a group, some 2048 sequences.
GROUP_TOKENS = 4 << 20
CACHE_WORDS = 300_000
#: Rows and bytes that are worked on at once.
ROWS, BYTES = 1024, 2 << 20
#: What a byte is to the pre-tokenizer. A word with an ODD one is not cut: apostrophes begin contractions, bars are in
#: special tokens, controls are rare, and of letters beyond U+017F this table does not tell.
NONE, LETTER, DIGIT, MARK, ODD = range(5)
KINDS = np.full(256, MARK, np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = LETTER
KINDS[48:58] = DIGIT
KINDS[[*range(0x20), 0x27, 0x7C, 0x7F, 0xC0, 0xC1, 0xC2, *range(0xC6, 0x100)]] = ODD
KINDS[BLANK] = NONE


class Bins:
    """Open bins of one task, by their free space."""

    def __init__(self, size: int = SIZE, most: int = OPEN) -> None:
        self.size, self.most = size, most
        self.free = 0  # bit f: some open bin has f tokens free
        self.at: list[list[int]] = [[] for _ in range(size + 1)]
        self.opened = self.count = 0

    def take(self, free: int) -> int:
        """A bin with so many tokens free; it is not open any more."""
        bin_ = self.at[free].pop()
        if not self.at[free]:
            self.free ^= 1 << free
        self.count -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """The bin that a piece goes to, and its offset there."""
        fit = self.free >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            bin_ = self.take(free)
        else:
            if self.count == self.most:
                self.take((self.free & -self.free).bit_length() - 1)
            free, bin_ = self.size, self.opened
            self.opened += 1
        if left := free - length:
            self.at[left].append(bin_)
            self.free |= 1 << left
            self.count += 1
        return bin_, self.size - free


class Vocabulary:
    """A tokenizer, and the ids of the words that it was asked for."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.place: dict[bytes, int] = {}
        self.first, self.size, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def forget(self) -> None:
        """Only the parts that were used more than half of them stay."""
        n = len(self.place)
        stay = np.flatnonzero(self.uses[:n] > np.median(self.uses[:n]))
        names = list(self.place)
        first, size = self.first[stay], self.size[stay]
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        self.used, self.first, self.size, self.uses = len(self.ids), ends - size, size, self.uses[stay] // 2
        self.place = {names[i]: k for k, i in enumerate(stay.tolist())}

    def learn(self, words: list[bytes]) -> None:
        found = [x.ids for x in self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        begin, end, total = len(self.place), len(self.place) + len(words), int(sizes.sum())
        self.first, self.size, self.uses = (_room(x, end) for x in (self.first, self.size, self.uses))
        self.ids = _room(self.ids, self.used + total)
        self.size[begin:end], self.uses[begin:end] = sizes, 0
        self.first[begin:end] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.used += total
        self.place.update(zip(words, range(begin, end), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and where each text's begin (and the last end)."""
        words = Words(texts)
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        buf, start, end = word_parts(words)
        lanes = lanes_of(buf)
        which, names = pd.factorize(span_hashes(buf, start, end, lanes))
        of = np.empty(len(names), np.int64)
        of[which[::-1]] = np.arange(len(which) - 1, -1, -1)  # the first part with each hash
        raw = buf.tobytes()
        different = [raw[a:b] for a, b in zip(start[of].tolist(), end[of].tolist(), strict=True)]
        if len(self.place) > CACHE_WORDS:
            self.forget()
        if new := [w for w in different if w not in self.place]:
            self.learn(new)
        place = np.fromiter(map(self.place.__getitem__, different), np.int64, len(different))
        self.uses[place] += np.bincount(which, minlength=len(place))
        place = place[which]
        size = self.size[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.first[place] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(start, words.bounds)]
        odd = np.unique(np.searchsorted(words.bounds, start[unlike(lanes, start, end, of[which])], "right") - 1)
        if not len(odd):
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in odd.tolist():
            parts[i] = np.array(self.library.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, made longer if it has fewer than n places."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def word_parts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of some words with A-Z of plain ones lowered, and where their parts start and end."""
    kind = KINDS[words.buf]
    # among the letters from U+00C0 on are two signs, and one whose lower form ends in a mark
    for lead, byte in [c.encode() for c in "×÷İ"]:
        kind[1:][(words.buf[1:] == byte) & (words.buf[:-1] == lead)] = ODD
    odd = np.concatenate([[0], np.cumsum(kind == ODD)])
    odd = np.flatnonzero(odd[words.end] > odd[words.start])
    step = np.zeros(len(kind) + 1, np.int8)
    step[words.start[odd]] += 1
    step[words.end[odd]] -= 1
    whole = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    kind[whole] = LETTER
    buf = words.buf + (((words.buf >= 65) & (words.buf <= 90) & ~whole) << 5).astype(np.uint8)
    fresh = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == DIGIT)
    start = np.flatnonzero(fresh & (kind != NONE))
    stop = np.concatenate([np.flatnonzero(fresh), [len(kind)]])
    return buf, start, stop[np.searchsorted(stop, start, "right")]


def unlike(lanes: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The byte ranges that differ from range number `other` of each; lanes: of the buffer."""
    size = end - start
    same = size == size[other]
    rest, at = np.flatnonzero(same), 0
    while len(rest):
        here = size[rest] - at
        mask = np.where(here >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * np.minimum(here, 7).astype(np.uint64))) - np.uint64(1))
        same[rest] &= ((lanes[start[rest] + at] ^ lanes[start[other[rest]] + at]) & mask) == 0
        at += 8
        rest = rest[size[rest] > at]
    return np.flatnonzero(~same)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker, with its words."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """key, piece, start, length, ids_crc32 and the ids (if with_ids) of every document's pieces."""
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts, BYTES):
                ids, bounds = voc.encode(texts[a:b])
                row, piece, start, length, crc, said = [], [], [], [], [], []
                for i in range(b - a):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(END)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), size)):
                        part = own[at : at + size]
                        row.append(a + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            said.append(part.astype(np.int32))
                cols = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(said, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["key", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return slim.mapInArrow(run, schema).withColumnRenamed("key", key)


def packed(parts: DataFrame, size: int = SIZE, open_bins: int = OPEN, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """parts (any columns, with length of at most size) with sequence_id and offset.

    parts are read twice, for their sum and to pack them, so they should be kept. Rows are dealt
    round robin, which no key can make uneven, and sorted by all columns, so a task that is run
    again packs alike.
    """
    total = parts.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    by = [F.col(f"`{c}`") for c in parts.columns if c != "length"]
    dealt = parts.repartition(groups).sortWithinPartitions(F.col("length").desc(), *by)
    at = parts.columns.index("length")
    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, group = Bins(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            put = [bins.put(n) for n in batch.column(at).to_pylist()]
            where = [pa.array([group | b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *where], [*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, schema)


def sequences(parts: DataFrame) -> DataFrame:
    """sequence_id and the ids of every sequence, from the pieces with their ids."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return parts.groupBy("sequence_id").agg(F.flatten(own).alias("ids"))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and where they are packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(checkpointed(pieces(docs, word_vocabulary(), with_ids=False)))
