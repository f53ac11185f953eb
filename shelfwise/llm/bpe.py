"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 16 bytes has its low bits zero, so passages
that documents share are cut alike wherever they lie. Documents are dealt by their least
chunk hash, which brings those that share chunks to the same task; there each chunk is
encoded once and its ids are reused for every document that holds it. A chunk is encoded
between its first and last *sync points*: a single space between a printable ASCII
character and an ASCII letter, where the vocabulary's pre-tokenizer starts a new piece. Its
edges are the ids of its first and of its last word.

What lies between two chunks' ids is the join. It is encoded again as one text together
with the edges on both sides, and counts only if the new ids begin and end with exactly the
edges' ids that the chunks have; else the join widens, to the next chunk or back over the
last one, and is encoded again until they agree or the text ends. A text without a sync
point in any chunk is one join. What is decoded comes from ids alone, those of joins as those of chunks.

Chunks of Latin letters go through the rank form of the vocabulary, all others and texts
with a special token through the tokenizers library itself; both give the same ids.

The memory for chunks is bounded (CACHE_BYTES in each worker, dropped whole when full),
which changes how often a chunk is encoded, never its ids. Nulls are empty texts; an
empty text has no ids. Repeated rows and equal texts have equal values. A very long text is encoded chunk by
chunk, one without sync points as a whole. An empty table
gives no rows. Only the key and the text are read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK, LEAST = (1 << 9) - 1, 64
CACHE_BYTES = 48 << 20
#: A value for each byte of the rolling hash.
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)

SYNC = re.compile(rb"(?<=[!-~]) (?=[A-Za-z])")
#: UTF-8 lead bytes of code points from U+0280 on.
FAR = re.compile(rb"[\xca-\xff]")


def cuts(text: bytes) -> list[int]:
    """Ends of the text's chunks; a chunk has LEAST bytes at least, but for the last."""
    if len(text) <= LEAST:
        return [len(text)] if text else []
    data = np.frombuffer(text, np.uint8)
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    # a chunk ends before a byte that begins a character
    at = np.flatnonzero(((h[:-1] >> np.uint32(16)) & np.uint32(MASK)) == 0) + 1
    at = at[(data[at] & 0xC0) != 0x80]
    ends, last = [], 0
    for e in at.tolist():
        if e - last >= LEAST:
            ends.append(e)
            last = e
    if last < len(text):
        ends.append(len(text))
    return ends


def locality(text: bytes) -> int:
    """The least hash of a text's chunks: the same for most texts that share chunks."""
    last, best = 0, 1 << 62
    for e in cuts(text):
        best = min(best, int.from_bytes(hashlib.blake2b(text[last:e], digest_size=7).digest(), "big"))
        last = e
    return best


def last_sync(chunk: bytes) -> int:
    """The last sync point of a chunk, -1 if there is none."""
    at = len(chunk) - 1
    while (at := chunk.rfind(b" ", 1, at)) > 0:
        if SYNC.match(chunk, at):
            return at
    return -1


class Part(NamedTuple):
    """Ids, the ids in decimal joined by commas, and the bytes that they decode to."""

    ids: array
    decimals: bytes
    decoded: bytes


class Chunk(NamedTuple):
    """Where a chunk's ids begin and end in it, the ids, and its edges: how many bytes and
    ids its first and its last word take."""

    first: int
    last: int
    part: Part
    head: tuple[int, int]
    tail: tuple[int, int]


class Encoder:
    """A vocabulary, the chunks encoded so far, and the joins."""

    def __init__(self, library_path: str, ranks_path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(library_path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(library_path, encoding="utf-8") as f:
            special = json.load(f)["added_tokens"]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.piece[i] = token
        for x in special:
            self.piece += [b""] * (x["id"] + 1 - len(self.piece))
            self.piece[x["id"]] = x["content"].encode()
        self.special = [x["content"].encode() for x in special]
        self.name = [str(i).encode() for i in range(len(self.piece))]
        self.chunks: dict[bytes, Chunk | None] = {}
        self.held = 0

    def library_ids(self, text: bytes) -> list[int]:
        return self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids

    def ids_of(self, text: bytes) -> list[int]:
        """Ids of a text that begins and ends at sync points or a text's ends."""
        return self.library_ids(text) if FAR.search(text) else self.ranks.encode_ordinary(text.decode("utf-8"))

    def part(self, text: bytes) -> Part:
        return self.checked(text, self.ids_of(text))

    def checked(self, text: bytes, ids: list[int]) -> Part:
        decoded = self.bytes_of(ids)
        if decoded != text:  # ids of a byte-level vocabulary give all bytes back
            ids = self.library_ids(text)
            decoded = self.library.decode(ids, skip_special_tokens=False).encode()
        return Part(array("i", ids), self.decimals(ids), decoded)

    def chunk(self, chunk: bytes) -> Chunk | None:
        """The ids of a chunk between its first and last sync point; None if it has no two."""
        if chunk in self.chunks:
            return self.chunks[chunk]
        first, last = SYNC.search(chunk), last_sync(chunk)
        found = None
        if first is not None and last > first.start():
            part = self.part(chunk[first.start() : last])
            t = part.decoded
            second, before = SYNC.search(t, 1), last_sync(t)
            head = self.edge(part.ids, second.start() if second else len(t))
            tail = self.edge(part.ids[::-1], len(t) - max(0, before))
            if head and tail:
                found = Chunk(first.start(), last, part, head, tail)
        if self.held > CACHE_BYTES:
            self.chunks.clear()
            self.held = 0
        self.chunks[chunk] = found
        self.held += 7 * len(chunk) + 600
        return found

    def edge(self, ids, size: int) -> tuple[int, int] | None:
        """size and how many of the first ids take just so many bytes."""
        n = taken = 0
        while taken < size and n < len(ids):
            taken += len(self.piece[ids[n]])
            n += 1
        return (size, n) if taken == size else None

    def join(self, text: bytes, left: Chunk | None, start: int, end: int, right: Chunk | None) -> tuple[Part | None, bool, bool]:
        """The ids of text[start:end] between two chunks, and whether the left and the right edge agree."""
        before, after = left.tail if left else (0, 0), right.head if right else (0, 0)
        ids = array("i", self.ids_of(text[start - before[0] : end + after[0]]))
        stop = len(ids) - after[1]
        on_left = not left or ids[: before[1]] == left.part.ids[-before[1] :]
        on_right = not right or (stop >= before[1] and ids[stop:] == right.part.ids[: after[1]])
        if not (on_left and on_right):
            return None, on_left, on_right
        middle = ids[before[1] : stop]
        return Part(middle, self.decimals(middle), self.bytes_of(middle)), True, True

    def encode(self, text: bytes) -> list[Part]:
        """The ids of a text, in parts that follow on one another."""
        if any(x in text for x in self.special):
            return [self.checked(text, self.library_ids(text))]
        done: list[tuple[int, Part, Chunk]] = []  # where each join starts, the join, the chunk behind it
        begin = start = 0  # of the chunk; of the join that is still open
        left: Chunk | None = None
        ends = cuts(text)
        for k, end in enumerate(ends):
            right = self.chunk(text[begin:end])
            last = k == len(ends) - 1
            while right is not None or last:
                to = begin + right.first if right else len(text)
                middle, on_left, _ = self.join(text, left, start, to, right)
                if middle is not None and right:
                    done.append((start, middle, right))
                    left, start, right = right, begin + right.last, None
                elif middle is not None:
                    return [x for _, m, c in done for x in (m, c.part)] + [middle]
                elif not on_left:  # back over the last chunk
                    start = done.pop()[0]
                    left = done[-1][2] if done else None
                else:  # on to the next chunk
                    right = None
            begin = end
        return []

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 as U+FFFD."""
        return self.bytes_of(ids).decode("utf-8", "replace")

    def decimals(self, ids) -> bytes:
        return b",".join(map(self.name.__getitem__, ids))


#: The pattern that the vocabulary parts text with before its merges: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(library_path: str, ranks_path: str) -> Encoder:
    """One for each worker, with its chunks, for as long as the worker lives."""
    key = library_path, ranks_path
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
        gc.freeze()  # the vocabulary's many small objects need not be looked at again
    return _encoders[key]


def gathered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and body (bytes), dealt so that texts with the same least chunk lie together.

    The rebalancing exchange splits a chunk that very many documents share over tasks.
    """
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    kind = slim.schema["key"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([locality(t) for t in batch.column(1).to_pylist()], pa.int64())], ["key", "body", "near"])

    return slim.mapInArrow(near, f"key {kind}, body binary, near long").hint("rebalance", "near")


def encode_texts(docs: DataFrame, library_path: str, ranks_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if with_ids."""
    near = gathered(docs, key, text)
    kind = near.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(library_path, ranks_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n, shas, decoded, ids = [], [], [], []
                for t in part.column(1).to_pylist():
                    parts = [x for x in enc.encode(t) if x.ids]
                    n.append(sum(len(x.ids) for x in parts))
                    shas.append(hashlib.sha256(b",".join([x.decimals for x in parts])).hexdigest())
                    # a character may lie in two ids, so bytes become text when all are there
                    decoded.append(hashlib.sha256(b"".join([x.decoded for x in parts]).decode("utf-8", "replace").encode()).hexdigest())
                    if with_ids:
                        ids.append(np.concatenate([np.frombuffer(x.ids, np.int32) for x in parts]) if parts else [])
                cols, names = [part.column(0), pa.array(n, pa.int64()), pa.array(shas), pa.array(decoded)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return near.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, library_path: str, ranks_path: str, ids: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of its ids, null for null."""

    @F.pandas_udf("string")
    def run(column):
        enc = encoder(library_path, ranks_path)
        return column.map(lambda x: None if x is None else enc.decode([int(i) for i in x]))

    return encoded.withColumn("decoded", run(F.col(ids)))


def vocabulary(folder: str | None = None) -> tuple[str, str]:
    """Paths of the byte-level vocabulary in both its forms; folder: where they lie."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return f"{folder}/byte_bpe_50k.json", f"{folder}/byte_bpe_50k.tiktoken"


def op10_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, *vocabulary(), with_ids=False)
