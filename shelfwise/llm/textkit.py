"""Vectorised text helpers that run inside Spark's Python workers.

Texts of an Arrow batch are laid end to end in one byte buffer; words, hashes and windows
are then found with numpy passes over that buffer. Blocks are bounded in bytes, so memory
does not follow the partition; one document longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on at once.
BLOCK_BYTES = 4 << 20
#: Odd multipliers of the hashes (eight bytes of a word, words of a window).
LANE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1
#: Longer byte ranges are hashed by a digest.
SHORT_BYTES = 32
#: Space and the controls 0x09 to 0x0D: what parts words, and what bytes.split() splits on.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 2 * BLOCK_BYTES:
            _powers[base] = have
    return have


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about limit bytes together, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of some texts: byte ranges in one buffer, and the text of each.

    texts are bytes; blank marks the bytes that part words. Attributes: buf (the texts,
    each followed by a line feed), start and end (of each word), first (index of each
    text's first word, and the number of words at last), doc (text of each word).
    """

    def __init__(self, texts: list[bytes], blank: np.ndarray = BLANK) -> None:
        self.raw = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.raw, np.uint8)
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = ~blank[self.buf]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        # a word that began at s ends at the next blank; the last byte is always one
        self.end = np.flatnonzero(step == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        self.bounds = bounds
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self, buf: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, of other bytes at the same places if buf is given."""
        return span_hashes(self.buf if buf is None else buf, self.start, self.end)


def lanes_of(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on as one number, zeros behind the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes, equal hashes.

    Short ranges are mixed eight bytes at a time, which is one to one for each eight bytes;
    longer ones take a digest, so no pattern of bytes makes different ranges equal.
    """
    if lanes is None:
        lanes = lanes_of(buf)
    size = end - start
    out = mix((lanes[start] & _low_bytes(size)) + size.astype(np.uint64) * np.uint64(LANE_BASE))
    rest = np.flatnonzero(size > 8)
    for at in range(8, SHORT_BYTES, 8):
        rest = rest[size[rest] > at]
        if not len(rest):
            break
        out[rest] = mix(out[rest] * np.uint64(LANE_BASE) + (lanes[start[rest] + at] & _low_bytes(size[rest] - at)))
    far = np.flatnonzero(size > SHORT_BYTES)
    if len(far):
        raw = buf.tobytes()
        spans = zip(start[far].tolist(), end[far].tolist(), strict=True)
        out[far] = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in spans]), "<u8")
    return out


def _low_bytes(size: np.ndarray) -> np.ndarray:
    """Masks of the first size bytes of a lane, all eight for more."""
    return _MASKS[np.minimum(size, 8)]


def window_hashes(words: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """A 64-bit hash of each run of width word hashes, in order; len(words) - width + 1."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        out += words[k : k + n] * np.uint64(factor)
        factor = factor * base % (1 << 64)
    return mix(out)


def shingles(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of width words of one text; a shorter text is one run."""
    h = window_hashes(hashes, width)
    inside = words.doc[: len(h)] == words.doc[width - 1 :] if len(h) else np.zeros(0, bool)
    value, doc = h[inside], words.doc[: len(h)][inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        more = np.array([whole_hash(hashes[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)
        value, doc = np.concatenate([value, more]), np.concatenate([doc, short])
    return value, doc


def whole_hash(words: np.ndarray) -> int:
    """The hash of one whole short text; its length keeps it apart from longer runs."""
    out = len(words)
    for w in words.tolist():
        out = (out * WORD_BASE + w) % (1 << 64)
    return int(mix(np.array([out ^ 0x5555555555555555], np.uint64))[0])


def lowered(raw: bytes) -> np.ndarray:
    """The bytes of some UTF-8 text with letters lowered, each letter in its own place.

    A letter whose lower form takes another number of bytes stays as it is.
    """
    text = raw.decode("utf-8", "surrogateescape")
    low = text.lower().encode("utf-8", "surrogateescape")
    if len(low) != len(raw):
        change = {c: c.lower() for c in set(text) if len(c.lower().encode("utf-8", "surrogateescape")) == len(c.encode("utf-8", "surrogateescape"))}
        low = text.translate(str.maketrans(change)).encode("utf-8", "surrogateescape")
    return np.frombuffer(low, np.uint8)
