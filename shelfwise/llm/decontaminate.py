"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: numbers, names and units are replaced by typed
placeholders, every other word is lowered. Windows of WINDOW tokens are joined by their
template (an item of fewer tokens is one window); for each document, item and alignment
the slots' values are then compared: each value of the item stands for the one value that
most of its slots have in the document, so a question with other parameters is found, and
a window with another value in a slot does not count. If a value of the item has no such
value (its slots are mixed up), only windows with equal values count. An item is in a
document if the windows of one alignment that count are COVERAGE of the item's.

number: a word of digits, with single points and commas inside (one slot);
name: words with a capital first letter only (of any script that has them), not first in a
sentence; neighbours are one slot, whose value is the last of them;
unit: one of UNITS right after a number.

A window with fewer than half its tokens literal is thin: its template alone tells little.
An item that has other windows is judged by those. An item of thin windows only (or of fewer than LEAST_TOKENS
tokens) is found, whatever its length, where it stands as a sentence of its own, with any
parameters: then the marks between its tokens count too ("12 + 30 = ?" is "{number} + {number} ="). It is
also found inside other sentences, word for word if it has LEAST_TOKENS tokens (thin windows are joined with their
values), and with other parameters if LEAST_LITERALS of them are literal. An item of slots
alone, without a word or a mark, says nothing but its values and is found by those only.

Only document windows that a bitmap of the item windows' hashes lets through become rows;
its false alarms are sorted out by the join, so no window is lost. Alignments are first
found by each item's rarest windows (as many as can't all be missing), then looked at whole,
so a phrase that very many items share does not multiply.

Nulls: null and empty texts have no windows. Copies of a document are each reported; rows
that repeat an id are judged text by text and reported once. Empty tables give no rows. Only
the ids and the texts are read. Very long texts are worked on as one block each; ties between
alignments go to the one with more windows, then the exact one. Letters whose lower form takes other
bytes in UTF-8 stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.state import bitmap, checkpointed, row_key
from shelfwise.llm.textkit import BLANK, Words, blocks, lanes_of, lowered, span_hashes, window_hashes

WINDOW, LEAST_TOKENS, LEAST_LITERALS, COVERAGE = 8, 5, 3, 0.5
#: Rows and bytes that are worked on at once.
ROWS, BYTES = 1024, 1 << 20
#: Bits of the bitmap: 64 for each item window, between these figures.
LEAST_BITS, MOST_BITS = 16, 26
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr kmh mph hz khz mhz ghz w kw v a "
    "inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "gram grams kilogram kilograms pound pounds ounce ounces litre litres liter liters second seconds minute minutes "
    "hour hours day days week weeks month months year years degree degrees percent dollar dollars euro euros cent cents"
).split()

LITERAL, NUMBER, NAME, UNIT = range(4)
MARKS = {NUMBER: b"{number}", NAME: b"{name}", UNIT: b"{unit}"}
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ENDS = np.zeros(256, bool)
_ENDS[list(b'.!?:;|"\n')] = True


#: What a window is: eight tokens (or all, of a shorter item) by template, the same by words, all
#: tokens of an item by template, all tokens as a sentence with its marks. The last three are of items of thin windows.
WINDOWS, WORDS, WHOLE, SENTENCE = range(4)
#: How the window's text is made: by template, by words, by template with marks.
PLAIN, EXACT, MARKED = range(3)
MADE = {WINDOWS: PLAIN, WORDS: EXACT, WHOLE: PLAIN, SENTENCE: MARKED}
#: Capitals whose lower form takes another number of bytes, as one number each.
_CAPITALS = np.array([int.from_bytes(c.encode(), "little") for c in map(chr, range(0x80, 0x3000)) if c.isupper() and len(c.lower().encode()) != len(c.encode())], np.uint64)
#: Bytes of a character by its first one.
_CHAR_BYTES = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.int64)
_LOW_BYTES = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint64)


def _capitals(buf: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words have a first letter that is a capital and a second one that is a letter but no capital."""
    changed = np.zeros(len(buf) + 9, np.int32)
    np.cumsum(buf != low, out=changed[1 : len(buf) + 1])
    changed[len(buf) + 1 :] = changed[len(buf)]
    lanes = lanes_of(buf)

    def upper(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = _CHAR_BYTES[buf[at]]
        return (changed[at + size] > changed[at]) | np.isin(lanes[at] & _LOW_BYTES[size], _CAPITALS), size

    first, size = upper(start)
    second = np.minimum(start + size, len(buf) - 1)
    letter = ((buf[second] >= 97) & (buf[second] <= 122)) | (buf[second] >= 128)
    return first & (start + size < end) & letter & ~upper(second)[0]


def _hash_of(word: bytes) -> np.ndarray:
    buf = np.frombuffer(word, np.uint8)
    return span_hashes(buf, np.array([0]), np.array([len(word)]))


_UNIT_HASHES = np.sort(np.concatenate([_hash_of(u.encode()) for u in UNITS]))
_MARK_HASHES = np.concatenate([_hash_of(b"\x00"), *[_hash_of(MARKS[k]) for k in (NUMBER, NAME, UNIT)]])


class Templates:
    """Template tokens of some texts: start, end, kind, doc, opens (first of a sentence), hash of
    the template and exact (hash with the value) of each; counts by text."""

    def __init__(self, texts: list[bytes]) -> None:
        w = Words(texts, _NOT_WORD)
        self.raw, n = w.raw, len(w.start)
        low = lowered(w.raw)
        hashes = span_hashes(low, w.start, w.end)
        kind, opens = np.zeros(n, np.int8), np.ones(n, bool)
        if n:
            digits = np.zeros(len(w.buf) + 1, np.int32)
            np.cumsum((w.buf >= 48) & (w.buf <= 57), out=digits[1:])
            ends = np.zeros(len(w.buf) + 1, np.int32)
            np.cumsum(_ENDS[w.buf], out=ends[1:])
            kind[digits[w.end] - digits[w.start] == w.end - w.start] = NUMBER
            gap_from = np.concatenate([[0], w.end[:-1]])
            fresh = np.concatenate([[True], w.doc[1:] != w.doc[:-1]])
            opens = fresh | (ends[w.start] > ends[gap_from])
            kind[_capitals(w.buf, low, w.start, w.end) & ~opens] = NAME
            gap = w.start - gap_from
            point = (gap == 1) & np.isin(w.buf[gap_from], np.frombuffer(b".,", np.uint8))
            space = (gap == 1) & (w.buf[gap_from] == 32)
            before = np.concatenate([[LITERAL], kind[:-1]])
            joined = ~fresh & (kind == before) & (((kind == NUMBER) & point) | ((kind == NAME) & space))
            after = np.flatnonzero(~fresh & (kind == LITERAL) & (before == NUMBER))
            kind[after[np.isin(hashes[after], _UNIT_HASHES)]] = UNIT
            keep = np.flatnonzero(~joined)
            last = np.concatenate([keep[1:], [n]]) - 1  # the last word of each token
        else:
            keep = last = np.zeros(0, np.int64)
        self.start, self.end = w.start[keep], w.end[last]
        self.kind, self.doc, self.opens = kind[keep], w.doc[keep], opens[keep]
        self.exact = span_hashes(low, self.start, self.end)
        self.hash = np.where(self.kind == LITERAL, hashes[keep], _MARK_HASHES[self.kind])
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.buf, self.bounds = w.buf, w.bounds
        self.gaps: tuple | None = None

    def marks(self) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All marks (no word, blank or sentence end) end to end, and the places there of each token's
        end, of the next token's start, and of the sentence's marks before and after a token."""
        if self.gaps is None:
            mark = _NOT_WORD[self.buf] & ~BLANK[self.buf] & ~_ENDS[self.buf]
            count = np.concatenate([[0], np.cumsum(mark)])
            ends = np.concatenate([[-1], np.flatnonzero(_ENDS[self.buf]), [len(self.buf)]])
            text_start, text_end = self.bounds[self.doc], self.bounds[self.doc + 1] - 1
            before = np.maximum.reduce([np.concatenate([[0], self.end[:-1]]), text_start, ends[np.searchsorted(ends, self.start) - 1] + 1])
            after = np.minimum.reduce([np.concatenate([self.start[1:], [len(self.buf)]]), text_end, ends[np.searchsorted(ends, self.end)]])
            self.gaps = self.buf[mark].tobytes(), count[self.start], count[self.end], count[before], count[after]
        return self.gaps

    def windows(self, width: int, made: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of each run of width tokens of one text."""
        h = window_hashes(self.exact if made == EXACT else self.hash, width) ^ np.uint64(width * 4 + made)
        if made == MARKED and len(h):
            raw, start, end, before, after = self.marks()
            hashes = lambda a, b: span_hashes(np.frombuffer(raw + b" ", np.uint8), a, b)
            h = h + hashes(before, start)[: len(h)] * np.uint64(3) + hashes(end, after)[width - 1 :] * np.uint64(5)
            if width > 1:
                h = h + window_hashes(hashes(end[:-1], start[1:]), width - 1) * np.uint64(7)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[width - 1 :]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]

    def literals(self, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """How many of the width tokens from at on are literal."""
        total = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        return total[at + width] - total[at]

    def has_marks(self, docs: np.ndarray) -> np.ndarray:
        """Whether some texts, which have tokens, have marks where a sentence of all their tokens has."""
        _, _, _, before, after = self.marks()
        return after[self.first[docs + 1] - 1] > before[self.first[docs]]

    def alone(self, at: np.ndarray, width: int) -> np.ndarray:
        """Whether runs of width tokens of a text are sentences."""
        after = np.minimum(at + width, len(self.doc) - 1)
        ends = (at + width == len(self.doc)) | (self.doc[after] != self.doc[at]) | self.opens[after]
        return self.opens[at] & ends

    def template(self, at: int, width: int, made: int = PLAIN) -> tuple[str, list[str]]:
        """The template text of a window and the values of its slots; EXACT: the values are in the text."""
        words, slots = [], []
        raw_marks, start, end, before, after = self.marks() if made == MARKED else (b"", *[None] * 4)
        for i in range(at, at + width):
            raw, k = self.raw[self.start[i] : self.end[i]], int(self.kind[i])
            low = raw.decode("utf-8", "replace").lower()
            if made == MARKED:
                words.append(b"'" + raw_marks[before[i] if i == at else end[i - 1] : start[i]])
            words.append(low.encode() if k == LITERAL or made == EXACT else MARKS[k])
            if k != LITERAL and made != EXACT:
                # of names the last word: a capital word before a name may only open a sentence
                slots.append(f"{k}:" + (low.split()[-1] if k == NAME else low))
        if made == MARKED:
            words.append(b"'" + raw_marks[end[at + width - 1] : after[at + width - 1]])
        return ("", "= ", "~ ")[made] + b" ".join(words).decode("utf-8", "replace"), slots


SCHEMA = "template string, width int, at int, slots array<string>"


def _rows(keys: pa.Array, t: Templates, at: np.ndarray, width: int, made: int, more: dict | None = None) -> pa.RecordBatch:
    found = [t.template(i, width, made) for i in at.tolist()]
    cols = {"key": keys.take(pa.array(t.doc[at])), "template": pa.array([m[0] for m in found], pa.string()), "width": pa.array(np.full(len(at), width, np.int32)), "at": pa.array((at - t.first[t.doc[at]]).astype(np.int32)), "slots": pa.array([m[1] for m in found], pa.list_(pa.string()))}
    cols |= more or {}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """Windows of all items: key, template, width, at, slots, hash, way and n_windows (of the item in the same way)."""
    slim = items.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body")).where(F.col("body").isNotNull())
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts, BYTES):
                t = Templates(texts[a:b])
                mine = np.minimum(t.counts, WINDOW)
                chosen = []  # first tokens, width, way
                for width in np.unique(mine[mine > 0]).tolist():
                    at, _ = t.windows(width, False)
                    at = at[mine[t.doc[at]] == width]
                    thin = (2 * t.literals(at, width) < width) | (t.counts[t.doc[at]] < LEAST_TOKENS)
                    plain = np.isin(t.doc[at], t.doc[at[~thin]])  # of items that have other windows too
                    chosen += [(at[~thin], width, WINDOWS), (at[thin & ~plain], width, WORDS)]
                    odd = np.unique(t.doc[at[~plain]])
                    slots = t.counts[odd] - t.literals(t.first[odd], t.counts[odd])
                    inside = odd[(t.counts[odd] >= LEAST_TOKENS) & (t.counts[odd] - slots >= LEAST_LITERALS)]
                    alone = odd[(slots > 0) & ((slots < t.counts[odd]) | t.has_marks(odd))]
                    chosen += [(t.first[of[t.counts[of] == n]], n, way) for of, way in ((inside, WHOLE), (alone, SENTENCE)) for n in np.unique(t.counts[of]).tolist()]
                for at, width, way in chosen:
                    if len(at):
                        places, h = t.windows(width, MADE[way])
                        n = np.bincount(t.doc[at], minlength=b - a)[t.doc[at]]
                        more = {"hash": pa.array(h[np.searchsorted(places, at)].view(np.int64)), "way": pa.array(np.full(len(at), way, np.int32)), "n_windows": pa.array(n.astype(np.int32))}
                        yield _rows(batch.column(0).slice(a, b - a), t, at, width, MADE[way], more)

    return slim.mapInArrow(run, f"key {kind}, {SCHEMA}, hash long, way int, n_windows int")


def matching_windows(docs: DataFrame, key: str, text: str, bits: Broadcast, kinds: list[tuple[int, int]]) -> DataFrame:
    """The documents' windows that the bitmap lets through: key, template, width, at, slots.

    kinds: widths, each with how the items' windows of that width are made.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body")).where(F.col("body").isNotNull())
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(65 - (8 * len(bits.value)).bit_length())
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts, BYTES):
                t = Templates(texts[a:b])
                for width, made in kinds:
                    at, h = t.windows(width, made)
                    place = (h >> shift).astype(np.int64)
                    at = at[(bits.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
                    if width < LEAST_TOKENS or made == MARKED:
                        at = at[t.alone(at, width)]
                    if len(at):
                        yield _rows(batch.column(0).slice(a, b - a), t, at, width, made)

    return slim.mapInArrow(run, f"key {kind}, {SCHEMA}")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item key, n_windows (matched), coverage, n_slots, exact: one row for each item in a document."""
    best = leaks(docs, items, key, text, item_key, item_text).groupBy("key.id", "item").agg(F.max("b").alias("b"))
    return best.select(F.col("id").alias(key), F.col("item").alias(item_key), F.col("b.n").alias("n_windows"), (F.col("b.n") / F.col("b.of")).alias("coverage"), "b.n_slots", "b.exact")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key (id and digest of the text), item and b (n, exact, n_slots, of): one row for each item in
    a text of an id. Different texts of an id, or without one, are kept apart."""
    docs = docs.select(row_key(F.col(key), F.col(text)).alias("key"), F.col(text).alias("text"))
    windows = checkpointed(item_windows(items, item_key, item_text))
    kinds = sorted({(r.width, MADE[r.way]) for r in windows.select("width", "way").distinct().collect()})  # a row for each length of item
    n_bits = min(MOST_BITS, max(LEAST_BITS, (64 * windows.count()).bit_length()))
    place = lambda batches: ((x.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - n_bits)).astype(np.int64) for x in batches)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(windows.select("hash"), place, n_bits))  # of a bounded size
    found = checkpointed(matching_windows(docs, "key", "text", bits, kinds))
    bits.destroy()
    # an item misses n - ceil(COVERAGE * n) windows at most, so one of its rarest n - ceil(...) + 1 is there
    rarest = Window.partitionBy("key", "way").orderBy("items", "template", "at")
    shared = windows.groupBy("template", "width").agg(F.count(F.lit(1)).alias("items"))
    ranked = windows.join(shared, ["template", "width"]).withColumn("rank", F.row_number().over(rarest))
    probes = ranked.where(F.col("rank") <= F.col("n_windows") - F.ceil(F.lit(COVERAGE) * F.col("n_windows") - 1e-9) + 1)
    d, i = found.alias("d"), probes.alias("i")
    near = d.join(i, ["template", "width"]).select(F.col("d.key").alias("doc"), F.col("i.key").alias("item"), "way", (F.col("d.at") - F.col("i.at")).alias("shift")).distinct().alias("c")
    i = windows.alias("i")
    wanted = near.join(i, F.col("i.key").eqNullSafe(F.col("c.item")) & (F.col("i.way") == F.col("c.way")))
    both = wanted.join(d, F.col("d.key").eqNullSafe(F.col("c.doc")) & (F.col("d.at") == F.col("i.at") + F.col("c.shift")) & (F.col("d.template") == F.col("i.template")) & (F.col("d.width") == F.col("i.width")))
    # a slot is known by the place of its token in the item
    places = F.filter(F.transform(F.split("i.template", " "), lambda t, at: F.when(t.startswith("{"), F.col("i.at") + at)), lambda at: at.isNotNull())
    pairs = both.select(
        F.col("c.doc").alias("key"), "c.item", "c.shift", F.col("i.at").alias("at"), "n_windows", "c.way",
        F.arrays_zip(F.when(F.col("c.way") == WORDS, F.array().cast("array<int>")).otherwise(places).alias("at"), F.col("i.slots").alias("was"), F.col("d.slots").alias("now")).alias("slots"),
    )
    aligned = pairs.groupBy("key", "item", "shift", "way").agg(F.max("n_windows").alias("of"), F.collect_set(F.struct("at", "slots")).alias("windows"))
    slots = F.array_distinct(F.flatten(F.col("windows.slots")))
    same, plain = (lambda s: s["was"] == s["now"]), (lambda s: F.struct(s["was"].alias("was"), s["now"].alias("now")))
    aligned = aligned.withColumn("values", F.transform(slots, plain))
    count = lambda test: F.size(F.filter("values", test))
    most = F.filter(F.array_distinct("values"), lambda v: 2 * count(lambda o: o == v) > count(lambda o: o["was"] == v["was"]))
    aligned = aligned.withColumn("fits", most)
    sound = F.forall("values", lambda v: F.exists("fits", lambda o: o["was"] == v["was"]))
    aligned = aligned.withColumn("sound", sound)
    counts = lambda w: F.forall(w["slots"], same) | (F.col("sound") & F.forall(w["slots"], lambda s: F.array_contains("fits", plain(s))))
    aligned = aligned.withColumn("windows", F.filter("windows", counts))
    n = F.size(F.array_distinct("windows.at"))
    good = aligned.select("key", "item", "of", n.alias("n"), F.array_distinct(F.transform(slots, plain)).alias("slots")).where(F.col("n") >= F.lit(COVERAGE) * F.col("of"))
    exact = F.forall("slots", lambda s: s["was"] == s["now"])
    return good.groupBy("key", "item").agg(F.max(F.struct("n", exact.alias("exact"), F.size("slots").alias("n_slots"), "of")).alias("b"))


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in all documents."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
