"""How frequent word runs are in all documents, in a hashed table sized by the data.

A run's count is that of its slot: never too low, so a frequent run is always known as
one. The table has about SLOT_RUNS runs a slot, between 2**LEAST_BITS and 2**MOST_BITS
slots. Each task counts all its texts and sends the slots it met; slices of the table are
added up in parallel, and only a byte for each slot (how heavy it is) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.state import checkpointed
from shelfwise.llm.textkit import Words, blocks, shingles

LEAST_BITS, MOST_BITS = 18, 22
SLOT_RUNS, RUN_BYTES = 1024, 6
SLICES = 16


@dataclass(frozen=True)
class RunCounts:
    """total: runs in all texts; mean: runs a slot; heavy: for each slot 0 up to twice the
    mean, then 1 more for each doubling (a byte each, 2**MOST_BITS at most)."""

    total: int
    mean: float
    heavy: np.ndarray


def slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The slots of some hashes in a table of slots (a power of two) slots."""
    return (hashes >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def heaviness(counts: np.ndarray, mean: float) -> np.ndarray:
    return np.floor(np.log2(np.maximum(1, counts / (2 * mean)) * 2)).astype(np.uint8) * (counts > 2 * mean)


def run_counts(docs: DataFrame, text: str, width: int, lower: bool) -> RunCounts:
    """Counts of the runs of width words of all texts."""
    slim = docs.select(F.col(text).cast("binary").alias("body")).where(F.col("body").isNotNull())
    size = slim.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (int(size) // RUN_BYTES // SLOT_RUNS).bit_length()))
    slots, part = 1 << bits, (1 << bits) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in blocks(texts):
                w = Words([t.lower() for t in texts[a:b]] if lower else texts[a:b])
                at = slot(shingles(w, w.hashes(), width)[0], slots)
                total += np.bincount(at, minlength=slots).astype(np.int32)
        if total.any():
            press = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([press.compress(p.tobytes()) for p in total.reshape(SLICES, -1)], pa.binary())], ["part", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part, np.int64)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(unpack.decompress(x.as_py()), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([int(total.sum())]), pa.array([total.tobytes()], pa.binary())], ["part", "total", "counts"])

    added = checkpointed(slim.mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, total long, counts binary"))
    total = int(added.agg(F.sum("total")).first()[0] or 0)
    mean = max(1.0, total / slots)

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([heaviness(np.frombuffer(x.as_buffer(), np.int64), mean).tobytes() for x in batch.column(1)], pa.binary())], ["part", "heavy"])

    heavy = np.zeros((SLICES, part), np.uint8)
    for row in added.select("part", "counts").mapInArrow(graded, "part int, heavy binary").collect():  # SLICES rows
        heavy[row.part] = np.frombuffer(row.heavy, np.uint8)
    return RunCounts(total, mean, heavy.reshape(-1))
