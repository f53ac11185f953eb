"""Cutting lineage in the folder that the cluster shares, keys of rows, and bitmaps."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap that one task puts together.
SLICE_BITS = 19


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine (tests) may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
    return folder or os.path.join(tempfile.gettempdir(), "checkpoints")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of spark.checkpoint.dir."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def row_key(key: Column, text: Column) -> Column:
    """A row's id and the digest of its text, ordered by id with null last; null and empty texts are equal."""
    return F.struct(key.isNull().alias("unnamed"), key.alias("id"), F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)).alias("digest"))


def bitmap(rows: DataFrame, places: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """2**bits bits, packed, those at places set. Tasks set bits of their own rows, slices are
    put together in parallel, and the driver gets each slice once: 2**bits / 8 bytes in all."""
    part = 1 << min(bits, SLICE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << bits, bool)
        for at in places(batches):
            mine[at] = True
        slices = mine.reshape(-1, part)
        some = np.flatnonzero(slices.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([np.packbits(slices[i]).tobytes() for i in some], pa.binary())], ["slice", "bits"])

    def either(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part // 8, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                total |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "bits"])

    schema = "slice long, bits binary"
    out = np.zeros(((1 << bits) // part, part // 8), np.uint8)
    for row in rows.mapInArrow(run, schema).groupBy("slice").applyInArrow(either, schema).collect():
        out[row.slice] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)
