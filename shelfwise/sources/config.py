"""Shop settings as a data source: spark.read.format("shop-config").load(path).

A settings file has a record a line, fields parted by bars; blank lines and lines that begin with # are no
records. Options: path (a file, or a folder of files), fallback (read where path does not exist),
fields (their names, "id,name,category,url" unless said). A record with another number of fields or with an empty first one is kept
aside: its fields are null and corrupt holds its line. Each file is a partition; files are opened by pyarrow's file systems, so
any store that they know will do. A path that does not exist, without a fallback, has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

FIELDS = "id,name,category,url"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The files at a path, by name; none if there is nothing."""
    store, inner = _at(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(inner))
        return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    return []


class OneFile(InputPartition):
    pass


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.width = schema, len(schema) - 2
        self.paths = [options[k] for k in ("path", "fallback") if options.get(k)]

    def partitions(self) -> list[InputPartition]:
        for path in self.paths:
            if found := files_of(path):
                return [OneFile(f) for f in found]
        return []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return
        store, inner = _at(partition.value)
        with store.open_input_stream(inner) as raw:
            text = raw.read().decode("utf-8", "replace")
        for number, line in enumerate(text.splitlines(), 1):
            said = line.strip().lstrip("﻿")
            if not said or said.startswith("#"):
                continue
            fields = [f.strip() or None for f in said.split("|")]
            good = len(fields) == self.width and fields[0]
            yield (*(fields if good else [None] * self.width), number, None if good else line)


class ShopConfig(DataSource):
    """The format shop-config."""

    @classmethod
    def name(cls) -> str:
        return "shop-config"

    def schema(self) -> StructType:
        names = [n.strip() for n in self.options.get("fields", FIELDS).split(",")]
        return StructType([*[StructField(n, StringType()) for n in names], StructField("line", IntegerType()), StructField("corrupt", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(schema, dict(self.options))


def read_config(spark: SparkSession, path: str, fallback: str | None = None, fields: str = FIELDS) -> DataFrame:
    """The records of a settings file: its fields, line and corrupt."""
    spark.dataSource.register(ShopConfig)
    reader = spark.read.format("shop-config").option("fields", fields)
    return (reader.option("fallback", fallback) if fallback else reader).load(path)


def good_records(config: DataFrame, key: str = "id") -> DataFrame:
    """One record for each key: the last line that has it."""
    fields = [c for c in config.columns if c not in ("line", "corrupt")]
    last = config.where("corrupt is null").groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*fields), F.struct("line", *fields)).alias("r"))
    return last.select("r.*")
