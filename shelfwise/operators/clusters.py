"""Clusters of like rows: transitive ones by label passing, sequential ones inside blocks."""

from __future__ import annotations

import os
import tempfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the folder of spark.checkpoint.dir. Only a session on one machine (tests) may leave that unset."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        spark.sparkContext.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint()


def star_edges(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """x, y: every row linked with the least row of its key; rows without a whole key have none."""
    whole = rows.dropna(subset=keys).select(node, *keys)
    least = whole.groupBy(*keys).agg(F.min(node).alias("y"))
    return whole.join(least, keys).where(F.col(node) != F.col("y")).select(F.col(node).alias("x"), "y")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and cluster (the least node that edges x, y reach), by passing labels until none changes."""
    both = kept(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = kept(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("l").alias("m")), "y").groupBy("x").agg(F.min("m").alias("m"))
        lower = labels.join(near, "x").select("x", F.least("l", "m").alias("n"), F.col("l").alias("was"))
        hop = lower.select(F.col("x").alias("n"), F.col("n").alias("hop"))
        new = kept(lower.join(hop, "n", "left").select("x", F.least("n", F.coalesce("hop", "n")).alias("l"), "was"))
        if not new.where("l != was").limit(1).count():
            return nodes.join(labels.withColumnRenamed("x", "node"), "node", "left").select("node", F.coalesce("l", "node").alias("cluster"))
        labels = new.select("x", "l")


def lead(rows: DataFrame, block: list[str], order: str, title: str, least: float) -> DataFrame:
    """order and leader of each row: a row joins the earliest leader of its block whose title's
    words are alike (Jaccard of least or more), or leads itself.

    Sequential by nature, so it runs inside blocks; the block's columns must be equal for any
    two rows that may join. Titles are made distinct first, so copies do not make a block large.
    """
    words = F.array_sort(F.array_distinct(F.split(F.lower(F.coalesce(F.col(title), F.lit(""))), r"\s+")))
    shaped = rows.select(*block, F.col(order).alias("_o"), words.alias("_w"))
    firsts = shaped.groupBy(*block, "_w").agg(F.min("_o").alias("_o"))
    kinds = ", ".join(f"{c} {firsts.schema[c].dataType.simpleString()}" for c in [*block, "_w"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple[set, object]] = []
        out = []
        pdf = pdf.sort_values("_o")
        for w, o in zip(pdf["_w"], pdf["_o"], strict=True):
            mine = set(w)
            for other, leader in leaders:
                if len(mine & other) >= least * len(mine | other):
                    out.append(leader)
                    break
            else:
                leaders.append((mine, o))
                out.append(o)
        return pdf.assign(leader=out)[[*block, "_w", "leader"]]

    found = firsts.groupBy(*block).applyInPandas(run, f"{kinds}, leader {firsts.schema['_o'].dataType.simpleString()}")
    return shaped.join(found, [*block, "_w"]).select(F.col("_o").alias(order), "leader")
