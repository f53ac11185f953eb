"""Writing catalogues: guarded writes, snapshots, publishing by a pointer, labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.offers import flag_outliers


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows under a path with a declared schema; no rows if the path is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_config(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a pipe-delimited file with # comments, trimmed."""
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.schema(schema).option("sep", "|").option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def write_offers(offers: DataFrame, path: str) -> None:
    """Offers are never written without their outlier flags."""
    flag_outliers(offers).write.mode("overwrite").parquet(path)


def snapshot(df: DataFrame, root: str, name: str) -> str:
    """A version under root; versions are never overwritten."""
    path = f"{root}/versions/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def publish(spark: SparkSession, root: str, name: str) -> None:
    """Makes a version the current one: a one-row pointer is replaced, no data moves."""
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").json(f"{root}/current")


def current(spark: SparkSession, root: str) -> DataFrame:
    name = spark.read.schema("name string").json(f"{root}/current").first().name
    return spark.read.parquet(f"{root}/versions/{name}")


def restore(spark: SparkSession, root: str, name: str, keep_as: str) -> None:
    """Makes an old version current; what is current is kept as a version of its own first."""
    snapshot(current(spark, root), root, keep_as)
    publish(spark, root, name)


def write_run(parts: dict[str, DataFrame], root: str, run: str) -> None:
    """What a run leaves behind (found, verified, held, placed): a table each, and how many rows each has."""
    counts = []
    for name, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{root}/{run}/{name}")
        counts.append((name, df.sparkSession.read.parquet(f"{root}/{run}/{name}").count()))
    df.sparkSession.createDataFrame(counts, "part string, n long").coalesce(1).write.json(f"{root}/{run}/summary")


def write_pairs(pairs: DataFrame, path: str, least: int = 200, each: int = 100) -> None:
    """Labelled pairs as JSON lines, refused if they are few or out of balance."""
    n = {r.label: r["count"] for r in pairs.groupBy("label").count().collect()}  # two labels
    if sum(n.values()) < least or min(n.get("same", 0), n.get("different", 0)) < each:
        raise ValueError(f"too few pairs or out of balance: {n}")
    pairs.write.mode("overwrite").json(path)


def explode_feed(feed: DataFrame) -> DataFrame:
    """Products and variants of a nested feed: one priced, available row for each variant."""
    v = feed.select(F.explode("products").alias("p")).select("p", F.explode("p.variants").alias("v"))
    image = F.coalesce(F.get(F.filter("p.images", lambda i: F.array_contains(i["variant_ids"], F.col("v.id"))), F.lit(0))["src"], F.get("p.images", F.lit(0))["src"])
    option = F.when(F.coalesce(F.col("v.title"), F.lit("")).isin("", "Default Title"), "").otherwise(F.concat(F.lit(" "), F.col("v.title")))
    price = F.col("v.price").try_cast("double")
    return v.where(F.col("v.available") & (price > 0)).select(F.col("v.id").alias("id"), F.concat("p.title", option).alias("name"), price.alias("price"), image.alias("image"))
