"""JSON of any shape, walked on the VARIANT type: every object at any depth, level by level.

A text is parsed once (try_parse_json); a level's objects and arrays are opened by variant_explode, all rows
of a level at once. Levels end with the deepest text. Broken texts and nulls have no objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.clusters import kept


def text_of(v: Column, path: str) -> Column:
    """The text at a path of a variant, null if what is there is no text."""
    there = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(there) == "STRING", F.try_variant_get(v, path, "string"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def objects(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, depth (from 0) and v of every object in the JSON text of every row."""
    spark = rows.sparkSession
    level = kept(rows.select(F.col(key).alias("k"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null"))
    out, depth = level.limit(0).select("k", F.lit(0).alias("depth"), "v"), 0
    while not level.isEmpty():
        out = out.unionByName(level.where(is_object(F.col("v"))).select("k", F.lit(depth).alias("depth"), "v"))
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("k", F.col("value").alias("v"))
        nested = F.schema_of_variant("v")
        level = kept(inner.where(nested.startswith("OBJECT") | nested.startswith("ARRAY")))
        depth += 1
    return out.withColumnRenamed("k", key)


def named_objects(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, name and url of every object that has a name, or else a title, as a text."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    v = F.col("v")
    name = F.coalesce(some(text_of(v, "$.name")), some(text_of(v, "$.title")))
    return objects(rows, key, json).select(key, name.alias("name"), text_of(v, "$.url").alias("url")).where("name is not null")


def products(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, depth, name, price and currency of every schema.org Product node, in graphs and lists too; of several offers the first with a price."""
    v = F.col("v")
    kinds = F.coalesce(F.array(text_of(v, "$['@type']")), F.array().cast("array<string>"))
    listed = F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array().cast("array<string>"))
    is_product = F.exists(F.concat(kinds, listed), lambda k: F.coalesce(F.lower(k).contains("product"), F.lit(False)))
    one = F.filter(F.array(F.try_variant_get(v, "$.offers", "variant")), lambda o: F.coalesce(F.schema_of_variant(o).startswith("OBJECT"), F.lit(False)))
    offers = F.concat(one, F.coalesce(F.try_variant_get(v, "$.offers", "array<variant>"), F.array().cast("array<variant>")), F.array(v))
    price = lambda o: F.coalesce(*[F.try_variant_get(o, f"$.{p}", "double") for p in ("price", "lowPrice", "highPrice")])
    priced = F.get(F.filter(offers, lambda o: price(o).isNotNull()), F.lit(0))
    found = objects(rows, key, json).where(is_product).select(key, "depth", text_of(v, "$.name").alias("name"), priced.alias("o"))
    return found.select(key, "depth", "name", price(F.col("o")).alias("price"), F.try_variant_get("o", "$.priceCurrency", "string").alias("currency"))
