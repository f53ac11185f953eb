"""Operators of the board and of publishing: keepers, cascades of matches, queues, patches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.offers import keep_one


def into_keeper(rows: DataFrame, keys: list[str]) -> DataFrame:
    """product_id and into for every row that is not its group's keeper: most offers (n), then the smallest id."""
    keeper = rows.groupBy(*keys).agg(F.max_by("product_id", F.struct("n", -F.col("product_id"))).alias("into"))
    return rows.join(keeper, keys).where("product_id != into").select("product_id", "into")


def publish(new: DataFrame, old: DataFrame, board: DataFrame) -> DataFrame:
    """new with act and target: the first of merge, known url, board model, same title that hits, else a new row."""
    hits = [
        ("move", ["brand", "color", "polymer", "kind", "variant"], old, "product_id"),
        ("replace", ["url"], old.where("url is not null"), "product_id"),
        ("attach", ["brand", "variant"], board, "id"),
        ("join", ["brand", "color", "polymer"], old, "product_id"),
    ]
    act, target = F.lit("new"), F.lit(None).cast("string")
    for name, keys, side, key in hits:
        new = new.join(side.groupBy(*keys).agg(F.min(key).cast("string").alias(f"to_{name}")), keys, "left")
    for name, *_ in reversed(hits):
        act = F.when(F.col(f"to_{name}").isNotNull(), name).otherwise(act)
        target = F.coalesce(f"to_{name}", target)
    return new.withColumns({"act": act, "target": target})


def item_for(rows: DataFrame, board: DataFrame, keys: list[list[str]]) -> DataFrame:
    """rows with item: the kept one, else by each list of keys in turn the board's only item of these values."""
    for i, on in enumerate(keys):
        only = board.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(f"only{i}")).where("n = 1").drop("n")
        rows = rows.join(only, on, "left")
    return rows.withColumn("item", F.coalesce("kept", *[f"only{i}" for i in range(len(keys))]))


def sole_links(rows: DataFrame, board: DataFrame, keys: list[str]) -> DataFrame:
    """id and renamed (1) of board items that have their keys alone and meet one row, which meets no other item.

    Both sides are counted by their keys before they meet, so many rows of one name are never paired. A row (product_id)
    that comes more than once meets an item each time.
    """
    named = lambda d: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    item = board.where(named(board)).groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.min("id").alias("id"))
    links = rows.where(named(rows)).groupBy("product_id", *keys).agg(F.count(F.lit(1)).alias("times")).join(item, keys)
    sole = links.groupBy("product_id").agg(F.sum(F.col("times") * F.col("items")).alias("n"), F.min("id").alias("id")).where("n = 1")
    return sole.groupBy("id").agg(F.count(F.lit(1)).alias("renamed")).where("renamed = 1")


def confirm(queue: DataFrame, confirmed: DataFrame, board: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The queue without confirmed rows, and those of them that the board does not have yet."""
    added = queue.join(confirmed, "product_id", "left_semi").join(board.select(*keys).distinct(), keys, "left_anti")
    return queue.join(confirmed, "product_id", "left_anti"), added


def identity_style(board: DataFrame) -> DataFrame:
    """One row: whether three fifths of a board's ids have a slash, and how many items it has."""
    return board.agg((F.count_if(F.contains("id", F.lit("/"))) * 10 >= F.count(F.lit(1)) * 6).alias("by_identity"), F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, fields and how (new, filled, kept): unknown items are added, of known ones only blanks change."""
    new = incoming.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    both = old.withColumn("known", F.lit(True)).join(new, key, "full")
    blank = reduce(lambda a, b: a | b, [F.col(f).isNull() & F.col(f"new_{f}").isNotNull() for f in fields])
    how = F.when(F.col("known").isNull(), "new").when(blank, "filled").otherwise("kept")
    return both.select(key, how.alias("how"), *[F.coalesce(f, f"new_{f}").alias(f) for f in fields])


def resolve(wanted: DataFrame, tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """wanted with the value that the first of the tables that has the key gives it."""
    for i, t in enumerate(tables):
        wanted = wanted.join(t.select(key, F.col(value).alias(f"v{i}")), key, "left")
    return wanted.withColumn(value, F.coalesce(*[f"v{i}" for i in range(len(tables))]))


def valid_paths(chosen: DataFrame, rows: DataFrame, levels: list[str]) -> DataFrame:
    """chosen paths with every level from the first that no row has on made null."""
    for i in range(len(levels)):
        there = rows.select(*levels[: i + 1]).distinct().withColumn(f"ok{i}", F.lit(True))
        chosen = chosen.join(there, levels[: i + 1], "left")
    upto = [reduce(lambda a, b: a & b, [F.col(f"ok{j}").isNotNull() for j in range(i + 1)]) for i in range(len(levels))]
    return chosen.select("n", *[F.when(ok, F.col(x)).alias(x) for ok, x in zip(upto, levels, strict=True)])


def shop_categories(rows: DataFrame) -> DataFrame:
    """Rows (shop_id, category, ord, url) at the shop's own host, the first of each category and then of each url."""
    own = rows.where(F.get(F.split("url", "/"), F.lit(2)) == F.concat(F.lit("shop"), F.col("shop_id").cast("string"), F.lit(".example")))
    return keep_one(keep_one(own, ["shop_id", "category"], [F.asc("ord")]), ["shop_id", "url"], [F.asc("ord")])


def compact(events: DataFrame, most: int = 1000) -> DataFrame:
    return events.withColumns({"type": F.coalesce("type", F.lit("note")), "text": F.substring("text", 1, most)})


def put_back(rows: DataFrame, held: DataFrame, keys: list[str], place: str) -> DataFrame:
    """rows and held in the order of the places that all had."""
    both = rows.unionByName(held)
    return both.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(place)).cast("long") - 1)


def build_dictionary(official: DataFrame, tracker: DataFrame) -> DataFrame:
    """identity, source and aliases (how many names): official models with their forms and the
    tracker's names for them, then models that only the tracker has."""
    model, kind = ["brand", "variant"], F.col("kind")
    forms = official.select(*model, "kind").distinct().withColumn("form", F.explode(F.when(kind == "printer", F.array(F.lit(""), F.lit("/combo"))).otherwise(F.array(F.lit("")))))
    names = tracker.groupBy(*model).agg(F.countDistinct("color").alias("names"))
    identity = F.concat("brand", F.lit("/"), F.col("variant").cast("string"))
    known = forms.join(names, model, "left").select(F.concat(identity, "form").alias("identity"), F.lit("official").alias("source"), F.coalesce("names", F.lit(0)).alias("aliases"))
    rest = names.join(official.select(*model).distinct(), model, "left_anti")
    return known.unionByName(rest.select(identity.alias("identity"), F.lit("tracker").alias("source"), F.col("names").alias("aliases")))
