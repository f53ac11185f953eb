"""Placing a batch of listings into a catalogue, and the algebra of its rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import fold
from shelfwise.operators.clusters import kept
from shelfwise.operators.identity import blocked_pairs, judged
from shelfwise.operators.leaders import first_independent
from shelfwise.operators.offers import keep_one


def place(listings: DataFrame, catalogue: DataFrame, offers: DataFrame) -> DataFrame:
    """id, action and target of every listing, as if they were placed one by one in the order of their ids.

    listings: id, title, kind, brand, url; catalogue: id, title, kind, brand; offers:
    product_id, url. A known url updates its product; else the best candidate merges the listing or
    holds it for review; else it makes a new product, new-<id>, which is a candidate for all later listings by the
    same whole decision. Best: merge before review, then score, then catalogue before new ones, then the
    least id. Listings without a title are held.

    A listing makes a product if no catalogue row and no earlier new product would merge or hold it:
    those are found in rounds (operators.leaders). Copies (equal title, kind and brand) are decided as one: what the first
    one makes, the others merge with.
    """
    owner = offers.groupBy("url").agg(F.min("product_id").alias("owner"))
    known = kept(listings.join(owner, "url", "left"))
    updated = known.where("owner is not null").select("id", F.lit("updated").alias("action"), F.col("owner").cast("string").alias("target"))
    rest = known.where("owner is null").select("id", "title", "kind", "brand")
    blank = F.coalesce(fold(F.col("title")), F.lit("")) == ""
    held = rest.where(blank).select("id", F.lit("held").alias("action"), F.lit(None).cast("string").alias("target"))
    same = ["title", "kind", "brand"]
    named = rest.where(~blank)
    firsts = kept(named.groupBy(*same).agg(F.min("id").alias("id")))
    offered = judged(blocked_pairs(firsts, catalogue), firsts, catalogue).where("action != 'create'").select("l_id", F.col("r_id").cast("string").alias("target"), F.lit(0).alias("new"), F.col("r_id").alias("at"), "action", "score")
    offered = kept(offered)
    among = blocked_pairs(firsts, firsts).where("l_id != r_id").select(F.greatest("l_id", "r_id").alias("l_id"), F.least("l_id", "r_id").alias("r_id")).distinct()
    alike = kept(judged(among, firsts, firsts).where("action != 'create'").select("l_id", "r_id", "action", "score"))
    free = firsts.join(offered.select(F.col("l_id").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.col("id").alias("place"))
    makers = kept(first_independent(free, alike.select(F.col("l_id").alias("x"), F.col("r_id").alias("y")).join(free.select(F.col("node").alias("x")), "x", "left_semi").join(free.select(F.col("node").alias("y")), "y", "left_semi")).where("leader = node").select("node"))
    made = alike.join(makers.withColumnRenamed("node", "r_id"), "r_id").join(makers.withColumnRenamed("node", "l_id"), "l_id", "left_anti")
    made = made.select("l_id", F.concat(F.lit("new-"), F.col("r_id").cast("string")).alias("target"), F.lit(1).alias("new"), F.col("r_id").alias("at"), "action", "score")
    rank = F.when(F.col("action") == "merge", 0).otherwise(1)
    best = keep_one(offered.unionByName(made).withColumn("r", rank), ["l_id"], [F.asc("r"), F.desc("score"), F.asc("new"), F.asc("at")])
    chosen = best.select(F.col("l_id").alias("first"), F.when(F.col("action") == "merge", "merged").otherwise("held").alias("action"), "target")
    new = makers.select(F.col("node").alias("first"), F.lit("created").alias("action"), F.concat(F.lit("new-"), F.col("node").cast("string")).alias("target"))
    fate = chosen.unionByName(new)
    copies = named.join(firsts.withColumnRenamed("id", "first").alias("f"), reduce(and_, [named[c].eqNullSafe(F.col(f"f.{c}")) for c in same])).select(named["id"], "first")
    action = F.when((F.col("action") == "created") & (F.col("id") != F.col("first")), "merged").otherwise(F.col("action"))
    return updated.unionByName(held).unionByName(copies.join(fate, "first").select("id", action.alias("action"), "target"))


def summary(audit: DataFrame) -> DataFrame:
    """How many listings met each fate."""
    return audit.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("merged", "created", "updated", "held")])


def union_offers(live: DataFrame, candidate: DataFrame) -> DataFrame:
    """live offers and those of candidate whose url live lacks; a candidate's product is the
    live one with its id, else the one that has any of its urls, else its own."""
    by_url = live.groupBy("url").agg(F.min("product_id").alias("owner"), F.lit(True).alias("there"))
    met = candidate.join(by_url, "url", "left")
    ids = live.select(F.col("product_id").alias("same")).distinct()
    target = met.groupBy("product_id").agg(F.min("owner").alias("owner"))
    # null-safe, so that no test of the id is put below the shuffle that live and candidate share
    target = target.join(ids, target["product_id"].eqNullSafe(ids["same"]), "left").select(F.col("product_id").alias("_of"), F.coalesce("same", "owner", "product_id").alias("_into"))
    # only new urls go on to their products: of the others the first join has said all
    fresh = met.where("there is null").drop("owner", "there")
    fresh = fresh.join(target, fresh["product_id"].eqNullSafe(target["_of"])).withColumn("product_id", F.when(F.col("product_id").isNotNull(), F.col("_into")))
    fresh = fresh.where("product_id is not null").select(*candidate.columns)
    return live.unionByName(keep_one(fresh, ["url"], [F.asc("product_id"), F.asc_nulls_first("price")]))


def purge(offers: DataFrame, stores: list[str], hosts: list[str]) -> DataFrame:
    """offers without those of some shops, known by their names or their hosts."""
    host = F.lower(F.get(F.split("url", "/"), F.lit(2)))
    gone = F.coalesce(F.lower("store").isin([s.lower() for s in stores]), F.lit(False)) | F.coalesce(host.isin([h.lower() for h in hosts]), F.lit(False))
    return offers.where(~gone)


def merge_rows(offers: DataFrame, moves: DataFrame) -> DataFrame:
    """offers with the products of moves (product_id, into) made one; a url stays once, the lowest price first."""
    moved = offers.join(moves, "product_id", "left").withColumn("product_id", F.coalesce("into", "product_id")).drop("into")
    return keep_one(moved, ["product_id", "url"], [F.asc_nulls_last("price")])


def retarget(offers: DataFrame, moves: DataFrame) -> DataFrame:
    """offers with those of moves (product_id, ord, into) under another row, or, where into is null,
    under a row of their own (the negative id). A row that loses all its offers is gone."""
    marked = offers.join(moves.withColumn("_moves", F.lit(True)), ["product_id", "ord"], "left")
    into = F.when(F.col("_moves"), F.coalesce("into", -F.col("product_id"))).otherwise(F.col("product_id"))
    return marked.withColumn("product_id", into).drop("into", "_moves")
