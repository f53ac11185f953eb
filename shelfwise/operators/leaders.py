"""Greedy groups in parallel: the same leaders as a loop over the rows in their order.

The loop: a row joins the first leader that it merges with, else it leads. So leaders are the
lexicographically first maximal independent set of the merging pairs, and that can be found in rounds: every row
without an open earlier neighbour leads, its later neighbours join, both are decided, and the rest goes on. A
round is two shuffles of the pairs that are still open; for rows in no special order some log(n) rounds
do, and what is decided takes no further part. No group or block is gathered in a task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.clusters import kept
from shelfwise.operators.identity import blocked_pairs, judged
from shelfwise.operators.offers import keep_one


def first_independent(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and leader. nodes: node and place (any type that can be compared, the same for no two); pairs: x and y, each pair once or more."""
    place = lambda name: nodes.select(F.col("node").alias(name), F.col("place").alias(f"{name}_at"))
    both = pairs.where("x != y").join(place("x"), "x").join(place("y"), "y")
    first = F.col("x_at") < F.col("y_at")
    edges = kept(both.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("early"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("late"), F.least("x_at", "y_at").alias("at")).distinct())
    waiting = edges.select("early", "late")
    open_ = kept(edges.select(F.col("late").alias("node")).union(edges.select("early")).distinct())
    leaders = nodes.select("node").join(open_, "node", "left_anti")  # rows without pairs lead
    while not open_.isEmpty():
        new = kept(open_.join(waiting.select(F.col("late").alias("node")).distinct(), "node", "left_anti"))
        members = kept(waiting.join(new.withColumnRenamed("node", "early"), "early", "left_semi").select(F.col("late").alias("node")).distinct())
        decided = new.unionByName(members)
        leaders = leaders.unionByName(new)
        open_ = kept(open_.join(decided, "node", "left_anti"))
        left = waiting.join(decided.withColumnRenamed("node", "early"), "early", "left_anti")
        waiting = kept(left.join(decided.withColumnRenamed("node", "late"), "late", "left_anti"))
    own = edges.join(leaders.withColumnRenamed("node", "early"), "early", "left_semi").groupBy("late").agg(F.min_by("early", "at").alias("leader"))
    # a leader's own earlier neighbours are members, so none of them is in own
    return nodes.select("node").join(own.withColumnRenamed("late", "node"), "node", "left").select("node", F.coalesce("leader", "node").alias("leader"))


def merging_pairs(rows: DataFrame) -> DataFrame:
    """x, y: pairs of rows (id, title, kind, brand) whose whole decision is to merge."""
    pairs = blocked_pairs(rows, rows).where("l_id != r_id")
    once = pairs.select(F.least("l_id", "r_id").alias("l_id"), F.greatest("l_id", "r_id").alias("r_id")).distinct()
    return judged(once, rows, rows).where("action = 'merge'").select(F.col("l_id").alias("x"), F.col("r_id").alias("y"))


def led(rows: DataFrame, order: Column) -> DataFrame:
    """id and leader of rows (id, title, kind, brand): groups by the pair decision, rows taken in an order (ties by id, a null order last).

    Rows of equal title, kind and brand are alike in every decision and merge with each other, so one of
    them, the first, stands for all. Null and empty titles are titles like others.
    """
    same = ["title", "kind", "brand"]
    placed = rows.select("id", *same, F.struct(order.isNull().alias("none"), order.alias("by"), F.col("id").alias("id")).alias("place"))
    firsts = kept(keep_one(placed, same, [F.asc("place")]))
    found = first_independent(firsts.select(F.col("id").alias("node"), "place"), merging_pairs(firsts.select("id", *same)))
    mine = firsts.join(found.withColumnRenamed("node", "id"), "id").select(*[F.col(c).alias(f"_{c}") for c in same], "leader")
    equal = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
    return placed.join(mine, equal).select("id", "leader")
