"""Duplicate groups of a catalogue: equal names, near names without a conflict, the row to keep, and pairs that must stay apart.

Rows are near if they are of one kind, name the same numbers (tokens with a digit), and their names are similar, score
NEAR or more, or one has all words of the other. Near rows without a conflict and rows of equal names are linked;
groups are the components of links. Near rows with a conflict that no links join are reported as blocked.

Pairs meet by kind, numbers and a class of similar words: of the words of one row, as many of the rarest as NEAR
allows to be missing and one more (one at least, which a subset must have), against all words of the other. Names that differ in
their blanks alone meet as well. Each different (name, kind) of one identity is compared once; links go to the
components, never to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.similarity import similar, title_words, words_score, words_subset
from shelfwise.functions.text import fold
from shelfwise.operators import clusters
from shelfwise.operators.identity import alike_words
from shelfwise.operators.whole import all_conflicts, with_identity

NEAR = 0.82


def numbers_of(words: Column) -> Column:
    """The words with digits of a title, sorted, as one text."""
    return F.array_join(F.array_sort(F.filter(words, lambda w: w.rlike("[0-9]"))), " ")


def near_pairs(rows: DataFrame, dictionary: DataFrame, least: float = NEAR) -> DataFrame:
    """a, b, conflicts: every two rows (id, name, kind, brand and what with_identity reads) that are near, the lesser id first."""
    read = with_identity(rows.select("id", *[c for c in ("name", "kind", "brand", "variant", "polymer", "color", "weight", "packaging", "url") if c in rows.columns]), dictionary)
    kind = F.when(F.coalesce(F.col("kind"), F.lit("")) == "", "printer").otherwise(F.col("kind"))
    sides = read.select("id", kind.alias("k"), title_words(F.col("name")).alias("w"), fold(F.coalesce("name", F.lit(""))).alias("f"), "axes").withColumn("sig", numbers_of(F.col("w.tokens")))
    sides = clusters.kept(sides)
    words = sides.select("id", F.explode("w.tokens").alias("node"))
    vocabulary = clusters.kept(words.select("node").distinct())
    classes = clusters.kept(clusters.connected(vocabulary, alike_words(vocabulary)))
    of_row = clusters.kept(words.join(classes, "node").select("id", "cluster").distinct().join(sides.select("id", "k", "sig"), "id"))
    rare = of_row.groupBy("k", "sig", "cluster").agg(F.count(F.lit(1)).alias("n"))
    ranked = of_row.join(rare, ["k", "sig", "cluster"]).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("n", "cluster"))).join(sides.select("id", F.size("w.tokens").alias("m")), "id")
    probe = ranked.where(F.col("r") <= F.greatest(F.col("m") - F.ceil(F.col("m") * least - 1e-9) + 1, F.lit(1))).select(F.col("id").alias("p"), "k", "sig", "cluster")
    met = probe.join(of_row.select(F.col("id").alias("q"), "k", "sig", "cluster"), ["k", "sig", "cluster"]).select("p", "q")
    glued = sides.select("id", "k", "sig", F.replace("f", F.lit(" "), F.lit("")).alias("g")).where("g != ''")
    met = met.unionByName(glued.select(F.col("id").alias("p"), "k", "sig", "g").join(glued.select(F.col("id").alias("q"), "k", "sig", "g"), ["k", "sig", "g"]).select("p", "q"))
    pairs = met.where("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    x = sides.select(F.col("id").alias("a"), F.struct("w", "f", "axes").alias("x"))
    y = sides.select(F.col("id").alias("b"), F.struct("w", "f", "axes").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    enough = (F.size("x.w.tokens") >= 2) & (F.size("y.w.tokens") >= 2)
    near = similar(F.col("x.f"), F.col("y.f")) | (words_score(F.col("x.w"), F.col("y.w")) >= least) | (enough & words_subset(F.col("x.w"), F.col("y.w")))
    return both.where(near).select("a", "b", all_conflicts(F.col("x.axes"), F.col("y.axes")).alias("conflicts"))


def duplicate_groups(rows: DataFrame, dictionary: DataFrame, offers: str = "offers", least: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(groups, blocked). groups: id, keeper, rows and exact (all names equal) of rows in groups of two or more; the keeper has the most
    offers, then the least id. blocked: a, b, conflicts of near rows that conflict and are in different groups.

    Rows have id, name, kind, brand and a count of offers. Rows of one name, kind and brand stand for each other by their least id.
    """
    named = rows.withColumn("_f", fold(F.coalesce("name", F.lit(""))))
    same = [c for c in ("name", "kind", "brand", "variant", "polymer", "color", "weight", "packaging", "url") if c in rows.columns]
    first = Window.partitionBy(*same)
    placed = clusters.kept(named.withColumn("_r", F.min("id").over(first)))
    reps = placed.where(F.col("id") == F.col("_r"))
    near = clusters.kept(near_pairs(reps, dictionary, least))
    # an empty name is equal to no other
    exact = clusters.star_edges(reps.select("id", F.when(F.col("_f") != "", F.col("_f")).alias("_f")), "id", ["_f"])
    links = exact.unionByName(near.where(F.size("conflicts") == 0).select(F.col("a").alias("x"), F.col("b").alias("y")))
    found = clusters.kept(clusters.connected(reps.select(F.col("id").alias("node")), links))
    grouped = placed.join(found.withColumnRenamed("node", "_r"), "_r")
    best = F.max_by("id", F.struct(F.coalesce(F.col(offers), F.lit(0)), -F.col("id")))
    sizes = grouped.groupBy("cluster").agg(best.alias("keeper"), F.count(F.lit(1)).alias("rows"), (F.count_distinct("_f") == 1).alias("exact")).where("rows > 1")
    groups = grouped.join(sizes, "cluster").select("id", "keeper", "rows", "exact")
    of = lambda name: found.select(F.col("node").alias(name), F.col("cluster").alias(f"{name}_c"))
    blocked = near.where(F.size("conflicts") > 0).join(of("a"), "a").join(of("b"), "b").where("a_c != b_c").select("a", "b", "conflicts")
    return groups, blocked
