"""Dictionary joins, identities, candidate ranking and decisions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.identity import STRICT, axes, conflicts, decided, features, is_lookalike, kit_form, technology
from shelfwise.functions.similarity import similar, title_words, words_score
from shelfwise.functions.text import fold, let, title_rules, variant_tag
from shelfwise.operators import clusters
from shelfwise.sources.dictionary import ALIASES, LONGEST


#: Names of a dictionary that is sent to all tasks; a longer one is joined by sorting.
SENT = 200_000


def phrases(words: Column, longest: int = LONGEST) -> Column:
    """Distinct runs of 1 to longest words: what an alias can equal."""
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), _joined(words, n)) for n in range(1, longest + 1)]
    return F.array_distinct(F.concat(*runs))


def _joined(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def lookup(rows: DataFrame, title: str, dictionary: DataFrame, key: str) -> DataFrame:
    """rows with brand_id, model and feeder: the longest aliases in the title, models and
    feeders of the found brand only. An equi-join of phrases, so both sides may be large.

    Only a dictionary of at most SENT names is sent to all tasks, never the phrases. A title's hits (its phrases that are aliases) are gathered once. They are as many as the rows, so they are joined back
    by sorting: as compressed bytes they can look small enough to be sent whole through the driver.
    """
    way = "broadcast" if dictionary.limit(SENT + 1).count() <= SENT else "merge"
    found = rows.select(F.col(key).alias("_k"), F.explode(phrases(F.split(fold(F.col(title)), " "))).alias("alias")).join(dictionary.hint(way), "alias")
    hits = found.groupBy("_k").agg(F.collect_list(F.struct("role", "of", F.length("alias").alias("n"), "alias", "id")).alias("_hits")).withColumnRenamed("_k", key)
    longest = lambda test: F.array_max(F.transform(F.filter("_hits", test), lambda h: F.struct(h["n"], h["alias"], h["id"])))["id"]
    named = hits.withColumn("brand_id", longest(lambda h: h["role"] == "brand"))
    of_brand = lambda role: longest(lambda h: (h["role"] == role) & (h["of"] == F.col("brand_id")))
    named = named.withColumns({role: of_brand(role) for role in ("model", "feeder")}).drop("_hits")
    return rows.join(named.hint("merge"), key, "left")


def identity_id(title: Column, brand: Column, model: Column, feeder: Column) -> Column:
    """brand/model/combo/feeder/kit/technology/variant, parts without a value left out."""
    empty = lambda c: F.nullif(c, F.lit(""))

    def made(rules: Column) -> Column:
        combo = F.when(rules.rlike(r"\bbare\b"), "bare").when(rules.rlike(r"\bcombo\b") | feeder.isNotNull(), "combo")
        return F.concat_ws("/", brand, model, combo, feeder, empty(kit_form(title, rules)), technology(title, rules), empty(F.replace(variant_tag(rules), F.lit(" "), F.lit("-"))))

    return let(title_rules(title), made)


#: A candidate of another brand must be as like a listing as this.
LEAST_SCORE = 0.4
#: Parts into which the left rows of one key are dealt.
SALT = 8
_BRANDS = [x for alias, role, brand, _ in ALIASES if role == "brand" for x in (alias, brand)]


def alike_words(words: DataFrame) -> DataFrame:
    """x, y: all pairs of different words (column node) that are similar, both ways.

    A word of n letters lies within n // 4 edits of a longer one that it is similar to (one at
    least), so one of n // 4 + 1 parts of it stands unchanged in the other, as many places off
    at most. Words meet by such parts.
    """
    def parts(n: int) -> tuple[int, list[tuple[int, int]]]:
        most = max(1, n // 4)
        cuts = [n * i // (most + 1) for i in range(most + 2)]
        return most, list(zip(cuts, cuts[1:], strict=False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word in batch["node"]:
                m = len(word)
                for n in range(max(4, m - max(1, m // 5)), m + 1):
                    most, cuts = parts(n)
                    for i, (start, end) in enumerate(cuts):
                        if n == m:
                            rows.append((word, True, f"{n} {i} {word[start:end]}"))
                        rows += [(word, False, f"{n} {i} {word[at : at + end - start]}") for at in range(max(0, start - most), min(m - end + start, start + most) + 1)]
            yield pd.DataFrame(rows, columns=["word", "whole", "part"])

    keyed = words.where(F.length("node") >= 4).mapInPandas(run, "word string, whole boolean, part string").distinct()
    short, long = keyed.where("whole").select(F.col("word").alias("x"), "part"), keyed.where("not whole").select(F.col("word").alias("y"), "part")
    found = short.join(long, "part").where("x != y").select("x", "y").distinct().where(similar(F.col("x"), F.col("y")))
    return found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()


def _free(a: str, b: str) -> Column:
    return F.size(conflicts(F.col(a), F.col(b))) == 0


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left and right rows of equal keys without a conflict; rows of a hot key are dealt over SALT tasks."""
    dealt = left.withColumn("salt", F.pmod(F.xxhash64("l_id"), F.lit(SALT)).cast("int"))
    copied = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return dealt.join(copied, [*keys, "salt"]).where(_free("lx", "rx"))


def _same_brand(a: DataFrame, b: DataFrame) -> DataFrame:
    """r_id and each brand of left rows (lf) that is the row's own under another name, is
    similar to it, or stands in the row's title."""
    of_left, of_right = (d.select("f", "c").distinct() for d in (a, b))
    named = of_right.select(F.col("f").alias("rf"), "c").join(of_left.select(F.col("f").alias("lf"), "c"), "c").select("rf", "lf")
    glued = lambda c: F.replace(c, F.lit(" "))
    like = alike_words(of_left.unionByName(of_right).select(glued(F.col("f")).alias("node")).distinct()).unionByName(of_left.select(glued(F.col("f")).alias("x"), glued(F.col("f")).alias("y")).where("x != ''").distinct())
    near = of_right.select(F.col("f").alias("rf"), glued(F.col("f")).alias("x")).join(like, "x").join(of_left.select(F.col("f").alias("lf"), glued(F.col("f")).alias("y")), "y").select("rf", "lf")
    owned = b.select("r_id", F.col("f").alias("rf")).join(named.unionByName(near).distinct(), "rf").select("r_id", "lf")
    worded = b.select("r_id", "words.folded", F.explode(F.array_distinct(F.split("words.folded", " "))).alias("word"))
    held = worded.join(of_left.where("f != ''").select(F.col("f").alias("lf"), F.split("f", " ")[0].alias("word")), "word")
    inside = held.where(F.contains(F.concat(F.lit(" "), "folded", F.lit(" ")), F.concat(F.lit(" "), "lf", F.lit(" ")))).select("r_id", "lf")
    return owned.unionByName(inside).distinct()


def _prefixes(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """l_id, lg and r_id, rg: every row's token classes, those of fewest rows first. Similar
    tokens are of one class, and a class that a row has twice counts as two."""
    both = [(d.select(F.col(f"{p}_id").alias("id"), F.explode("words.tokens").alias("node")), p) for d, p in ((a, "l"), (b, "r"))]
    vocabulary = clusters.kept(both[0][0].unionByName(both[1][0]).select("node").distinct())
    classes = clusters.kept(clusters.connected(vocabulary, alike_words(vocabulary)))
    tokens_of = []
    for d, p in both:
        times = d.join(classes, "node").groupBy("id", "cluster").agg(F.count(F.lit(1)).cast("int").alias("n"))
        tokens_of.append((clusters.kept(times.select("id", F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.concat_ws(" ", "cluster", i.cast("string")))).alias("g"))), p))
    seen = clusters.kept(tokens_of[0][0].unionByName(tokens_of[1][0]).groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    l, r = (d.join(seen, "g").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "g")))["g"].alias(f"{p}g")).withColumnRenamed("id", f"{p}_id") for d, p in tokens_of)
    return l, r


def blocked_pairs(left: DataFrame, right: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Pairs l_id, r_id that may be one product: all those of one brand, with a title score of
    least or more, or with an equal title, that differ on no axis. No pair is lost.

    left and right have id, title, kind, brand. A brand is the same if equal or an alias,
    similar, or named in the right title. The axes that a pair must share (STRICT ones, the
    technology, being a lookalike) are part of every key. Of two titles with a score of least,
    at least that share of either's tokens is matched, so their rarest classes of tokens, as
    many as can be without a match and one more, have one in common.
    """
    def sided(df: DataFrame, p: str) -> DataFrame:
        f, x = fold(F.col("brand")), axes(F.col("title"), F.col("kind"))
        row = df.select(F.col("id").alias(f"{p}_id"), f.alias("f"), is_lookalike(F.col("title")).cast("string").alias("k"), x.alias(f"{p}x"), title_words(F.col("title")).alias("words"))
        key = F.concat_ws("|", "k", *[f"{p}x.{c}" for c in (*STRICT, "technology")])
        return clusters.kept(row.withColumns({"k": key, "c": F.coalesce(F.try_element_at(F.create_map(*map(F.lit, _BRANDS)), F.col("f")), F.col("f"))}))

    a, b = sided(left, "l"), sided(right, "r")
    l, r = (d.select(f"{p}_id", "k", f"{p}x", F.col("words").alias(f"{p}w")) for d, p in ((a, "l"), (b, "r")))
    by_brand = _met(l.join(a.select("l_id", F.col("f").alias("lf")), "l_id"), r.join(_same_brand(a, b), "r_id"), ["k", "lf"])
    by_title = [_met(l.withColumn("t", F.col(f"lw.{t}")), r.withColumn("t", F.col(f"rw.{t}")), ["k", "t"]) for t in ("rules", "folded")]
    lg, rg = _prefixes(a, b)
    # how many of m tokens a pair may leave without a match, and one more; the rest guards against rounding
    prefix = lambda c: F.slice(c, F.lit(1), F.size(c) - F.ceil(F.size(c) * least - 1e-9).cast("int") + 1)
    shared, sizes = F.size(F.array_intersect("lg", "rg")), F.size("lg") + F.size("rg")
    near = _met(l.join(lg.select("*", F.explode(prefix(F.col("lg"))).alias("g")), "l_id"), r.join(rg.select("*", F.explode(prefix(F.col("rg"))).alias("g")), "r_id"), ["k", "g"])
    once = F.array_intersect(prefix(F.col("lg")), prefix(F.col("rg")))[0] == F.col("g")
    enough = once & (shared * (1 + least) + 1e-9 >= sizes * least)
    by_score = near.where(enough).where(words_score(F.col("lw"), F.col("rw")) >= least)
    found = [d.select("l_id", "r_id") for d in (by_brand, *by_title, by_score)]
    return reduce(DataFrame.unionByName, found).distinct()


def judged(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Decisions on pairs; features are made once for each row."""

    def sided(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{p}_id"), features(F.col("title"), F.col("kind"), F.col("brand")).alias(p))

    return decided(pairs.join(sided(left, "l"), "l_id").join(sided(right, "r"), "r_id"), "l", "r")


def ranked(pairs: DataFrame, left: DataFrame, right: DataFrame, most: int = 8) -> DataFrame:
    """Decisions on pairs, the best of each left row first."""
    w = Window.partitionBy("l_id").orderBy(F.desc("score"), "r_id")
    return judged(pairs, left, right).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def scorer_gate(score: Column, conflict: Column, merges: Column, threshold: float = 0.8, low: float = 0.1) -> Column:
    """What a learned score of the best candidate may decide: a conflict is never overridden, it creates or waits."""
    return (
        F.when(conflict, F.when(score <= low, "create").otherwise("hold")).when((score >= 0.95 * threshold) & merges, "merge").when(score >= threshold, "merge").when(score <= low, "create").otherwise("hold")
    )


def enforce(answer: Column, offered: Column, confidence: Column, conflict: Column, least: float = 0.75) -> Column:
    """A model's answer counts only if it was offered, is sure enough and has no conflict."""
    return F.when(F.coalesce(F.array_contains(offered, answer), F.lit(False)) & (confidence >= least) & ~conflict, answer)
