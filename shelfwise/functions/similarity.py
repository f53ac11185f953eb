"""Word and title likeness from higher-order functions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import VARIANTS, fold, let, title_rules, tokens, tokens_of


def similar(a: Column, b: Column) -> Column:
    """Equal; or both of four letters or more, and one edit apart or a fifth of the longer."""
    d, longer = F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & ((d <= 1) | (d <= longer * 0.2)))


def near(a: Column, b: Column) -> Column:
    """Equal; or both of four letters or more and one edit or one swap of neighbours apart."""
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (F.abs(F.length(a) - F.length(b)) <= 1) & ((F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swapped)))


def matched_tokens(x: Column, y: Column) -> Column:
    """How many tokens of x find one of y of their own, each taking the first that is left."""
    def step(acc: Column, t: Column) -> Column:
        # places of y that are still free and like t
        hit = F.get(F.filter(acc["free"], lambda i: similar(t, F.element_at(y, i))), F.lit(0))
        return F.when(hit.isNull(), acc).otherwise(F.struct((acc["n"] + 1).alias("n"), F.array_except(acc["free"], F.array(hit)).alias("free")))

    places = F.when(F.size(y) > 0, F.sequence(F.lit(1), F.size(y))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(x, F.struct(F.lit(0).alias("n"), places.alias("free")), step)["n"]


def words_score(a: Column, b: Column) -> Column:
    """Likeness of two titles by their structs (rules, folded, tokens): 1 for equal titles,
    else matched tokens over all tokens."""
    x, y = a["tokens"], b["tokens"]
    empty = (F.size(x) == 0) & (F.size(y) == 0)
    share = let(matched_tokens(x, y), lambda n: n / F.greatest(F.lit(1), F.size(x) + F.size(y) - n))
    return F.when((a["rules"] != "") & (a["rules"] == b["rules"]), 1.0).when(empty, (a["folded"] == b["folded"]).cast("double")).otherwise(share)


def words_subset(a: Column, b: Column) -> Column:
    """All tokens of the shorter title are like some of the longer, which adds no variant word."""
    x, y = a["tokens"], b["tokens"]

    def inside(short: Column, long: Column) -> Column:
        # words of the longer title that no word of the shorter is like
        extra = F.filter(long, lambda t: ~F.exists(short, lambda u: similar(t, u)))
        return (F.size(short) >= 2) & F.forall(short, lambda t: F.exists(long, lambda u: similar(t, u))) & ~F.arrays_overlap(extra, F.array(*[F.lit(v) for v in VARIANTS]))

    return F.when(F.size(x) <= F.size(y), inside(x, y)).otherwise(inside(y, x))


def title_words(title: Column) -> Column:
    """What likeness needs of a title, to be made once for each row and before any join."""
    return let(title_rules(title), lambda t: F.struct(t.alias("rules"), fold(title).alias("folded"), tokens_of(t).alias("tokens")))


def title_score(a: Column, b: Column) -> Column:
    return words_score(title_words(a), title_words(b))


def title_subset(a: Column, b: Column) -> Column:
    return words_subset(title_words(a), title_words(b))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two 64-bit hashes; 64 if one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def hash_bits(hexadecimal: Column) -> Column:
    """16 hexadecimal digits as a 64-bit number; null for anything else."""
    return F.when(F.lower(hexadecimal).rlike("^[0-9a-f]{16}$"), F.conv(hexadecimal, 16, -10).cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def token_hits(token: Column, words: Column) -> Column:
    """A word equals the token, begins with it, is near it, or two neighbours glued equal it."""
    glued = F.exists(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat(a, b)), lambda g: F.coalesce(g == token, F.lit(False)))
    return F.exists(words, lambda w: (w == token) | w.startswith(token) | near(w, token)) | glued
