"""Search scores of catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.similarity import token_hits
from shelfwise.functions.text import fold, let

#: Words on nearly every listing, left out of queries.
SEARCH_STOP = (
    "3d yazici printer fiyat fiyati inceleme yorum stok stoktan stokta ve ile the and with for adet urun urunu model makine makinesi "
    "kutu hediyeli indirimli kampanya yeni new sifir orijinal tl try"
).split()


def search_tokens(query: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in SEARCH_STOP])
    return F.filter(F.split(fold(query), " "), lambda t: (t != "") & ~F.array_contains(stop, t))


def words_of(text: Column) -> Column:
    return F.filter(F.split(fold(text), " "), lambda t: t != "")


def search_score(name: Column, haystack: Column, query: Column) -> Column:
    """100 exact; 80, 84, 88 all words in the name; 60 all anywhere; 45 all words with digits;
    30 and the number of hits for half the words; 0 otherwise. Of no words: 1 if there was a query."""
    words = F.struct(search_tokens(query).alias("wanted"), words_of(name).alias("name"), words_of(haystack).alias("hay"), fold(query).alias("query"))
    return let(words, lambda w: _scored(w, F.trim(F.coalesce(query, F.lit(""))) != ""))


def _scored(w: Column, asked: Column) -> Column:
    wanted, name_words, total = w["wanted"], w["name"], F.size(w["wanted"])
    count = lambda tokens, where: F.size(F.filter(tokens, lambda t: token_hits(t, where)))
    anchors = F.filter(wanted, lambda t: t.rlike("[0-9]"))
    hits = F.struct(anchors.alias("anchors"), count(wanted, name_words).alias("name"), count(wanted, w["hay"]).alias("any"), count(anchors, w["hay"]).alias("anchored"))

    def rank(h: Column) -> Column:
        at = F.array_position(name_words, F.coalesce(F.get(h["anchors"], F.lit(0)), F.get(wanted, F.lit(0))))
        joined = F.array_join(name_words, " ")
        return (
            F.when(total == 0, asked.cast("int"))
            .when(h["anchored"] < F.size(h["anchors"]), 0)
            .when((joined == w["query"]) | (joined == F.array_join(wanted, " ")), 100)
            .when(h["name"] == total, 80 + F.when(at == 1, 8).when((at >= 2) & (at <= 3), 4).otherwise(0))
            .when(h["any"] == total, 60)
            .when(F.size(h["anchors"]) > 0, 45)
            .when((h["any"] >= F.greatest(F.lit(1), F.ceil(total / 2))) & (h["any"] > 0), 30 + h["any"])
            .otherwise(0)
        ).cast("int")

    return let(hits, rank)


def matches(name: Column, haystack: Column, query: Column) -> Column:
    """Strict: every word must be somewhere; a query of filler words matches everything."""
    return (F.size(search_tokens(query)) == 0) | (search_score(name, haystack, query) >= 60)
