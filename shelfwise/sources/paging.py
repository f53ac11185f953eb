"""Page patterns of lists: what the addresses of pages 1 and 2 have in common, and the number between.

Two addresses are aligned by their longest common beginning and end. What lies between must be two numbers,
or nothing and a piece with one number, and the number must be a page's: behind one of KEYS in a query, or a part of the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that number pages; pages that are followed at most.
KEYS, MOST = ("sayfa", "page", "paged", "pg", "tp", "p"), 40
_KEY = "|".join(KEYS)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _common(a: Column, b: Column) -> Column:
    """How many characters two texts have in common from their beginning."""
    least = F.least(F.length(a), F.length(b))
    off = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(least == 0, 0).otherwise(F.coalesce(F.get(off, F.lit(0)) - 1, least))


def pattern(first: Column, second: Column) -> Column:
    """struct(head, tail, start, step) of the addresses of pages 1 and 2; null if they show none.

    Page i is head, start + (i - 1) * step, tail. Addresses of different sites have no pattern.
    """
    bare = lambda u: F.regexp_replace(u, "#.*$", "")

    def aligned(x: Column) -> Column:
        a, b = x["a"], x["b"]

        def cut(n: Column) -> Column:
            # a number that goes on behind what is common belongs to the middle, not to what is common
            inside = F.substr(a, n + 1, F.lit(1)).rlike("[0-9]") | F.substr(b, n + 1, F.lit(1)).rlike("[0-9]")
            head = F.when(inside, F.regexp_replace(F.substr(b, F.lit(1), n), "[0-9]+$", "")).otherwise(F.substr(b, F.lit(1), n))
            rest = lambda u: F.substr(u, F.length(head) + 1)

            def ends(y: Column) -> Column:
                m = _common(F.reverse(y["p"]), F.reverse(y["q"]))
                before = lambda r: F.substr(r, F.lit(1), F.length(r) - m).rlike("[0-9]$")
                end = F.substr(y["q"], F.length(y["q"]) - m + 1)
                tail = F.when(before(y["p"]) | before(y["q"]), F.regexp_replace(end, "^[0-9]+", "")).otherwise(end)
                middle = lambda r: F.substr(r, F.lit(1), F.length(r) - F.length(tail))
                return F.struct(head.alias("head"), tail.alias("tail"), middle(y["p"]).alias("m1"), middle(y["q"]).alias("m2"))

            return _let(F.struct(rest(a).alias("p"), rest(b).alias("q")), ends)

        return _let(_common(a, b), cut)

    def judged(x: Column) -> Column:
        n2 = F.regexp_extract(x["m2"], "^[^0-9]*([0-9]+)[^0-9]*$", 1)
        head = F.concat(x["head"], F.regexp_extract(x["m2"], "^([^0-9]*)[0-9]", 1))
        tail = F.concat(F.regexp_extract(x["m2"], "[0-9]([^0-9]*)$", 1), x["tail"])
        both = x["m1"].rlike("^[0-9]+$") & x["m2"].rlike("^[0-9]+$")
        # page 1 says no number: then it has nothing that page 2 lacks but a closing stroke
        alone = x["m1"].isin("", "/", "?") & (n2 != "")
        number = lambda c: c.try_cast("int")
        in_query = head.contains("?")
        start = F.when(both, number(x["m1"])).when(in_query, 1).otherwise(F.greatest(number(n2) - 1, F.lit(1)))
        of_page = F.when(in_query, head.rlike(rf"(?i)[?&](?:{_KEY})=$")).otherwise(head.rlike("/$") & tail.rlike("^/?(?:[?].*)?$"))
        fits = (both | alone) & of_page & (number(n2) != start)
        return F.when(fits, F.struct(head.alias("head"), tail.alias("tail"), start.alias("start"), (number(n2) - start).alias("step")))

    same_site = lambda u: F.regexp_extract(u, "^(https?://[^/?#]+)", 1)
    found = _let(_let(F.struct(bare(first).alias("a"), bare(second).alias("b")), aligned), judged)
    return F.when((same_site(first) == same_site(second)) & (same_site(first) != "") & (bare(first) != bare(second)), found)


def page_at(p: Column, page: Column, first: Column) -> Column:
    """The address of a page, by its number from 1."""
    n = p["start"] + (page - 1) * p["step"]
    return F.when(page == 1, first).when(page > 1, F.concat(p["head"], n.cast("string"), p["tail"]))


def page_of(p: Column, url: Column, first: Column) -> Column:
    """The number of the page at an address; null if it is none of the list's."""
    inner = F.substr(url, F.length(p["head"]) + 1, F.length(url) - F.length(p["head"]) - F.length(p["tail"])).try_cast("int")
    fits = F.startswith(url, p["head"]) & F.endswith(url, p["tail"])
    number = (inner - p["start"]) / p["step"] + 1
    return F.when(p.isNotNull() & (url == first), 1).when(fits & (number == F.floor(number)) & (number >= 1), number.cast("int"))


def next_of(p: Column, url: Column, first: Column, most: int = MOST) -> Column:
    """The address of the page after one; null from page `most` on."""
    at = page_of(p, url, first)
    return F.when(at < most, page_at(p, at + 1, first))


def host_patterns(pages: DataFrame) -> DataFrame:
    """host, pattern and lists: the pattern that most lists of a shop have (ties: the first by its parts).

    pages: first and second, the addresses of pages 1 and 2 of a list.
    """
    host = F.regexp_extract("first", "^https?://([^/?#]+)", 1)
    # of lists only what is behind the path is shared: the key or the word before the number, and what follows
    shared = lambda p: F.struct(F.regexp_extract(p["head"], r"([?&][^?&=]*=|/[^/]*/)$", 1).alias("before"), p["start"].alias("start"), p["step"].alias("step"))
    found = pages.select(host.alias("host"), pattern(F.col("first"), F.col("second")).alias("p")).where("p is not null").select("host", shared(F.col("p")).alias("pattern"))
    counted = found.groupBy("host", "pattern").agg(F.count(F.lit(1)).alias("lists"))
    best = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("lists"), "pattern"))
    return counted.withColumn("n", best).where("n = 1").select("host", "pattern", "lists")
