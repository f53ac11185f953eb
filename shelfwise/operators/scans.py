"""Scans of texts for dictionary phrases: longest phrase first, what is found is consumed.

The phrases are put together to a trie of words, once, and titles go through it in Arrow batches, so a
title costs its words times the words of the longest phrase, however many phrases there are.
A dictionary of more than MOST_PHRASES rows is not sent to tasks: then titles meet the phrases of their
words in an equi-join, and each title has a trie of its own, of phrases whose words it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import fold

#: Phrases that may be sent to every task.
MOST_PHRASES = 200_000
_ID = 0


class Trie:
    """Phrases by their words. find gives every phrase that begins at a word."""

    def __init__(self, phrases: list[tuple[str, str]]) -> None:
        """phrases: (phrase, id); of two ids of one phrase the least is kept."""
        self.root: dict = {}
        for phrase, id_ in sorted(phrases, reverse=True):
            node = self.root
            for word in phrase.split():
                node = node.setdefault(word, {})
            if node is not self.root:
                node[_ID] = (phrase, id_)

    def find(self, words: list[str], at: int) -> Iterator[tuple[str, str]]:
        node = self.root
        for word in words[at:]:
            node = node.get(word)
            if node is None:
                return
            if _ID in node:
                yield node[_ID]


def consume(words: list[str], trie: Trie) -> list[tuple[str, str]]:
    """(phrase, id) of the phrases in some words, the longest first (of equal length by ASCII).

    Wherever a phrase stands it is taken out, and the words on both sides become neighbours. A
    phrase that stands twice in a row, word by word, is taken out once of each two. A phrase
    whose turn is over is not looked for again.
    """
    out: list[tuple[str, str]] = []
    last: tuple[int, str] = (-(1 << 30), "")
    while True:
        ahead = {(-len(p), p, i) for at in range(len(words)) for p, i in trie.find(words, at)}
        ahead = {x for x in ahead if x[:2] > last}
        if not ahead:
            return out
        size, phrase, id_ = min(ahead)
        last = (size, phrase)
        out.append((phrase, id_))
        parts, left, at = phrase.split(), [], 0
        while at < len(words):
            if words[at : at + len(parts)] == parts:
                at += len(parts)
                left += words[at : at + 1]  # the blank before the next word is gone with the phrase
                at += 1
            else:
                left.append(words[at])
                at += 1
        words = left


def phrases_in(rows: DataFrame, key: str, title: str, dictionary: DataFrame, scope: str | None = None, most: int = MOST_PHRASES) -> DataFrame:
    """key, [scope,] phrases and ids (arrays, in the order of consume) of every row of rows.

    dictionary: alias and id (and of, if there is a scope: only aliases of a row's own scope count;
    a null scope has none). key values may repeat: each row is answered. Null and empty titles have no phrases.
    Titles of any length pass; an empty dictionary finds nothing.
    """
    slim = rows.select(F.col(key).alias("key"), (F.col(scope) if scope else F.lit("")).cast("string").alias("scope"), fold(F.col(title)).alias("folded"))
    entries = dictionary.select("alias", "id", (F.col("of") if scope else F.lit("")).alias("of")).distinct()
    known = entries.limit(most + 1).collect()
    kind = slim.schema["key"].dataType.simpleString()
    out_schema = f"key {kind}, scope string, phrases array<string>, ids array<string>"

    def answer(batch: pa.RecordBatch, tries: list[Trie | None]) -> pa.RecordBatch:
        found = [consume((t or "").split(), trie) if trie else [] for t, trie in zip(batch.column("folded").to_pylist(), tries, strict=True)]
        of = lambda i: pa.array([[f[i] for f in x] for x in found], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("scope"), of(0), of(1)], ["key", "scope", "phrases", "ids"])

    if len(known) <= most:
        by_scope: dict[str, list[tuple[str, str]]] = {}
        for r in known:
            by_scope.setdefault(r.of, []).append((r.alias, r.id))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tries = {s: Trie(p) for s, p in by_scope.items()}  # once for each task
            for batch in batches:
                yield answer(batch, [tries.get(s) for s in batch.column("scope").to_pylist()])

        found = slim.mapInArrow(run, out_schema)
    else:
        words = F.split("folded", " ")
        # what may become a phrase once others are taken out: any phrase whose first word is there
        first = entries.select(F.col("of").alias("scope"), F.split("alias", " ")[0].alias("word"), "alias", "id")
        texts = slim.select("scope", "folded").distinct()
        held = texts.select("scope", "folded", F.explode(F.array_distinct(words)).alias("word")).join(first, ["scope", "word"])
        of_text = held.where(F.forall(F.split("alias", " "), lambda w: F.array_contains(F.split("folded", " "), w))).groupBy("scope", "folded").agg(F.collect_set(F.struct("alias", "id")).alias("own"))
        joined = slim.join(of_text, ["scope", "folded"], "left").select("key", "scope", "folded", "own")

        def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield answer(batch, [Trie([(p["alias"], p["id"]) for p in own]) if own else None for own in batch.column("own").to_pylist()])

        found = joined.mapInArrow(run_joined, out_schema)
    return found.select(F.col("key").alias(key), *([F.col("scope").alias(scope)] if scope else []), "phrases", "ids")


def model_cores(rows: DataFrame, key: str, title: str, brand: str, dictionary: DataFrame, most: int = MOST_PHRASES) -> DataFrame:
    """key, brand and cores: every different model that a title names of its brand, the longest name first."""
    found = phrases_in(rows, key, title, dictionary.where("role = 'model'"), brand, most)
    return found.select(key, brand, F.array_distinct("ids").alias("cores"))


def translated(rows: DataFrame, name: str, exact: dict[str, str], phrases: list[tuple[str, str]]) -> DataFrame:
    """rows with the name as it is said elsewhere: a whole name by a table, else phrases replaced in their order, blanks made one."""
    out = F.col(name)
    for phrase, to in phrases:
        out = F.replace(out, F.lit(phrase), F.lit(to)) if phrase else out
    out = F.trim(F.regexp_replace(out, r"\s{2,}", " "))
    if exact:
        out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]), F.col(name)), out)
    return rows.withColumn(name, out)
