"""Small document tables for the tests of the llm subpackage."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "b", "c", "d", "e"]) for _ in range(n))


def edited(rng: random.Random, text: str, times: int) -> str:
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed: int = 3) -> list[tuple]:
    """Texts with copies, near copies, shared passages, nulls, empty and long ones, repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts: list[str | None] = [None, "", "  \n\t ", "one", "one two three four", "One two THREE four five", "é ü 中文   😀"]
    base = prose(rng, 120)
    texts += [base, base, base.upper()] + [edited(rng, base, k) for k in (1, 2, 3, 4, 8, 30)]
    texts += [prose(rng, 40) + " " + passage + "\n" + prose(rng, 30) for _ in range(6)]
    texts += ["spam " * 200, "spam " * 230, prose(rng, 6000), prose(rng, 12) + " " + passage]
    texts += [prose(rng, rng.randrange(5, 200)) for _ in range(25)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[5], (None, base, None, None, None), (None, None, None, None, None)]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(corpus() if rows is None else rows, schema).repartition(3)


def clashing(df):
    """df with more columns, named like those that operators make for themselves."""
    from pyspark.sql import functions as F

    names = ["key", "body", "id", "node", "n", "comp", "row", "blob", "spans", "bucket", "severity", "x", "y", "template", "near", "uid", "_gone", "_digest", "_id", "a.b", "odd`name", "place", "first"]
    return df.select("*", *[F.lit("clash").alias(c) for c in names])
