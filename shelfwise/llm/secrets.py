"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The
ledger is a table in a shared folder with a row for each (blob, kind of rule, rule version)
that was scanned, and the spans found. A scan first takes the blobs' names against the
ledger, then scans the contents of blobs that lack a row, once for each blob however many
paths hold it and only by the rules that it lacks, and appends what it scanned. Findings are
read from the ledger and joined back to all paths. DataFrame expressions only.

Positions come from the pieces between the matches: the lengths of pieces and matches in
turn add up to each match's start, in code points.

A scan that fails before its rows are committed leaves the ledger as it was, and the next one
does the work again; rows that two scans wrote at once are the same and count once.

Nulls: a null text is an empty one; a null path is a path. Repeated rows share a blob and
are each returned. Very long texts and very many matches take time in proportion. Ties in a span's start go by
kind, as listed. An empty table gives no rows. Only the path and text columns are read,
so other columns may have any names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.state import exists, shared_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if group number `group` has `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: Longer runs than asked for are taken whole, so the two patterns with a least count find
#: what the same pattern with "+" finds once its short matches are dropped.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)

SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob binary, kind string, version int, spans {SPANS}"
#: Matches that are added up at once.
BLOCK = 256
#: Names of unseen blobs (32 bytes each) that may be sent to all tasks.
SENT_BLOBS = 200_000


def find_spans(text: Column, rule: Rule) -> Column:
    """The spans of one rule in a text: leftmost, not overlapping, the failing ones dropped.

    Matches are added up in blocks of BLOCK and the blocks then put one after the other, so
    that very many matches do not make an array grow one by one.
    """
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    tests = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    empty = F.array().cast(SPANS)
    shift = lambda spans, by: F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["test"]) >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def put(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["found"], F.array(shift(block["found"], acc["at"]))).alias("found"))

    begin = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def add_up(rows: Column) -> Column:
        each = F.transform(in_blocks(rows), lambda block: F.aggregate(block, begin, step))
        return F.flatten(F.aggregate(each, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("found")), put)["found"])

    # the text is searched once, and every block is cut from what was found
    zipped = let(hits, lambda h: F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), 1, F.size(h)).alias("piece"), h.alias("hit"), (tests if rule.group else h).alias("test")))
    return F.when(text.rlike(rule.pattern), let(zipped, add_up)).otherwise(empty)


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(rows: Column) -> Column:
    """An array's entries in arrays of BLOCK, one at least."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(rows, i, BLOCK))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], LEDGER)


def known(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rows of a ledger that some rules in their present versions have no need to make again."""
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    return ledger.where(F.array_contains(wanted, F.struct("kind", "version")))


def scan(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the ledger lacks: blob, kind, version and spans of unseen (blob, rule) pairs.

    Names of blobs are compared before any content moves. If few blobs are unseen, their names
    are sent to the contents, and those of seen blobs are not even shuffled.
    """
    contents = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    seen = known(ledger, rules)
    if seen.isEmpty():
        fresh = contents.groupBy("blob").agg(F.first("content").alias("content")).withColumn("have", F.array().cast("array<string>"))
    else:
        have = seen.groupBy("blob").agg(F.collect_set("kind").alias("have"))
        names = contents.select("blob").distinct().join(have, "blob", "left")
        unseen = names.where(F.coalesce(F.size("have"), F.lit(0)) < len(rules)).select("blob", F.coalesce("have", F.array().cast("array<string>")).alias("have"))
        few = unseen.limit(SENT_BLOBS + 1).count() <= SENT_BLOBS
        found = contents.join(F.broadcast(unseen) if few else unseen, "blob")
        fresh = found.groupBy("blob").agg(F.first("content").alias("content"), F.first("have").alias("have"))
    each = [
        F.when(~F.array_contains("have", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), find_spans(F.col("content"), r).alias("spans")))
        for r in rules
    ]
    return fresh.select("blob", F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))


def update_ledger(versions: DataFrame, folder: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger in a shared folder lacks, appends it, and returns the ledger."""
    spark = versions.sparkSession
    scan(versions, read_ledger(spark, folder), text, rules).write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def ledger_folder(spark: SparkSession) -> str:
    """Where spark.shelfwise.secretLedger says; where it is unset a new, empty ledger for each scan."""
    return spark.conf.get("spark.shelfwise.secretLedger", None) or f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"


def all_spans(rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of all kinds by start, then kind as listed: array of (start, rank, end, kind)."""

    def labelled(rank: int, rule: Rule) -> Column:
        return F.transform(F.col(rule.kind), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    return F.array_sort(F.concat(*[labelled(i, r) for i, r in enumerate(rules)]))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def found_in_blobs(versions: DataFrame, text: str = "text", folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans (start, rank, end, kind) of the distinct texts that have any, from the updated ledger.

    Of a ledger that held rows before, only those of blobs that are in versions are gathered.
    """
    spark = versions.sparkSession
    folder = folder or ledger_folder(spark)
    held = exists(spark, folder)
    ledger = known(update_ledger(versions, folder, text, rules), rules).where(F.size("spans") > 0)
    if held:
        ledger = ledger.join(versions.select(blob_of(F.col(text)).alias("blob")).distinct(), "blob", "left_semi")
    each = [F.coalesce(F.first(F.when(F.col("kind") == r.kind, F.col("spans")), ignorenulls=True), F.array().cast(SPANS)).alias(r.kind) for r in rules]
    return ledger.groupBy("blob").agg(*each).select("blob", all_spans(rules).alias("spans"))


def scan_paths(versions: DataFrame, path: str = "doc_id", text: str = "text", folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path and spans (start, rank, end, kind) of every version, null where there are none.

    Findings come from a table and paths from another, two plain sides of a join, so Spark can
    split the paths of one hot blob over tasks.
    """
    paths = versions.select(F.col(path), blob_of(F.col(text)).alias("blob"))
    return paths.join(found_in_blobs(versions, text, folder, rules), "blob", "left").select(path, "spans")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each span (or run of overlapping spans, by start) replaced by mark.

    What is kept lies between the spans. They are taken in blocks, which start where all blocks
    before them have ended; a block's text is cut out first and the pieces out of that, so the
    text is not gone through from its beginning for each.
    """
    none = F.array().cast(SPANS)

    def step(acc: Column, s: Column) -> Column:
        # at: where the rest of the text begins; kept: what stands before each mark
        fresh = F.when(s["start"] >= acc["at"], F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end")))).otherwise(none)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["kept"], fresh).alias("kept"))

    def cut(kept: Column) -> Column:
        first = F.get(kept, F.lit(0))["start"]
        held = text.substr(first + 1, F.element_at(kept, -1)["end"] - first)
        said = let(held, lambda h: F.array_join(F.transform(kept, lambda p: F.concat(h.substr(p["start"] - first + 1, p["end"] - p["start"]), F.lit(mark))), ""))
        return F.when(F.size(kept) > 0, said).otherwise("")

    def done(x: Column) -> Column:
        def block(rows: Column, i: Column) -> Column:
            at = F.greatest(F.lit(0), F.array_max(F.slice(x["ends"], 1, i)))
            return let(F.aggregate(rows, F.struct(at.alias("at"), none.alias("kept")), step)["kept"], cut)

        end = F.array_max(x["ends"])
        return F.concat(F.array_join(F.transform(x["blocks"], block), ""), text.substr(end + 1, F.greatest(F.length(text) - end, F.lit(0))))

    blocks = let(in_blocks(spans), lambda b: F.struct(b.alias("blocks"), F.transform(b, lambda rows: F.array_max(F.transform(rows, lambda s: s["end"]))).alias("ends")))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, let(blocks, done)).otherwise(text)


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, scanned once for each distinct text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    said = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = [count_of(spans, r.kind).alias(f"n_{r.kind}") for r in RULES]
    return scan_paths(docs).select("doc_id", *count, F.sha2(said, 256).alias("base_sha256"), said.alias("spans"))


def _duck_spans(rule: Rule, rank: int) -> str:
    """DuckDB text for the spans of one rule: list of structs by position."""
    pattern = rule.pattern.replace("'", "''")
    group = f"regexp_extract_all(t, '{pattern}', {rule.group})"
    return f"""list_filter(list_transform(generate_series(1, len(regexp_extract_all(t, '{pattern}', 0))), lambda i: {{
        'start': (coalesce(list_sum(list_transform(regexp_split_to_array(t, '{pattern}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}', 0)[1:i-1], lambda x: length(x))), 0))::bigint,
        'rank': {rank},
        'end': (coalesce(list_sum(list_transform(regexp_split_to_array(t, '{pattern}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}', 0)[1:i], lambda x: length(x))), 0))::bigint,
        'kind': '{rule.kind}', 'size': length({group}[i])}}), lambda s: s.size >= {rule.least})"""


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_sort({_duck_spans(RULES[0], 0)} || {_duck_spans(RULES[1], 1)} || {_duck_spans(RULES[2], 2)}) AS spans FROM d),
o AS (SELECT doc_id, spans, coalesce(array_to_string(list_transform(spans, lambda s: s.kind || ':' || s.start || ':' || s."end"), ','), '') AS said FROM s)
SELECT doc_id, len(list_filter(spans, lambda s: s.kind = 'assign')) AS n_assign, len(list_filter(spans, lambda s: s.kind = 'access')) AS n_access,
       len(list_filter(spans, lambda s: s.kind = 'hex')) AS n_hex, sha256(said) AS base_sha256, said AS spans
FROM o
"""
