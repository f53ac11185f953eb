"""The corpus pipeline: documents in, clean and tokenised documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns that docs has. Rows are judged by id and text, so those that repeat an id or have
none do not go for another's text; of a group of near copies one row stays. Null texts pass
every filter and have no tokens. Extra columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import bpe, decontaminate, jaccard, secrets, toxicity
from shelfwise.llm.state import checkpointed, row_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, learned from the labels, does not find toxic."""
    grades = toxicity.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, toxicity.learn(docs, grades))


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, so none can clash with ours) and key of every row."""
    return docs.select(F.struct("*").alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("key"))


def same_key(a: str, b: str) -> Column:
    return F.col(f"{a}.key.id").eqNullSafe(F.col(f"{b}.key.id")) & (F.col(f"{a}.key.digest") == F.col(f"{b}.key.digest"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key is in gone (column key)."""
    left = keyed(docs).alias("d").join(gone.select("key").alias("g"), same_key("d", "g"), "left_anti")
    return left.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the first by id (null last), digest of the text and place."""
    found = jaccard.components(docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text"), "key")
    in_groups = found.where("n_shingles > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("first"))
    # rows that go, and keys of which one row stays
    odd = checkpointed(in_groups.select("key", (F.col("key") != F.col("first")).alias("gone"), "n").where("gone or n > 1"))
    out = without(docs, odd)
    twice = odd.where("not gone").select("key")
    if twice.isEmpty():
        return out
    own = keyed(docs).withColumn("place", F.monotonically_increasing_id()).alias("d").join(twice.alias("t"), same_key("d", "t"), "left_semi")
    # partial results before the shuffle: a hot key comes down to a row a task
    first = own.groupBy("key").agg(F.min_by("row", "place").alias("row"))
    return out.unionByName(first.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    found = decontaminate.leaks(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, checkpointed(found.select("key").distinct()))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and their lengths counted anew."""
    found = checkpointed(secrets.found_in_blobs(docs.select("text")))
    rows = docs.select(F.struct("*").alias("row"), secrets.blob_of(F.col("text")).alias("blob")).join(found, "blob", "left")
    # inline: the redacted text is made once, for itself and for its length
    new = rows.select("row", F.col("spans").isNotNull().alias("changed"), F.inline(F.array(F.struct(secrets.redact(F.col("row.text"), F.col("spans")).alias("text")))))
    length = F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return new.select(F.col("row").withField("text", F.col("text")).withField("n_chars", length).alias("row")).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document."""
    return bpe.encode_texts(docs, *bpe.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("bpe", tokenize),
]

#: No stage but the fourth can be said in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; what a stage returns is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
