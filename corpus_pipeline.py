"""A corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixing and token files.

Each stage takes and returns a DataFrame; what it returns is written as Parquet and reread as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import chosen_path, mixing, templates, token_blocks, toxicity
from hindcast.llm.catalog import END_ID, vocabulary
from hindcast.llm.common import small_batches, stage, table

#: Shingle words and similarity at which documents are near-duplicates.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: Narrow rows about documents that may travel to the texts; more of them are joined by shuffling both.
BROADCAST_ROWS = 1_000_000


def beside(rows: DataFrame) -> DataFrame:
    """Written ``rows`` of an identifier and a number, to be broadcast only if their count allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic, by a model of the labelled ones among them."""
    small_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model).where(F.col("score") < 0.5).select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.

    Of rows that share a doc_id all or none stay. Only identifiers of rows that go are joined.
    """
    small_batches(spark)
    found = chosen_path.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    gone = stage(found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(beside(gone), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark or of its templates."""
    small_batches(spark)
    found = templates.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("item_ids") == 0).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    small_batches(spark)
    taken = stage(mixing.mix_documents(docs).groupBy("doc_id").agg(F.max("copies").cast("int").alias("_copies")))
    rows = docs.join(beside(taken.withColumnRenamed("doc_id", "_id")), F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))).where("_copies > 0")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the token files written: place, length and checksum of their ids."""
    small_batches(spark)
    return token_blocks.token_digest(docs, vocabulary(), END_ID)


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("token_files", tokens),
]

#: A learned model, trees and a tokenizer are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
