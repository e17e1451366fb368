"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage gets the rows that the one before it kept, written as Parquet and read again, and its decisions take effect.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.llm import exact_dedup, ngram_join, packing, pii, toxicity
from archloom.llm.common import free, learned_split
from archloom.llm.queries import PII_KEY, table, token_counts
from archloom.session import own_folder, remove


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half; it learns from the same rows as op8. Null texts count as empty."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=learned_split("doc_id", 5) != 0)
    (score,) = free(docs, "_score")
    return toxicity.score(docs, model, into=score).where(F.col(score) < 0.5).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the greatest doc_id; null counts as empty, so one of those rows stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the least doc_id; rows without words or doc_id all stay."""
    return ngram_join.drop_near_copies(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with pseudonyms in its text and n_chars to match; null texts stay null, with null n_chars."""
    (values,) = free(docs, "_values")
    done = pii.pseudonymise(docs, PII_KEY, values=values).drop(values)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row, by the ids of op1; rows without tokens have no bin."""
    return packing.pack(token_counts(docs.select("doc_id", "text")), F.col("n_tokens"))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_copies), ("n-gram join", drop_near_copies), ("pii", replace_pii), ("packing", pack)]

#: Learned scores, keyed permutations and the packing search have no SQL form; tests compare run() with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir. What stages write goes to the shared folder, and goes from
    there as soon as the next stage is written; the last one's rows stay. Null and empty texts, repeated rows and empty tables
    are treated as each stage says; columns that documents have besides go with the rows up to the last stage."""
    docs = table(spark, sf_dir, "documents")
    folder = own_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
