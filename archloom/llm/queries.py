"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.llm import bpe, chat, embed_dedup, exact_dedup, langid, line_dedup, ngram_join, packing, pii, toxicity
from archloom.llm.common import learned_split

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The key of the queries' pseudonyms; a real corpus needs one of its own that stays secret.
PII_KEY = "archloom"
CLASH = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bpe.serialise_model(bpe.read_ranks(public_tokenizers.path(VOCABULARY)))
    return bpe.round_trip(table(spark, sf_dir, "documents"), model, public_tokenizers.PATTERN)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, how many values were replaced, and their kinds."""
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    kinds = F.array_join(F.array_sort(F.transform("pii", lambda x: x["kind"])), ",")
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), kinds.alias("kinds"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CLASH), (-7, 1, "assistant", CLASH)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(own)))


def token_counts(docs: DataFrame) -> DataFrame:
    """docs with the number of ids of op1 (n_tokens) in place of the text."""
    return bpe.token_counts(docs, bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")), F.col("n_tokens"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=learned_split("doc_id", 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model, into="score")
    return scored.select("doc_id", (learned_split("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.learn(docs, usable=learned_split("doc_id", 4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", (learned_split("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_pii, op3_exact_dedup, op4_embedding_dedup, op5_ngram_join, op6_chat_format, op7_packing, op8_toxicity, op9_line_dedup, op10_language_id)}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
