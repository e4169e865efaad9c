"""A pipeline from raw documents to token ids, of five of the operators in ``loomspark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage's result is written as Parquet and read again as the next one's ``docs``.
Nulls, empty texts, repeated rows and further columns are treated as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import byte_bpe, exact_dedup, langid, mixing, ngram_join
from loomspark.llm.queries import remainder
from loomspark.llm.scratch import Scratch

#: The least score of a prediction that is believed. The winner of a duel has 0.5 or more.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a recognizable language: no letter, or no language that wins."""
    return langid.with_language(docs, langid.train(docs, remainder("id", 4) != 2), SURE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out exact copies; the largest doc_id of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document, that of the smallest doc_id, of each group that n-gram links connect."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources by weight: a document stands once, twice or not at all."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_ok): the token ids, and whether they decode to the text."""
    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=True)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("decoded_ok"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: SQL can express neither the language models nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs
