"""The corpus pipeline: documents in, token ids of the documents that stay out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared
folder and read again as the next one's documents. Stages keep the columns of their input, but the last.

Defined results: null and empty texts pass the stages that find nothing in them (no near copy, no
contamination, no secret) and are encoded as begin and end id; the classifier gives them the score 0; an
empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import decontaminate, ngram_join, piece_codec, quality, secrets
from labelloom.llm.common import table
from labelloom.llm.queries import tokenizer_path
from labelloom.session import stage_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least one half."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component on 5-word shingles with a Jaccard of 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 5 % of their words in 13-word windows of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    return secrets.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (with begin and end) of every document."""
    model = piece_codec.model_bytes(tokenizer_path("piece_bpe_32k.model"))
    return piece_codec.encode_texts(docs, model, decoded=False, packed=False)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("contamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encoding", encode),
]

#: The classifier's fit and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
