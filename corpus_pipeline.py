"""From raw documents to token ids: five stages, each one of the operators of ``oddsloom.llm``.

Every stage gets all rows that the one before it kept, written as Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom import reachable
from oddsloom.llm.cluster import new_folder
from oddsloom.llm.decontaminate import without_leaks
from oddsloom.llm.language_id import in_known_language, learn_languages
from oddsloom.llm.ngram_jaccard import without_near_copies
from oddsloom.llm.piece_codec import token_columns
from oddsloom.llm.toxicity import toxicity_scorer

#: Near copies: shingles of five words, similarity 0.8 and more.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80
TOXIC_FROM = 0.5
#: The last stage's tasks remember a quarter of what they could: executors still hold what four stages before them left.
THRIFT = 4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity_scorer(docs, labels)
    return docs.where(score(F.col("text")) < TOXIC_FROM)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go, and those in another one than they declare. ``lang`` counts as declared, ``source`` as host."""
    return in_known_language(docs, *learn_languages(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return without_near_copies(docs, "doc_id", "text", SHINGLE_WORDS, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the text they decode to."""
    return token_columns(docs, public_tokenizers.path("piece_bpe_32k.model"), thrift=THRIFT)


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: SQL can express neither the models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    reachable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
