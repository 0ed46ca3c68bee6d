"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept. Between stages the rows are written as Parquet and read again. All but the last
return the columns of documents. Rows keep their columns through the first four stages, and an empty table
passes through all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.llm import decontam, language_id, mixing, queries, simhash, token_output
from signalweave.llm.common import cleaned, fold, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the model learns from the rows outside fold 2 of 4.

    Null and empty texts and texts without a letter are rejected; rows that repeat an id are judged one by one, by their whole texts.
    """
    return language_id.keep_identified(docs, language_id.fit(docs, fold(F.col("doc_id"), 4) != 2))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies, by fingerprints and sets of five-word shingles.

    Null and empty texts are copies of each other. Rows that repeat an id share its fate, rows without an id stay.
    """
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows that repeat an id, null included, go if one of them has one."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or twice. Null sources are one source, null texts have no words."""
    return mixing.apply_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from the written token ids; null texts have the end id alone."""
    return token_output.document_index(token_output.write(docs, queries.tokenizer_file()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL has no character models, fingerprints or tokenizers; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. Tables that a stage made for itself go once its rows are written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with cleaned(spark):
            stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
