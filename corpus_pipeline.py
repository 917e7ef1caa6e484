"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm import line_dedup, mixing, packing, simhash, toxicity
from provspark.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts.

    Null and empty texts are scored as texts without hits; null ids teach
    nothing; repeated rows are scored alike; an empty table gives no rows;
    further columns pass through (``_tox_`` names are reserved).
    """
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars follows the text.

    Null and empty texts stay as they are; repeated rows are one document, of
    which each row keeps its first occurrences; an empty table gives no rows;
    further columns pass through (``_line_`` names are reserved).
    """
    out = line_dedup.dedup_lines(docs)
    changed = F.when(F.col("_line_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a similarity of 0.8 or more.

    The smallest id stays, of its rows one. Null texts, empty ones and those
    without words are alike, one of them stays; a group of null ids only keeps
    one row; an empty table gives no rows; further columns pass through
    (``_sim_`` names are reserved).
    """
    return simhash.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training order of the mix; documents taken twice appear twice.

    Null and empty texts hold no words to take and go; a null source is a
    source of its own; an empty table gives no rows; further columns pass
    through (``_mix_`` names are reserved).
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids.

    Null and empty texts are their end id alone; null and repeated ids are
    documents of their own; an empty table gives no rows.
    """
    return packing.pack(docs, packing.word_bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained scores, fingerprints and tokenizers have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages stay in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
