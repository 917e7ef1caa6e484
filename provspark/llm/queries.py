"""The operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provspark.llm import best_fit, line_dedup, manifest, mixing, mtree, nn_descent, packing, pii, repair, simhash, toxicity, warc, wrapper
from provspark.llm.common import table


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op2_query(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op3_query(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4_query(table(spark, sf_dir, "documents"))


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op5_query(table(spark, sf_dir, "pages"))


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.op6_query(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op8_query(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.word_bpe_path())


def op10_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.op10_query(table(spark, sf_dir, "pages"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.op11_query(table(spark, sf_dir, "documents"), packing.word_bpe_path())


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.op12_query(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op13_query(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nn_descent, op2_line_dedup, op3_simhash, op4_mixing, op5_warc_audit,
        op6_mtree, op7_toxicity, op8_surrogates, op9_packing, op10_wrapper,
        op11_best_fit, op12_manifest, op13_repair,
    )
}

SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_warc_audit": warc.OP5_SQL,
    "op6_mtree": mtree.OP6_SQL,
    "op12_manifest": manifest.OP12_SQL,
    "op13_repair": repair.OP13_SQL,
}
