"""Registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidegrid.llm import (audit, bpe, host_rules, hyperminhash, language_id, line_dedup, mixing, nn_descent, oracles, packing, ranking, sharding, suffix_dedup,
                          toxicity)
from tidegrid.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op2_line_dedup": oracles.LINE_DEDUP,
    "op6_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op7_hyperminhash": oracles.HYPERMINHASH,
    "op8_host_rules": oracles.HOST_RULES,
    "op11_sainte_lague": oracles.SAINTE_LAGUE,
    "op12_retraction_audit": oracles.RETRACTION_AUDIT,
    "op13_dual_tree": oracles.DUAL_TREE,
}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"),
                             public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_similar_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.neighbour_report(read_table(spark, sf_dir, "embeddings"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(read_table(spark, sf_dir, "documents"))


@query
def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicate_report(read_table(spark, sf_dir, "documents"))


@query
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge_documents(read_table(spark, sf_dir, "documents"))


@query
def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(read_table(spark, sf_dir, "documents"))


@query
def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


@query
def op11_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


@query
def op12_retraction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(spark, f"{sf_dir}/documents.parquet", read_table(spark, sf_dir, "labels"))


@query
def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
