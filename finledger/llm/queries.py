"""The registered queries: one per operator, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, decontaminate, jaccard, linededup, merkle, mixing, packing, pii, quality, sharding, tokens, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, "finledger").withColumnRenamed("__n", "n_entities")


def op2_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.clean_pages(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.tokenizer_file())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op7_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), ["doc_id"], 8)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


def op12_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, sf_dir, "documents"))


def op13_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_surrogates": op1_surrogates,
    "op2_site_lines": op2_site_lines,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_stable_projections": op5_stable_projections,
    "op6_weak_labels": op6_weak_labels,
    "op7_bm25_packing": op7_bm25_packing,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_jump_sharding": op10_jump_sharding,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_merge_path_alignment": op12_merge_path_alignment,
    "op13_pareto_mix": op13_pareto_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op2_site_lines": linededup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_pareto_mix": mixing.SQL,
}
