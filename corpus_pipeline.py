"""Corpus preparation: the stages in order, each writing its documents for the next.

toxicity -> line removal -> Jaccard join -> benchmark decontamination -> packing.
Every stage but the last returns the columns of ``documents``; where a stage
cuts a text, ``n_chars`` follows.

Defined results: null and empty texts pass every filter and pack as an end id
alone; rows with equal key and text become one at the Jaccard join; rows that
differ in key but not in text become one there as well (a null key goes before
another);
a null source keeps its lines; empty tables pass through; extra columns are
kept up to the packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finledger.llm import decontaminate, jaccard, linededup, packing, toxicity
from finledger.llm.common import shared_dir, table


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(linededup.clean_documents(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]
ORACLE_SQL = None  # compression lengths, retrieval order and tokens have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written and read again, so a lost executor costs one stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/finledger-llm/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
