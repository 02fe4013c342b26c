"""Tables staged in the shared folder named by ``spark.checkpoint.dir``.

Every write goes to a new sub-folder there.  Only when the setting is unset, on a
local master (tests), is a fresh scratch folder made and registered.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one only on a local master."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="finledger-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    return d


def new_path(spark: SparkSession, name: str) -> str:
    base = shared_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}finledger/{name}-{uuid.uuid4().hex}"


def stage_table(spark: SparkSession, df: DataFrame, name: str,
                partition_by: str | list[str] | None = None, within: list[str] | None = None) -> DataFrame:
    """Write a stage to the shared folder as Parquet and read it back (lineage cut).

    ``partition_by`` (low-cardinality columns) lets later filters prune files.
    With ``within`` (finer keys) the rows are first range-partitioned on
    ``partition_by + within``: each task writes a contiguous run of partition
    folders (few files per folder) and a hot folder is split over several tasks
    by the finer keys; rows are sorted by those keys inside each file.
    """
    path = new_path(spark, name)
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if parts and within:
        df = df.repartitionByRange(*parts, *within).sortWithinPartitions(*parts, *within)
    w = df.write.mode("overwrite")
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
