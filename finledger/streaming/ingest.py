"""Incremental ledger ingest with Structured Streaming.

The dashboard reloads its extract files at start-up.  Here a folder per gateway
receives extract files as they are exported; a file-source stream picks up only
the new ones, runs the same normaliser as the batch path, applies the fiscal
window and appends to the ledger table partitioned by ``source`` and ``yearmon``
(the S6 layout).  Progress is kept in a checkpoint under the shared folder, so a
restarted job neither skips nor duplicates a file.  ``availableNow`` processes
what is there and stops, which suits a scheduled refresh; a processing-time
trigger keeps it running.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exprs as X
from ..operators import ledger as L
from ..operators import normalize as N
from ..params import CARD, CHECKOUT, Params
from ..sources.files import KEEP_BLANKS

#: a file counts however old its time stamp is: beyond any delivery
MAX_FILE_AGE = "36500d"


def _normaliser(kind: str, source: str) -> Callable[[DataFrame], DataFrame]:
    if kind == "card":
        return lambda df: N.normalize_card(df.select(*[F.col(f"`{c}`") for c in N.CARD_COLUMNS]), source or CARD)
    if kind == "wallet":
        return lambda df: N.normalize_wallet(df, source)
    if kind == "checkout":
        return lambda df: N.normalize_checkout(df, source or CHECKOUT)
    raise ValueError(kind)


def extract_stream(spark: SparkSession, drop_dir: str, kind: str, source: str,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of normalised ledger rows from a folder of CSV extracts.

    A file stream needs its schema up front: the header names are taken from the
    files already present (every column text), and ``enforceSchema=false`` makes
    Spark check each new file's header against them instead of binding blindly
    by position.
    """
    keep = KEEP_BLANKS[kind]
    probe = spark.read.option("header", True)
    if keep:
        probe = probe.option("nullValue", "NA")
    schema = probe.csv(drop_dir).schema
    r = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .option("multiLine", True)
        .option("maxFileAge", MAX_FILE_AGE)
    )
    if keep:
        r = r.option("nullValue", "NA")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return _normaliser(kind, source)(r.csv(drop_dir))


def ledger_stream(streams: list[DataFrame], p: Params) -> DataFrame:
    """Union of the gateways' normalised streams, windowed, with calendar columns
    (all stateless, so each micro-batch is processed on its own)."""
    u = N.union_extracts(streams)
    return L.with_calendar(u.where(X.in_range("date", p.fiscal_from, p.fiscal_to)))


def start_ledger_ingest(stream: DataFrame, table_path: str, checkpoint: str,
                        available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Append to the ledger table with the file sink: its commit log makes the
    output exactly-once (a replayed micro-batch never adds its files twice) and
    readers only see committed files."""
    w = (
        stream.writeStream.format("parquet")
        .partitionBy("source", "yearmon")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def ingest_folders(spark: SparkSession, folders: dict[str, tuple[str, str]], table_path: str,
                   checkpoint: str, p: Params) -> StreamingQuery:
    """One query over every gateway folder ``{source: (kind, folder)}``, run to completion."""
    streams = [extract_stream(spark, folder, kind, source) for source, (kind, folder) in folders.items()]
    q = start_ledger_ingest(ledger_stream(streams, p), table_path, checkpoint)
    q.awaitTermination()
    return q
