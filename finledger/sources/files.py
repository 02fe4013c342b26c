"""File sources and sinks: S1-S8.  Every write takes a new folder in the shared one (``staging``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import GATEWAYS
from ..schema import BOOKS, MONEY_SUM
from . import records as R
from .staging import new_path, shared_dir, stage_table  # noqa: F401 - part of this module's interface


# --- S1-S3: CSV extracts ----------------------------------------------------
# card and checkout exports keep blank cells as '' (only NA is null); wallets do not
KEEP_BLANKS = {"card": True, "wallet": False, "checkout": True}


def write_extract_csv(df: DataFrame, path: str, *, keep_blanks: bool) -> str:
    """Write an extract the way a gateway export looks (header, quoted text).

    ``keep_blanks`` writes null as ``NA`` so that null and ``''`` both survive.
    """
    w = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if keep_blanks:
        w = w.option("nullValue", "NA")
    w.csv(path)
    return path


def read_extract_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, *, keep_blanks: bool,
                     defaults: dict[str, str | None] | None = None) -> DataFrame:
    """The good records of the files, every column text, picked by the name in
    each file's own header.  ``keep_blanks`` reads like ``fread`` (only ``NA`` is
    null, ``""`` stays empty); otherwise blanks become null as the wallet reader
    makes them.  Without ``columns`` the headers are read first, for their names.
    """
    null_value = "NA" if keep_blanks else ""
    return R.kept(R.read_extract(spark, path, columns, null_value=null_value, defaults=defaults))


# --- S4/S5: report sheets exported as CSV, one file per sheet --------------------
def write_sheets(df: DataFrame, path: str, key: str, order: str, cols: list[str]) -> str:
    """Export one headerless sheet per ``key`` value (rows in ``order``)."""
    (
        df.repartition(key)
        .sortWithinPartitions(key, order)
        .select(key, *cols)
        .write.mode("overwrite")
        .partitionBy(key)
        .option("header", False)
        .option("nullValue", "")
        .option("escape", '"')
        .csv(path)
    )
    return path


def sheet_key(key: str, col: str = "file"):
    """The value of a sheet's folder ``key=value``."""
    return F.regexp_extract(F.col(col), rf"/{key}=([^/]+)/", 1)


def scan_statements(spark: SparkSession, stmts: DataFrame) -> DataFrame:
    """S4 round trip: statements -> one sheet per statement -> (statement_id, line_no, label, value).

    The sheets carry a third cell with a line break in it, as exports do for
    notes; the first two are read by position.
    """
    noted = stmts.withColumn("note", F.concat(F.lit("line "), "line_no", F.lit(',\n"'), "statement_id", F.lit('"')))
    path = write_sheets(noted, new_path(spark, "statements"), "statement_id", "line_no", ["label", "value", "note"])
    back = R.read_sheets(spark, path, ["label", "value"])
    return back.select(
        sheet_key("statement_id").cast("int").alias("statement_id"),
        F.col("row").cast("int").alias("line_no"),
        "label",
        F.col("value").try_cast(MONEY_SUM).alias("value"),
    )


SHEET_MAX_ROWS = 1_000_000  # a spreadsheet holds at most 1,048,576 rows
BOOK_COLUMNS = [f.name for f in BOOKS.fields[:9]]
# The three title rows and the header of a transaction list.
BOOK_TITLES = [
    ["Transaction List by Date"],
    ["Company"],
    ["All Dates"],
    ["Date", "Transaction Type", "Num", "Posting", "Name", "Memo/Description", "Account", "Split", "Amount"],
]


def write_books(sheet: DataFrame, entities: DataFrame, path: str, rows_per_page: int = SHEET_MAX_ROWS) -> str:
    """Book sheets, one folder per entity of ``entities`` (entity), its title rows before its entries.

    One pass over the entries: rows are rebalanced by entity (Spark splits a hot
    one and merges small ones while it runs), and a file ends at ``rows_per_page``.
    """
    titles = F.array(*[
        F.struct(F.lit(i - 4).alias("ord"), *[F.lit(t[k] if k < len(t) else None).cast("string").alias(c)
                                              for k, c in enumerate(BOOK_COLUMNS)])
        for i, t in enumerate(BOOK_TITLES)])
    head = entities.select("entity", F.inline(titles))
    body = sheet.select("entity", F.lit(0).alias("ord"), *BOOK_COLUMNS)
    (
        head.unionByName(body)
        .hint("rebalance", "entity")
        .sortWithinPartitions("entity", "ord")
        .select("entity", *BOOK_COLUMNS)
        .write.mode("overwrite")
        .partitionBy("entity")
        .option("header", False)
        .option("nullValue", "")
        .option("escape", '"')
        .option("maxRecordsPerFile", rows_per_page)
        .csv(path)
    )
    return path


def scan_books(spark: SparkSession, sheet: DataFrame, entities: DataFrame, rows_per_page: int = SHEET_MAX_ROWS) -> DataFrame:
    """S5 round trip: book sheets with 3 title rows and a header, read back with the
    columns named by position (P6).  Title rows have no date, so the window
    filter (F6) drops them, wherever an entity's pages begin."""
    path = write_books(sheet, entities, new_path(spark, "books"), rows_per_page)
    back = R.read_sheets(spark, path, BOOK_COLUMNS)
    return back.select(*BOOK_COLUMNS, sheet_key("entity").cast("int").alias("entity"))


# --- S6: parquet cache of the normalised ledger ------------------------------
def write_ledger_cache(led: DataFrame, path: str) -> str:
    """Partitioned by source and month so filters on either prune files;
    sorted by date inside a file for row-group skipping.  Range partitioning on
    a key ending in the transaction id splits a hot (source, month) over many
    tasks instead of one."""
    (
        led.repartitionByRange("source", "yearmon", "date", "transaction_id")
        .sortWithinPartitions("source", "yearmon", "date")
        .write.mode("overwrite")
        .partitionBy("source", "yearmon")
        .parquet(path)
    )
    return path


def read_ledger_cache(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read the cache back; with a schema the partition columns keep their types
    (``yearmon`` must stay text, not be inferred as a date)."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    df = r.parquet(path)
    return df.select(*[f.name for f in schema.fields]) if schema is not None else df


def _present(spark: SparkSession, path: str) -> bool:
    """Whether a table is there; any error but an absent path (permission, network, a broken file) is raised."""
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).schema.fields)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def load_or_build(spark: SparkSession, path: str, build, prefer_cache: bool = True) -> DataFrame:
    """Cache policy: a present cache wins (no staleness check, like the dashboard);
    only an absent path is built, nothing unreadable is overwritten."""
    from ..schema import LEDGER

    if not (prefer_cache and _present(spark, path)):
        write_ledger_cache(build(), path)
    return read_ledger_cache(spark, path, LEDGER)


def load_or_build_all(spark: SparkSession, path: str, build_ledger, build_failures) -> tuple[DataFrame, DataFrame]:
    """Ledger and failure histogram kept side by side, each under the same policy."""
    from ..schema import FAILURES

    ledger = load_or_build(spark, f"{path}/ledger", build_ledger)
    if not _present(spark, f"{path}/failures"):
        build_failures().write.parquet(f"{path}/failures")
    return ledger, spark.read.schema(FAILURES).parquet(f"{path}/failures")


# --- S7: load report ------------------------------------------------------------
def load_report(spark: SparkSession, union: DataFrame, extra: dict[str, DataFrame] | None = None,
                gateways=GATEWAYS) -> DataFrame:
    """Catalogue of inputs with status and normalised row count.

    Counts are one ``groupBy(source).count()`` over the union, left-joined to
    the fixed catalogue (a handful of rows, broadcast).
    """
    cat = spark.createDataFrame([(s,) for s in list(gateways) + list((extra or {}).keys())], "source string")
    counts = union.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    for name, df in (extra or {}).items():
        counts = counts.unionByName(df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("rows")))
    j = cat.join(F.broadcast(counts), "source", "left")
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    return j.select(
        "source", F.when(rows > 0, F.lit("loaded")).otherwise(F.lit("missing")).alias("status"), rows.alias("rows")
    )


# --- S8: CSV export ------------------------------------------------------------
def export_csv(df: DataFrame, path: str) -> str:
    """Header CSV; nulls written as ``NA`` like R's ``write.csv``; order not promised."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)
    return path


def read_back_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an export back and restore the column types by name."""
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
