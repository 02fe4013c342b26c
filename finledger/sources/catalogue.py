"""Tolerant load of a catalogue of extract files and sheets (S1-S5 + S7).

Each catalogue entry names a gateway, the kind of its export and a path (a file
or a folder of files).  An extract is loaded in one pass: its files are read
record by record under their own headers (``records``), written to the shared
folder, and counted while they are written (``DataFrame.observe``).  What cannot
be loaded is recorded and the load goes on: ``missing`` for a path that does not
exist, ``empty`` for one without records, ``unreadable`` with the reason for
files that cannot be read.  Any other failure is raised.  Records that are none
(too few or too many cells, a quote that never closes) are kept with file, line
and reason.  A gateway may have any number of entries.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import normalize as N
from ..params import Params
from ..schema import BOOKS, LEDGER_BASE, MONEY_SUM, empty
from . import files as FS
from . import records as R


@dataclass(frozen=True)
class Entry:
    source: str  # gateway of an extract; any name for a sheet
    kind: str  # extracts: "card", "wallet", "checkout"; sheets: "books", "statement", "vendors"
    path: str


EXTRACTS = ("card", "wallet", "checkout")
#: sheets have no header of their own: cells by position
SHEETS = {"books": [f.name for f in BOOKS.fields[:9]], "statement": ["label", "value"], "vendors": [f"_c{i}" for i in range(10)]}
REPORT = "source string, kind string, path string, status string, read long, rejected long, rows long, reason string"
REJECTS = "entry int, source string, file string, line_no long, reason string, text string"


def read_extract(spark: SparkSession, kind: str, paths: str | list[str]) -> DataFrame:
    """Every record of the files with the columns of its kind and the reader's own (``records.read_extract``)."""
    how = N.EXTRACT_COLUMNS[kind]
    return R.read_extract(spark, paths, list(how), null_value="NA" if FS.KEEP_BLANKS[kind] else "", defaults=how)


@dataclass(frozen=True)
class Loaded:
    """One entry after its load; ``rows`` are those that its normaliser keeps."""

    entry: Entry
    status: str
    data: DataFrame | None = None
    read: int = 0
    rejected: int = 0
    rows: int = 0
    reason: str | None = None


def unreadable(err: Exception) -> tuple[str, str | None] | None:
    """(status, reason) of a failure to read; None for any other failure."""
    if isinstance(err, AnalysisException):
        if err.getCondition() == "PATH_NOT_FOUND":
            return "missing", None
        if err.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return "empty", None
    text = str(err)
    for mark in ("FAILED_READ_FILE", "CANNOT_READ_FILE", "AccessControlException", "Permission denied"):
        if mark in text:
            at = text.index(mark)
            return "unreadable", text[at:].splitlines()[0][:300]
    return None


def load_entry(spark: SparkSession, e: Entry, path: str) -> Loaded:
    """Reads, counts and stores one extract as a table at ``path``."""
    try:
        raw = read_extract(spark, e.kind, e.path)
        good = F.col("__why").isNull()
        kept = N.KEPT[e.kind]()
        seen = Observation()
        counted = raw.observe(
            seen, F.count(F.lit(1)).alias("read"), F.count(F.when(~good, 1)).alias("rejected"),
            F.count(F.when(good & F.coalesce(kept, F.lit(False)), 1)).alias("rows"))
        counted.write.parquet(path)
        data = spark.read.schema(raw.schema).parquet(path)
        n = seen.get
    except (PySparkException, Py4JJavaError) as err:
        if (why := unreadable(err)) is None:
            raise
        return Loaded(e, why[0], reason=why[1])
    if not n["read"]:
        return Loaded(e, "empty")
    return Loaded(e, "loaded", data, n["read"], n["rejected"], n["rows"])


@dataclass(frozen=True)
class Load:
    """All entries of a catalogue after their load."""

    spark: SparkSession
    root: str
    entries: tuple[Loaded, ...] = field(default_factory=tuple)

    def raw(self, i: int) -> DataFrame:
        return R.kept(self.entries[i].data)

    def present(self) -> list[int]:
        return [i for i, x in enumerate(self.entries) if x.data is not None]

    def report(self) -> DataFrame:
        """One line per entry, in order: what was read, rejected and kept; no job."""
        return self.spark.createDataFrame(
            [(x.entry.source, x.entry.kind, x.entry.path, x.status, x.read, x.rejected, x.rows, x.reason) for x in self.entries], REPORT)

    def rejects(self) -> DataFrame:
        """Every rejected record: entry (its place in the catalogue), source, file, line_no, reason, text."""
        parts = [R.rejects(self.entries[i].data).select(
            F.lit(i).alias("entry"), F.lit(self.entries[i].entry.source).alias("source"), "file", "line_no", "reason", "text")
            for i in self.present()]
        return N.union_extracts(parts) if parts else self.spark.createDataFrame([], REJECTS)

    def tagged(self) -> DataFrame | None:
        """The good records of all extracts as one table (``normalize.TAGGED_COLUMNS``); None without any.

        The entries' tables are folders of one partitioned table, so any number
        of gateways is one scan.
        """
        here = [i for i in self.present() if self.entries[i].entry.kind in EXTRACTS]
        if not here:
            return None
        schema = ", ".join(f"`{c}` string" for c in [*N.TAGGED_COLUMNS[2:], "__why"]) + ", entry int"
        rows = self.spark.read.schema(schema).parquet(self.root).where(F.col("__why").isNull())
        of = lambda what: F.create_map(*[F.lit(x) for i in here for x in (i, what(self.entries[i].entry))])[F.col("entry")]
        return rows.select(of(lambda e: e.source).alias("source"), of(lambda e: e.kind).alias("kind"),
                           *[F.col(f"`{c}`") for c in N.TAGGED_COLUMNS[2:]])

    def union(self) -> DataFrame:
        tagged = self.tagged()
        return empty(self.spark, LEDGER_BASE) if tagged is None else N.normalize_tagged(tagged)


#: entries loaded at the same time, so that small files do not wait for each other's jobs
TOGETHER = 8


def load(spark: SparkSession, entries: list[Entry]) -> Load:
    """Loads the extracts and sheets of a catalogue, each entry by a job of its own."""
    root = FS.new_path(spark, "load")

    def one(i: int) -> Loaded:
        e = entries[i]
        return load_entry(spark, e, f"{root}/entry={i}") if e.kind in EXTRACTS else load_sheets(spark, e)

    with ThreadPoolExecutor(TOGETHER) as pool:
        return Load(spark, root, tuple(pool.map(one, range(len(entries)))))


def load_extracts(spark: SparkSession, entries: list[Entry], p: Params) -> tuple[DataFrame, DataFrame]:
    """(ledger of the present extracts, load report of every entry)."""
    loaded = load(spark, entries)
    return L.ledger([loaded.union()], p), loaded.report().select("source", "path", "status", "rows", "read", "rejected", "reason")


# --- sheets ---------------------------------------------------------------------------------------
def statement_lines(sheets: DataFrame) -> DataFrame:
    """Label and value cells of statement sheets in file order, file by file (statement_id: files in path order, from 0)."""
    of = sheets.select("file").distinct().withColumn(
        "statement_id", (F.row_number().over(Window.orderBy("file")) - 1).cast("int"))  # one row per sheet
    lines = sheets.join(of, "file").select(
        "statement_id", F.col("row").cast("int").alias("line_no"), "label", F.col("value").try_cast(MONEY_SUM).alias("value"))
    return lines.where(F.trim("label") != "")


@dataclass(frozen=True)
class Inputs:
    """What a catalogue holds: all extracts (``normalize.TAGGED_COLUMNS``) and the sheets (None: absent)."""

    extracts: DataFrame | None = None
    books: DataFrame | None = None
    statements: DataFrame | None = None
    vendors: DataFrame | None = None


def load_sheets(spark: SparkSession, e: Entry) -> Loaded:
    """Reads, counts and stores the sheets of one entry in one job."""
    try:
        seen = Observation()
        read = R.read_sheets(spark, e.path, SHEETS[e.kind]).observe(seen, F.count(F.lit(1)).alias("read"))
        data = FS.stage_table(spark, read, f"sheets-{e.kind}")
        n = seen.get["read"]
    except (PySparkException, Py4JJavaError) as err:
        if (why := unreadable(err)) is None:
            raise
        return Loaded(e, why[0], reason=why[1])
    return Loaded(e, "loaded", data, n, 0, n) if n else Loaded(e, "empty")


def load_inputs(spark: SparkSession, entries: list[Entry]) -> tuple[Inputs, DataFrame]:
    """(inputs of the present entries, report of every entry).

    Each entry is stored by one job.  An entry of statements may be a folder of
    any number of sheets: statements are numbered by entry, then file.
    """
    found = load(spark, entries)
    here = found.present()

    def sheets(kind: str) -> list[DataFrame]:
        return [found.entries[i].data for i in here if found.entries[i].entry.kind == kind]

    def union(parts: list[DataFrame]) -> DataFrame | None:
        return N.union_extracts(parts) if parts else None

    books = union([x.drop("file", "row").withColumn("entity", F.lit(i)) for i, x in enumerate(sheets("books"))])
    order = [x.withColumn("file", F.concat(F.lpad(F.lit(str(i)), 9, "0"), F.lit("|"), "file")) for i, x in enumerate(sheets("statement"))]
    statements = union(order)
    vendors = union([x.drop("file", "row") for x in sheets("vendors")])
    return Inputs(found.tagged(), books, None if statements is None else statement_lines(statements), vendors), found.report()
