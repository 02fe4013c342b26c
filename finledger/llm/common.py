"""Shared helpers: table access and staged tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a scratch folder only on a local master."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    d = tempfile.mkdtemp(prefix="finledger-llm-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


#: settings while a table is staged: shuffle files go when the write ends, Python gets rows in small batches
STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


#: for workers whose cost is in the distinct words of a batch: more rows, bounded by their bytes
LARGE_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(12 * MB)}


def staged(spark: SparkSession, df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to a new Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows re-reads the table after a lost executor, so
    the shuffle files of the write are not needed any more and go at its end.
    """
    path = f"{shared_dir(spark).rstrip('/')}/finledger-llm/{name}-{uuid.uuid4().hex}"
    settings = STAGING | (settings or {})
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table of the shared folder (when no result still reads them)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/finledger-llm")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def smallest_hashes(df: DataFrame, keys: list[str], wanted: int, of: int) -> DataFrame:
    """The ``wanted`` rows with the smallest hash of ``keys`` among ``of`` rows.

    A share a little above ``wanted / of`` is filtered out first, so that only
    about as many rows as wanted reach the task that sorts them, at every size.
    """
    hashed = F.xxhash64(*keys)
    share = min(1.0, (wanted + 6 * wanted**0.5 + 50) / max(1, of))
    if share < 1:
        df = df.where(hashed < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return df.orderBy(hashed, *keys).limit(wanted)


_WORKER: dict = {}


def kept(key, make: Callable):
    """A worker process's cache, across its tasks; the cache of whatever ran there before goes."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def forget() -> None:
    """Let this worker process's cache go, whatever it belongs to."""
    _WORKER.clear()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, installed there or not."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="finledger-ship-")) / "finledger_llm.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def in_parts(batches: Iterator, rows: int = 500) -> Iterator:
    """Batches cut into parts of a few rows, so that Python objects of only few texts at a time fill the worker."""
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def map_batches(df: DataFrame, run: Callable, schema, caches: bool = False) -> DataFrame:
    """``mapInArrow`` with the package's own modules at hand on every executor.

    Workers live on after a task; what an earlier operator left in one's cache goes
    first, unless ``run`` looks after the cache itself (``caches``, by ``kept``).
    """
    ship(df.sparkSession)

    def fresh(batches):
        forget()
        return run(batches)

    return df.mapInArrow(run if caches else fresh, schema)
