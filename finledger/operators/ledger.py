"""Ledger stage: U1 union, F1 fiscal window, P5 calendar columns, F2/F3 filters, U2, A32, J4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import GATEWAYS, SUCCESSFUL_STATUSES, Params
from .normalize import union_extracts


def with_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """P5: month start, ``YYYY-MM`` and year."""
    return df.select(
        "*",
        X.month_floor(date_col).alias("month"),
        X.yearmon(date_col).alias("yearmon"),
        F.year(date_col).alias("yr"),
    )


def ledger(parts: list[DataFrame], p: Params) -> DataFrame:
    """U1 + F1 + P5: unified ledger of the fiscal window; null dates dropped."""
    u = union_extracts(parts)
    return with_calendar(u.where(X.in_range("date", p.fiscal_from, p.fiscal_to)))


def revenue(led: DataFrame, refunds_from: str = "revenue") -> DataFrame:
    """revenue subset V.

    By default a refund whose balance impact is ``debit`` (every card refund)
    is outside V, as in the dashboard; ``refunds_from="ledger"`` keeps refunds
    regardless of their impact so that they reach the refund figures.
    """
    if refunds_from == "ledger":
        cond = (
            X.currency_ok() & F.col("status").isin(*SUCCESSFUL_STATUSES) & X.not_conversion()
            & (X.credit_or_null() | X.is_refund())
        )
        return led.where(cond)
    return led.where(X.revenue_predicate())


def by_range_and_sources(df: DataFrame, p: Params, date_col: str = "date") -> DataFrame:
    """user date range and source set."""
    return df.where(user_range(df, p, date_col) & F.col("source").isin(*p.sources))


def month_window(df: DataFrame, p: Params, month_col: str = "month") -> DataFrame:
    """month-grain window; compares the month *start* with the range."""
    return df.where(X.in_range(month_col, p.date_from, p.date_to))


def sources_dim(spark: SparkSession, names=GATEWAYS) -> DataFrame:
    """The fixed gateway dimension (a handful of rows: safe to broadcast)."""
    return spark.createDataFrame([(s,) for s in names], "source string")


def sources_available(spark: SparkSession, led: DataFrame, names=GATEWAYS) -> DataFrame:
    """Known gateways that are present in the ledger (set intersection).

    The ledger side is reduced to its distinct sources first (a partial
    aggregate per task, so only a few rows are shuffled), then matched against
    the fixed gateway dimension (broadcast, a handful of rows).
    """
    present = led.select("source").distinct()
    return present.join(F.broadcast(sources_dim(spark, names)), "source", "inner")


def distinct_status(led: DataFrame) -> DataFrame:
    """Sorted distinct non-null statuses (filter choices)."""
    return led.where(F.col("status").isNotNull()).select("status").distinct().orderBy("status")


def source_semi(spark: SparkSession, led: DataFrame, names) -> DataFrame:
    """Rows whose source is in a (tiny, fixed-size) set given as a table."""
    sel = sources_dim(spark, names)
    return led.join(F.broadcast(sel), "source", "left_semi")


def in_range_col(c: str, p: Params):
    """The user's date range as a predicate on column ``c``."""
    return X.in_range(c, p.date_from, p.date_to)


def user_range(df: DataFrame, p: Params, date_col: str = "date"):
    """The user's date range on ``df``; when ``df`` carries a ``month`` column the
    implied month range is added — it changes no result, but prunes the month
    partitions of a staged table (``PartitionFilters``)."""
    cond = in_range_col(date_col, p)
    if "month" in df.columns:
        cond = cond & F.col("month").between(F.trunc(F.lit(p.date_from), "month"), F.lit(p.date_to))
    return cond
