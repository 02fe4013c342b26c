"""Revenue aggregates over V: A2-A4, A11, A13-A18, A23, A24.

V is reduced once to a **daily cube**: one row per (date, source) holding the
sums and counts every revenue output needs.  Its size is bounded by days ×
gateways whatever the number of transactions, so the two dozen outputs of a
dashboard refresh cost one pass over V (a partial aggregate per task, one small
shuffle) and then only re-aggregate the cube.  Day grain keeps the user's
day-level date range exact; money sums are decimals, so re-aggregation is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import MONEY_SUM


def _zero() -> Column:
    return F.lit(0).cast("decimal(18,2)")


def _s(c: Column) -> Column:
    """Sum of a decimal over rows, 0 over none (kept in decimal(38,2))."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY_SUM)


def daily_cube(v: DataFrame) -> DataFrame:
    """V -> (date, month, yr, source) with gross, refunds, net, fees and counts."""
    sale, ref = X.is_sale(), X.is_refund()
    net_row = F.when(ref, -F.abs("amount")).otherwise(F.greatest(F.col("amount"), _zero()))
    return v.groupBy("date", "month", "yr", "source").agg(
        _s(F.when(sale, F.col("amount"))).alias("gross"),
        _s(F.when(ref, F.abs("amount"))).alias("refunds"),
        _s(net_row).alias("net"),
        _s(F.coalesce("fee", _zero())).alias("fees"),
        _s(F.when(sale, F.coalesce("fee", _zero()))).alias("sale_fees"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(sale, 1)).alias("n_sale"),
        F.count(F.when(ref, 1)).alias("n_refund"),
        F.count(F.when(~ref, 1)).alias("n_nonrefund"),
    )


def _sum(c: str) -> Column:
    return _s(F.col(c))


def _cnt(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def monthly_revenue(cube: DataFrame) -> DataFrame:
    """A2: by (month, source): gross, refunds, net = Σ(refund ? -|a| : max(a,0)), tx_count."""
    return cube.groupBy("month", "source").agg(
        X.dbl(_sum("gross")).alias("gross"),
        X.dbl(_sum("refunds")).alias("refunds"),
        X.dbl(_sum("net")).alias("net"),
        _cnt("n").alias("tx_count"),
    )


def monthly_sales_fees(cube: DataFrame) -> DataFrame:
    """A3: months with a sale: gross and fees of the sale rows."""
    return (
        cube.groupBy("month")
        .agg(_sum("gross").alias("pp_gross"), _sum("sale_fees").alias("pp_fees"), _cnt("n_sale").alias("n_sale"))
        .where(F.col("n_sale") > 0)
        .drop("n_sale")
    )


def monthly_refunds(cube: DataFrame) -> DataFrame:
    """A4: months with a refund: refunds."""
    return (
        cube.groupBy("month")
        .agg(_sum("refunds").alias("pp_refunds"), _cnt("n_refund").alias("n_refund"))
        .where(F.col("n_refund") > 0)
        .drop("n_refund")
    )


def kpi_overview(cube: DataFrame) -> DataFrame:
    """One row: gross, refunds, net = gross - refunds."""
    g, r = _sum("gross"), _sum("refunds")
    return cube.agg(X.dbl(g).alias("gross"), X.dbl(r).alias("refunds"), X.dbl(g - r).alias("net"))


def monthly_trend(cube: DataFrame) -> DataFrame:
    """By month: gross, refunds, net."""
    g, r = _sum("gross"), _sum("refunds")
    return cube.groupBy("month").agg(X.dbl(g).alias("gross"), X.dbl(r).alias("refunds"), X.dbl(g - r).alias("net"))


def source_share(cube: DataFrame) -> DataFrame:
    """A14 + W3: sale total by source and its share of all sources.

    The share window has no partition key but runs on the per-source aggregate
    (one row per gateway), never on the ledger.
    """
    by_src = (
        cube.groupBy("source")
        .agg(_sum("gross").alias("t"), _cnt("n_sale").alias("n_sale"))
        .where(F.col("n_sale") > 0)
    )
    total = X.dbl(F.sum("t").over(Window.partitionBy()))
    return by_src.select("source", X.dbl("t").alias("total"), (X.dbl("t") / total).alias("share"))


def net_month_source(cube: DataFrame) -> DataFrame:
    """Net by (month, source)."""
    return cube.groupBy("month", "source").agg(X.dbl(_sum("gross") - _sum("refunds")).alias("net"))


def refunds_month_source(cube: DataFrame) -> DataFrame:
    """Refunds by (month, source), where there are refunds."""
    return (
        cube.groupBy("month", "source")
        .agg(X.dbl(_sum("refunds")).alias("total"), _cnt("n_refund").alias("n_refund"))
        .where(F.col("n_refund") > 0)
        .drop("n_refund")
    )


def refunds_by_source(cube: DataFrame) -> DataFrame:
    """A17 + X10: refund total, count and label by source, descending."""
    return (
        cube.groupBy("source")
        .agg(X.dbl(_sum("refunds")).alias("total"), _cnt("n_refund").alias("n"))
        .where(F.col("n") > 0)
        .withColumn("label", X.count_label("n", "refund"))
        .orderBy(F.desc("total"), "source")
    )


def net_reconciliation(cube: DataFrame) -> DataFrame:
    """Per source Sales, Refunds, Fees (all rows), Net = S - R - F."""
    s, r, f = _sum("gross"), _sum("refunds"), _sum("fees")
    return (
        cube.groupBy("source")
        .agg(X.dbl(s).alias("sales"), X.dbl(r).alias("refunds"), X.dbl(f).alias("fees"), X.dbl(s - r - f).alias("net"))
        .orderBy(F.desc("sales"), "source")
    )


def count_month_source(cube: DataFrame) -> DataFrame:
    """Count of non-refund rows by (month, source)."""
    return cube.groupBy("month", "source").agg(_cnt("n_nonrefund").alias("n")).where(F.col("n") > 0)


def avg_by_source(cube: DataFrame) -> DataFrame:
    """Average and count of sales by source, ascending by average."""
    return (
        cube.groupBy("source")
        .agg(_sum("gross").alias("g"), _cnt("n_sale").alias("n"))
        .where(F.col("n") > 0)
        .select("source", (X.dbl("g") / F.col("n")).alias("avg_value"), "n")
        .orderBy("avg_value", "source")
    )


def pp_monthly(cube: DataFrame) -> DataFrame:
    """A3 + A4 together, for the monthly P&L: sale gross/fees and refunds by month.

    ``n_sale``/``n_refund`` keep the reference's row sets: a month is in the sale
    table only if it has a sale, in the refund table only if it has a refund.
    """
    return cube.groupBy("month").agg(
        _sum("gross").alias("pp_gross"),
        _sum("sale_fees").alias("pp_fees"),
        _sum("refunds").alias("pp_refunds"),
        _cnt("n_sale").alias("n_sale"),
        _cnt("n_refund").alias("n_refund"),
    ).where((F.col("n_sale") > 0) | (F.col("n_refund") > 0))


def monthly_sales(cube: DataFrame, *keys: str) -> DataFrame:
    """Sale revenue by (keys, month) for months with a sale (MoM, rolling mean, growth)."""
    return (
        cube.groupBy(*keys, "month")
        .agg(_sum("gross").alias("revenue"), _cnt("n_sale").alias("n"))
        .where(F.col("n") > 0)
    )
