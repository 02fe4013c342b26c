"""Volume KPIs, insights and alerts: A9, A10, A19-A22, A25, A28-A31, W1-W2, F10.

Global windows (MoM, Q1 lag) run on monthly/yearly aggregates (tens of rows),
never on the ledger; the per-source variants partition by ``source``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import Params
from .books import chosen, combine_rows
from .ledger import in_range_col, month_window, sources_dim, user_range
from .revenue import monthly_sales


def kpi_volume(cube_f: DataFrame, failures: DataFrame, p: Params) -> DataFrame:
    """Successful count, failed count, failure rate %, average sale."""
    a = cube_f.agg(
        F.coalesce(F.sum("n_nonrefund"), F.lit(0)).cast("long").alias("total_txn"),
        F.coalesce(F.sum(F.when(F.col("source") == p.failure_gateway, F.col("n"))), F.lit(0)).cast("long").alias("gw_rev_n"),
        F.sum("gross").alias("sale_sum"),
        F.coalesce(F.sum("n_sale"), F.lit(0)).cast("long").alias("sale_n"),
    )
    b = month_window(failures.where(F.col("month").isNotNull()), p).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("failed_txn")
    )
    c = combine_rows(a, b)
    tot = F.col("failed_txn") + F.col("gw_rev_n")
    return c.select(
        "total_txn",
        "failed_txn",
        F.when(tot > 0, X.pct(F.col("failed_txn"), tot)).otherwise(F.lit(0.0)).alias("failure_rate"),
        F.when(F.col("sale_n") > 0, X.dbl("sale_sum") / F.col("sale_n")).alias("avg_value"),
    )


def failures_window(failures: DataFrame, p: Params) -> DataFrame:
    """Failures by month and status in the window; empty unless the gateway is selected."""
    f = month_window(failures.where(F.col("month").isNotNull()), p)
    return f.where(F.lit(p.failure_gateway in p.sources)).orderBy("month", "status")


def refund_rates(spark: SparkSession, led: DataFrame, p: Params) -> DataFrame:
    """A28 + J3: refund rate per known gateway (zero when absent), with its grade.

    Base rows: date range, selected sources, USD/blank currency, not conversion —
    no status and no impact filter on refunds (as the dashboard does).
    """
    base = led.where(
        user_range(led, p) & F.col("source").isin(*p.sources) & X.currency_ok() & X.not_conversion()
    )
    agg = base.groupBy("source").agg(
        F.sum(F.when(X.is_sale() & X.successful(), F.col("amount"))).alias("rev"),
        F.sum(F.when(X.is_refund(), F.abs("amount"))).alias("refunds"),
    )
    z = F.lit(0).cast("decimal(18,2)")
    j = sources_dim(spark, p.gateways).join(F.broadcast(agg), "source", "left")
    rev, ref = F.coalesce("rev", z), F.coalesce("refunds", z)
    rate = F.when(rev > 0, X.pct(ref, rev)).otherwise(F.lit(0.0))
    return j.select(
        "source", X.dbl(rev).alias("rev"), X.dbl(ref).alias("refunds"), rate.alias("rate")
    ).withColumn(
        "grade",
        F.when(F.col("rate") > 8, F.lit("danger")).when(F.col("rate") > 5, F.lit("warning")).otherwise(F.lit("ok")),
    ).orderBy(F.desc("rate"), "source")


def refund_rate_chart(rates: DataFrame) -> DataFrame:
    """A28, chart form: gateways with revenue, highest rate first."""
    return rates.where(F.col("rev") > 0).orderBy(F.desc("rate"), "source")


def yoy_monthly(cube: DataFrame, p: Params) -> DataFrame:
    """Sale revenue by calendar month for two years side by side, and the change %.

    The user's range and sources, or everything when they hold nothing: both
    from one aggregate of the cube.
    """
    inside = in_range_col("date", p) & F.col("source").isin(*p.sources)
    sale = F.col("n_sale") > 0
    years = {"prev": p.yoy_prev_year, "cur": p.yoy_year}
    sums = [F.sum(F.when(sale & cond & (F.col("yr") == y), F.col("gross"))).alias(f"{name}_{which}")
            for name, y in years.items() for which, cond in (("in", inside), ("all", F.lit(True)))]
    both = cube.groupBy(F.month("date").alias("month_num")).agg(
        F.count(F.when(inside, 1)).alias("n"), F.count(F.when(inside & sale, 1)).alias("n_in"),
        F.count(F.when(sale, 1)).alias("n_all"), *sums)
    pick = lambda a, b: chosen(F.col(a), F.col("n"), F.col(b))
    base = both.select("month_num", pick("n_in", "n_all").alias("n"), pick("prev_in", "prev_all").alias("prev"),
                       pick("cur_in", "cur_all").alias("cur")).where("n > 0")
    prev, cur = F.col("prev"), F.col("cur")
    return base.select(
        "month_num",
        X.dbl(prev).alias("revenue_prev"),
        X.dbl(cur).alias("revenue_cur"),
        F.when(prev > 0, X.pct(cur - prev, prev)).alias("yoy_pct"),
    ).orderBy("month_num")


def q1_yoy(cube: DataFrame) -> DataFrame:
    """A10: first-quarter sale revenue per year and its change against the year before."""
    q1 = cube.where((F.col("n_sale") > 0) & (F.month("date") <= 3)).groupBy("yr").agg(F.sum("gross").alias("q1"))
    prev = F.lag("q1", 1).over(Window.orderBy("yr"))
    prev_year = F.lag("yr", 1).over(Window.orderBy("yr"))
    return q1.select(
        F.col("yr").alias("year"),
        X.dbl("q1").alias("q1_revenue"),
        F.when(prev_year == F.col("yr") - 1, X.dbl(prev)).alias("prev_q1_revenue"),
        F.when((prev_year == F.col("yr") - 1) & (prev > 0), X.pct(F.col("q1") - prev, prev)).alias("q1_yoy_pct"),
    )


def mom_change(cube_f: DataFrame, by_source: bool = False) -> DataFrame:
    """W1 + W2: month-over-month % against the previous *row*; first row dropped."""
    keys = ("source",) if by_source else ()
    m = monthly_sales(cube_f, *keys)
    w = Window.partitionBy(*keys).orderBy("month")
    frame = w.rowsBetween(-2, 0)
    prev = F.lag("revenue", 1).over(w)
    roll = F.when(F.count("revenue").over(frame) == 3, X.dbl(F.sum("revenue").over(frame)) / 3.0)
    out = m.select(
        *keys, "month",
        X.dbl("revenue").alias("revenue"),
        X.dbl(prev).alias("prev_revenue"),
        X.pct(F.col("revenue") - prev, prev).alias("mom_pct"),
        roll.alias("roll3"),
    )
    return out.where(F.col("mom_pct").isNotNull())


def rolling3(cube_f: DataFrame) -> DataFrame:
    """Trailing three-month mean of sale revenue, null until three rows exist."""
    m = monthly_sales(cube_f)
    frame = Window.orderBy("month").rowsBetween(-2, 0)
    return m.select(
        "month",
        X.dbl("revenue").alias("revenue"),
        F.when(F.count("revenue").over(frame) == 3, X.dbl(F.sum("revenue").over(frame)) / 3.0).alias("roll3"),
    )


def gateway_growth(cube_f: DataFrame, p: Params) -> DataFrame:
    """One gateway's sale revenue and count by month."""
    return (
        monthly_sales(cube_f.where(F.col("source") == p.growth_gateway))
        .select("month", X.dbl("revenue").alias("revenue"), "n")
        .orderBy("month")
    )


def large_refunds(led: DataFrame, p: Params) -> DataFrame:
    """F10 + P9: refunds with |amount| >= threshold in currency, any status; in range/sources."""
    thr = F.lit(p.large_refund_threshold).cast("decimal(18,2)")
    r = led.where(
        X.is_refund() & (F.abs("amount") >= thr) & X.currency_ok()
        & user_range(led, p) & F.col("source").isin(*p.sources)
    )
    return r.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "source",
        F.abs("amount").alias("amount"),
        F.col("customer_name").alias("customer"),
        "status",
        "description",
    ).orderBy(F.desc("amount"), "date", "source")


def kpi_alerts(pl_f: DataFrame, cogs_f: DataFrame, metrics_one: DataFrame, rates: DataFrame,
               q1: DataFrame, p: Params) -> DataFrame:
    """A29 + A30 (+ A10): net income, COGS % of revenue, alert gateway's refund rate, Q1 YoY."""
    a = pl_f.agg(
        F.count(F.lit(1)).alias("n_months"),
        F.sum("gross_revenue").alias("rev_sum"),
        F.sum("net_income").alias("net_sum"),
    )
    b = cogs_f.agg(F.count(F.lit(1)).alias("n_cogs"), F.abs(F.sum("amount")).alias("cogs_sum"))
    m = metrics_one.select(
        F.col("gross_revenue").alias("st_rev"), F.col("cogs").alias("st_cogs"), F.col("net_income").alias("st_net")
    )
    r = rates.where(F.col("source") == p.alert_gateway).select(F.col("rate").alias("alert_refund_rate"))
    q = q1.where(F.col("year") == p.yoy_year).select(F.col("q1_yoy_pct"))
    c = combine_rows(a, b, m, r, q)
    has_m, has_c = F.col("n_months") > 0, F.col("n_cogs") > 0
    gross = F.when(has_m, F.coalesce("rev_sum", F.lit(0))).otherwise(F.col("st_rev"))
    cogs_amt = F.when(has_c, F.col("cogs_sum")).otherwise(F.abs("st_cogs"))
    return c.select(
        X.dbl(F.when(has_m, F.coalesce("net_sum", F.lit(0))).otherwise(F.col("st_net"))).alias("net_income"),
        F.when(gross > 0, X.pct(cogs_amt, gross)).alias("cogs_pct"),
        F.coalesce("alert_refund_rate", F.lit(0.0)).alias("alert_refund_rate"),
        F.col("q1_yoy_pct"),
    )
