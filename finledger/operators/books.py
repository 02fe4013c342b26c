"""Book entries and vendor sheet: F6, F7, F7b, F9, P8, A5-A8, J1, J2, A26, A27, T1, T2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import Params
from ..schema import MONEY_SUM
from .ledger import in_range_col, user_range
from .revenue import pp_monthly

# Transaction types counted as revenue / expense in the monthly books.
REVENUE_TYPES = ("Sales Receipt", "Invoice", "Payment", "Deposit")
EXPENSE_TYPES = (
    "Expense", "Bill", "Bill Payment", "Bill Payment (Check)", "Check",
    "Credit Card Charge", "Transfer",
)
# Words that mark a logistics vendor.
LOGISTICS_PATTERN = "(?i)ship|freight|ups|usps|fedex|dhl|auctane|dimerco|express|postal|carrier"

def _zero():
    return F.lit(0).cast("decimal(18,2)")


def books_typed(sheet: DataFrame) -> DataFrame:
    """Sheet text -> typed entries (date ``%m/%d/%Y``, decimal amount)."""
    return sheet.select(
        X.parse_us_date("date").alias("date"),
        F.col("trans_type").cast("string").alias("trans_type"),
        "num", "posting", "name", "memo", "account", "split",
        X.to_money("amount").alias("amount"),
        F.col("entity").cast("int").alias("entity"),
    )


def books_window(typed: DataFrame, p: Params) -> DataFrame:
    """entries with a date and an amount, inside the fiscal window; plus month."""
    return typed.where(
        F.col("amount").isNotNull() & X.in_range("date", p.fiscal_from, p.fiscal_to)
    ).withColumn("month", X.month_floor("date"))


def cogs_entries(books: DataFrame) -> DataFrame:
    """entries whose counter-account starts with ``50``, with the cleaned account."""
    return books.where(F.col("split").startswith("50")).withColumn(
        "account_clean", X.strip_account_code("split")
    )


def in_user_range(df: DataFrame, p: Params) -> DataFrame:
    """By the user's date range.  The implied month range is added too: it
    changes no result but prunes the month partitions of a staged books table."""
    return df.where(user_range(df, p))


def books_monthly(books: DataFrame) -> DataFrame:
    """A5: revenue = Σ positive revenue-type amounts; expenses = |Σ negative expense-type|."""
    rev = X.sum0(F.when(F.col("trans_type").isin(*REVENUE_TYPES) & (F.col("amount") > 0), F.col("amount")))
    exp = F.abs(X.sum0(F.when(F.col("trans_type").isin(*EXPENSE_TYPES) & (F.col("amount") < 0), F.col("amount"))))
    return books.groupBy("month").agg(
        rev.alias("qb_revenue"), exp.alias("qb_expenses"), (rev - exp).alias("qb_net")
    )


def monthly_pl(cube: DataFrame, books_m: DataFrame) -> DataFrame:
    """J1 + A6: processors ⟗ books by month, null -> 0; net income ignores fees.

    Both sides are monthly aggregates (tens of rows), the processor side
    re-aggregated from the daily revenue cube.
    """
    pp = pp_monthly(cube)
    j = pp.join(books_m, "month", "full_outer")
    z = lambda c: F.coalesce(F.col(c), _zero())
    gross_rev = z("pp_gross") - z("pp_refunds")
    return j.select(
        "month",
        gross_rev.alias("gross_revenue"),
        z("pp_refunds").alias("pp_refunds"),
        (gross_rev - z("pp_fees")).alias("net_revenue"),
        z("qb_expenses").alias("total_expenses"),
        (gross_rev - z("qb_expenses")).alias("net_income"),
    )


def monthly_pl_no_books(cube: DataFrame) -> DataFrame:
    """Left join of sale months to refund months when no books exist."""
    pp = pp_monthly(cube)
    sales = pp.where(F.col("n_sale") > 0).select("month", "pp_gross", "pp_fees")
    refunds = pp.where(F.col("n_refund") > 0).select("month", "pp_refunds")
    j = sales.join(refunds, "month", "left")
    gross_rev = F.col("pp_gross") - F.coalesce("pp_refunds", _zero())
    return j.select(
        "month",
        gross_rev.alias("gross_revenue"),
        F.coalesce("pp_refunds", _zero()).alias("pp_refunds"),
        (gross_rev - F.col("pp_fees")).alias("net_revenue"),
        F.lit(None).cast("double").alias("total_expenses"),
        F.lit(None).cast("double").alias("net_income"),
    )


def unless_empty(df: DataFrame, p: Params) -> DataFrame:
    """The rows in the user's range, or all rows when there are none (the dashboard's fallback).

    An uncorrelated scalar subquery, a look for one row in the range, is known
    before the rows are scanned; it also sets the ends of the months, so that a
    staged table still reads only those it needs.  Spark runs it once.
    """
    some = in_user_range(df, p).limit(1).agg(F.count(F.lit(1)).alias("n"))
    none = some.scalar() == 0
    end = lambda inside, open_: F.when(none, F.lit(open_).cast("date")).otherwise(inside)
    months = F.col("month").between(end(F.trunc(F.lit(p.date_from), "month"), "0001-01-01"), end(F.lit(p.date_to), "9999-12-31"))
    return df.where(months & (none | in_range_col("date", p)))


def chosen(inside, n_inside, everything):
    """Of aggregated rows with both figures: the inside ones if any row of the table has one, else those of all rows.

    The window runs over a table of months (times accounts), never over entries.
    """
    return F.when(F.sum(n_inside).over(Window.partitionBy()) > 0, inside).otherwise(everything)


def books_monthly_window(months: DataFrame, p: Params) -> DataFrame:
    """A5 + F15: monthly books in the month-grain window, all months if none fall in it."""
    inside = X.in_range("month", p.date_from, p.date_to)
    keep = chosen(inside, F.when(inside, 1).otherwise(0), F.lit(True))
    return months.withColumn("keep", keep).where("keep").drop("keep")


def cogs_by_supplier_account(cogs: DataFrame) -> DataFrame:
    """By (supplier, account): total and count; blank names dropped; by |total| desc."""
    return (
        cogs.groupBy("name", "split")
        .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n_orders"))
        .where(F.col("name").isNotNull() & (F.col("name") != ""))
        .orderBy(F.abs("total").desc(), "name", "split")
    )


def cogs_by_supplier(cogs_f: DataFrame) -> DataFrame:
    """By supplier within the user's range, ascending."""
    return (
        cogs_f.groupBy("name")
        .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n_orders"))
        .where(F.col("name").isNotNull() & (F.col("name") != ""))
        .orderBy("total", "name")
    )


def cogs_monthly(cogs: DataFrame, p: Params) -> DataFrame:
    """By (month, cleaned account), in the user's range or, when that holds nothing, over all entries.

    Both sums come from one aggregate over one read of the entries.
    """
    inside = in_range_col("date", p)
    both = cogs.groupBy("month", "account_clean").agg(
        F.sum(F.when(inside, F.col("amount"))).alias("some"), F.count(F.when(inside, 1)).alias("n"),
        F.sum("amount").alias("every"))
    found = both.select("month", "account_clean", chosen(F.col("some"), F.col("n"), F.col("every")).alias("total"),
                        chosen(F.col("n") > 0, F.col("n"), F.lit(True)).alias("keep"))
    return found.where("keep").drop("keep").orderBy("month", "account_clean")


def cogs_detail(cogs_f: DataFrame) -> DataFrame:
    """Display projection of COGS entries."""
    return cogs_f.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("trans_type").alias("type"),
        F.col("num").alias("po_num"),
        F.col("name").alias("vendor"),
        "memo",
        F.col("account_clean").alias("account"),
        "amount",
    )


# --- vendor sheet (positional, 10 columns) ----------------------------------
SHEET_COLS = [f"_c{i}" for i in range(10)]


def vendor_sheet(books: DataFrame) -> DataFrame:
    """Purchases-by-vendor sheet: a title row and a ``Total for`` row per vendor.

    One aggregate by vendor (partial per task), then each vendor row is turned
    into its two sheet rows with ``inline`` — no join, no driver work.
    """
    agg = books.groupBy("name").agg(
        X.sum0(F.when(F.col("amount") < 0, -F.col("amount"))).alias("spent")
    )
    rows = F.array(
        F.struct(F.col("name").alias("a"), F.lit(None).cast("string").alias("b")),
        F.struct(F.concat(F.lit("Total for "), F.col("name")).alias("a"), F.col("spent").cast("string").alias("b")),
    )
    out = agg.select(F.inline(rows))
    return out.select(
        F.col("a").alias("_c0"), *[F.lit(None).cast("string").alias(c) for c in SHEET_COLS[1:9]], F.col("b").alias("_c9")
    )


def vendor_totals(sheet: DataFrame) -> DataFrame:
    """Keep ``Total for`` rows, strip the prefix, column 10 as amount, amount > 0."""
    amt = F.col("_c9").try_cast(MONEY_SUM)
    return (
        sheet.where(F.coalesce(F.col("_c0").rlike("^Total for "), F.lit(False)))
        .select(F.regexp_replace("_c0", "^Total for ", "").alias("vendor"), amt.alias("amount"))
        .where(F.col("amount") > 0)
    )


def logistics_vendors(vendors: DataFrame) -> DataFrame:
    """carrier vendors by regex, amount > 0, descending."""
    return vendors.where(X.rlike_or_false("vendor", LOGISTICS_PATTERN) & (F.col("amount") > 0)).orderBy(
        F.desc("amount"), "vendor"
    )


def logistics_table(vendors: DataFrame) -> DataFrame:
    """F9, table form: carrier vendors with money text, highest amount first."""
    found = logistics_vendors(vendors)
    return found.select("vendor", F.concat(F.lit("$"), F.format_number("amount", 2)).alias("total_spent"))


def top_vendors(vendors: DataFrame, k: int) -> DataFrame:
    """Top-k by amount (TakeOrderedAndProject), re-shown ascending."""
    return vendors.orderBy(F.desc("amount"), "vendor").limit(k).orderBy("amount", F.desc("vendor"))


def top_vendors_table(vendors: DataFrame, k: int) -> DataFrame:
    """Top-k with money text."""
    top = vendors.orderBy(F.desc("amount"), "vendor").limit(k)
    return top.select("vendor", F.concat(F.lit("$"), F.format_number("amount", 2)).alias("total_spent"))


# --- KPI rows without a cross join ------------------------------------------
def combine_rows(*rows: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side: union them by name, then one tiny
    global aggregate takes each column from the row that has it."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    cols = []
    for r in rows:
        cols += [c for c in r.columns if c not in cols]
    return u.agg(*[F.max(c).alias(c) for c in cols])


def kpi_pl(pl_f: DataFrame, cogs_f: DataFrame, metrics_one: DataFrame) -> DataFrame:
    """Revenue, COGS, profit, net income over the window; statement fallback."""
    a = pl_f.agg(
        F.count(F.lit(1)).alias("n_months"),
        X.sum0(F.col("gross_revenue")).alias("rev_sum"),
        X.sum0(F.col("net_income")).alias("net_sum"),
    )
    b = cogs_f.agg(F.count(F.lit(1)).alias("n_cogs"), F.abs(X.sum0(F.col("amount"))).alias("cogs_sum"))
    m = metrics_one.select(
        F.col("gross_revenue").alias("st_rev"), F.col("cogs").alias("st_cogs"), F.col("net_income").alias("st_net")
    )
    c = combine_rows(a, b, m)
    return c.select(
        F.when(F.col("n_months") > 0, F.col("rev_sum")).otherwise(F.col("st_rev")).alias("revenue"),
        F.when(F.col("n_cogs") > 0, F.col("cogs_sum"))
        .otherwise(F.abs(F.coalesce("st_cogs", F.lit(0)))).alias("cogs"),
        (F.col("rev_sum") - F.col("cogs_sum")).alias("profit"),
        F.when(F.col("n_months") > 0, F.col("net_sum")).otherwise(F.col("st_net")).alias("net_income"),
    )


def kpi_cogs(cogs_f: DataFrame, cost_one: DataFrame) -> DataFrame:
    """Product (50000), shipping (50700/50701), total COGS; statement fallback; fees."""
    a = cogs_f.agg(
        F.count(F.lit(1)).alias("n_cogs"),
        F.abs(X.sum0(F.when(F.col("split").rlike("^50000"), F.col("amount")))).alias("prod"),
        F.abs(X.sum0(F.when(F.col("split").rlike("^5070[01]"), F.col("amount")))).alias("ship"),
        F.abs(X.sum0(F.col("amount"))).alias("tot"),
    )
    m = cost_one.select(
        F.col("product_cogs").alias("st_prod"),
        F.col("shipping_cost").alias("st_ship"),
        F.col("processing_fees_total").alias("st_fees"),
        F.col("total_cogs").alias("st_tot"),
    )
    c = combine_rows(a, m)
    has = F.col("n_cogs") > 0
    return c.select(
        F.when(has, F.col("prod")).otherwise(F.col("st_prod")).alias("product_cogs"),
        F.when(has, F.col("ship")).otherwise(F.col("st_ship")).alias("shipping_cost"),
        F.col("st_fees").alias("processing_fees"),
        F.when(has, F.col("tot")).otherwise(F.col("st_tot")).alias("total_cogs"),
    )
