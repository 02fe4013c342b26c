"""Column factories: scalar functions and predicates, all JVM-side built-ins (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SUCCESSFUL_STATUSES
from ..schema import MONEY


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- X1 -------------------------------------------------------------------
def clean_amount(c: str | Column) -> Column:
    """Money text such as ``$1,234.50`` or `` -12.00 `` to decimal; null if unparsable."""
    return F.regexp_replace(col(c).cast("string"), r"[,$\s]", "").try_cast(MONEY)


def to_money(c: str | Column) -> Column:
    """Plain numeric text to decimal(18,2), null if unparsable (R ``as.numeric``)."""
    return col(c).try_cast(MONEY)


# --- X6 -------------------------------------------------------------------
def parse_us_date(c: str | Column) -> Column:
    """Leading ``%m/%d/%Y`` date (``1/5/2026`` or ``01/05/2026``); what follows, such as a time, is ignored; null if bad."""
    return F.try_to_date(F.regexp_extract(col(c), r"^\s*(\d{1,2}/\d{1,2}/\d{4})", 1), "M/d/yyyy")


def parse_us_date_prefix(c: str | Column) -> Column:
    """The date at the start of a US date and time."""
    return parse_us_date(c)


def parse_iso_date_prefix(c: str | Column) -> Column:
    """Leading ISO date, padded or not, with ``-`` or ``/``; what follows is ignored; null if bad."""
    found = F.regexp_extract(col(c), r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1)
    return F.try_to_date(F.regexp_replace(found, "/", "-"), "yyyy-M-d")


# --- X7 -------------------------------------------------------------------
def month_floor(c: str | Column) -> Column:
    return F.trunc(col(c), "month")


def yearmon(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


# --- X8 -------------------------------------------------------------------
def blank_to_null(c: str | Column) -> Column:
    """Trimmed cell; blank cells and the text ``NA`` are null (the wallet reader does both)."""
    c = F.trim(col(c))
    return F.when(~c.isin("", "NA"), c)


def full_name(first: str | Column, last: str | Column) -> Column:
    """``trimws(paste(first, last))`` with blank parts skipped."""
    return F.trim(F.concat_ws(" ", col(first), col(last)))


def strip_account_code(c: str | Column) -> Column:
    """``50000 Product COGS`` -> ``Product COGS``."""
    return F.regexp_replace(col(c), r"^[0-9]+ ", "")


def rlike_or_false(c: str | Column, pattern: str) -> Column:
    """``grepl`` semantics: a null input does not match (R returns FALSE)."""
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


# --- F3 -------------------------------------------------------------------
def currency_ok(c: str | Column = "currency") -> Column:
    """``toupper(currency) %in% c('USD', '')``: null currency is excluded."""
    return F.coalesce(F.upper(col(c)).isin("USD", ""), F.lit(False))


def not_conversion(c: str | Column = "type") -> Column:
    """``!grepl('conversion', type, ignore.case=TRUE)``: null type is kept."""
    return ~rlike_or_false(c, "(?i)conversion|currency conversion")


def successful(c: str | Column = "status") -> Column:
    return F.coalesce(col(c).isin(*SUCCESSFUL_STATUSES), F.lit(False))


def credit_or_null(c: str | Column = "balance_impact") -> Column:
    """``balance_impact %in% c('credit', NA)``: true for null too."""
    c = col(c)
    return c.isNull() | (c == "credit")


def revenue_predicate() -> Column:
    """Revenue subset V of the ledger (USD, successful, not conversion, credit/null).

    Used as a row filter, where a null conjunct drops the row just as false does,
    so the status test is the bare ``IN`` (pushed to the Parquet scan) rather
    than its null-safe form.
    """
    return currency_ok() & F.col("status").isin(*SUCCESSFUL_STATUSES) & not_conversion() & credit_or_null()


def is_sale() -> Column:
    """``!is_refund & amount > 0`` with R's NA-as-false row selection."""
    return F.coalesce(~F.col("is_refund") & (F.col("amount") > 0), F.lit(False))


def is_refund() -> Column:
    return F.coalesce(F.col("is_refund"), F.lit(False))


# --- X9 / sums ------------------------------------------------------------
def sum0(c: Column) -> Column:
    """``sum(x, na.rm=TRUE)``: 0 over no rows."""
    return F.coalesce(F.sum(c), F.lit(0).cast(MONEY))


def dbl(c: str | Column) -> Column:
    """Money leaves the engine as double, only at the edge."""
    return col(c).cast("double")


def pct(num: Column, den: Column, digits: int = 1) -> Column:
    """``round(num / den * 100, digits)`` on doubles, null when den is 0."""
    return F.round(F.try_divide(num.cast("double"), den.cast("double")) * 100.0, digits)


def in_range(c: str | Column, lo, hi) -> Column:
    return col(c).between(F.lit(lo), F.lit(hi))


# --- X2 / X3 / X4 / X5 / X10: text forms -----------------------------------
def fmt_currency(c: str | Column) -> Column:
    """``$1,235`` / ``-$1,235``, ``N/A`` when null (half-even like R)."""
    c = col(c)
    body = F.format_number(F.abs(c), 0)
    return F.when(c.isNull(), F.lit("N/A")).otherwise(
        F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), body)
    )


def fmt_number(c: str | Column) -> Column:
    """Rounded with thousands separators, ``N/A`` when null."""
    c = col(c)
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_number(c, 0))


def fmt_money2(c: str | Column, null_text: str = "") -> Column:
    """Sign before the dollar: ``-$1,234.50``; blank for null."""
    c = col(c)
    return F.when(c.isNull(), F.lit(null_text)).otherwise(
        F.concat(
            F.when(c < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(c), 2)
        )
    )


def fmt_pct(c: str | Column, signed: bool = False) -> Column:
    """``12.5%`` (or ``+12.5%``), ``60%`` for a whole number, ``N/A`` when null."""
    c = col(c)
    sign = F.when(c >= 0, F.lit("+")).otherwise(F.lit("")) if signed else F.lit("")
    return F.when(c.isNull(), F.lit("N/A")).otherwise(
        F.concat(sign, F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit("%"))
    )


def count_label(n: str | Column, noun: str) -> Column:
    """``1 refund`` / ``3 refunds``."""
    n = col(n)
    return F.concat(
        n.cast("string"), F.lit(" " + noun), F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
    )
