"""Explorer tables: F11 outgoing, F12 optional filters, F16 filter/sort/page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params
from .ledger import user_range


def explore_filtered(filtered: DataFrame, p: Params) -> DataFrame:
    """F12 + P9: optional min/max amount and status set, then the 13 display columns."""
    conds: list[Column] = []
    if p.amount_min is not None:
        conds.append(F.col("amount") >= F.lit(p.amount_min).cast("decimal(18,2)"))
    if p.amount_max is not None:
        conds.append(F.col("amount") <= F.lit(p.amount_max).cast("decimal(18,2)"))
    if p.statuses:
        conds.append(F.col("status").isin(*p.statuses))
    df = filtered.where(reduce(lambda a, b: a & b, conds)) if conds else filtered
    return df.select(
        "date", "source", "status", "type", "amount", "fee",
        F.col("net_amount").alias("net"),
        F.col("is_refund").alias("refund"),
        "currency", "description",
        F.col("customer_name").alias("customer"),
        F.col("customer_email").alias("email"),
        F.col("transaction_id").alias("txn_id"),
    )


def outgoing(led: DataFrame, p: Params) -> DataFrame:
    """debit impact or refund or negative amount in the date range.

    The dashboard ignores the source filter here; ``outgoing_uses_sources`` opts in.
    """
    cond = user_range(led, p) & (
        (F.col("balance_impact") == "debit") | (F.col("is_refund") == True) | (F.col("amount") < 0)  # noqa: E712
    )
    if p.outgoing_uses_sources:
        cond = cond & F.col("source").isin(*p.sources)
    return led.where(cond).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "source", "status", "type", "amount", "fee",
        F.col("net_amount").alias("net"),
        "balance_impact",
        F.col("is_refund").alias("refund"),
        "description",
        F.col("customer_name").alias("customer"),
        F.col("transaction_id").alias("txn_id"),
    )


def _beyond(keys: list[tuple[str, bool]], last: tuple) -> Column:
    """Rows that sort after ``last``: beyond it in some key and equal to it in all keys before."""
    cond, same = F.lit(False), F.lit(True)
    for (c, desc), v in zip(keys, last, strict=True):
        x = F.col(c)
        later = (x < F.lit(v)) | x.isNull() if desc else x > F.lit(v)  # nulls last descending, first ascending
        cond, same = cond | (same & later), same & (x == F.lit(v))
    return cond


def explore(df: DataFrame, contains: dict[str, str] | None = None,
            ranges: dict[str, tuple] | None = None, order_by: list[tuple[str, bool]] | None = None,
            limit: int | None = None, offset: int = 0, search: str | None = None,
            tie_break: str | None = None, after: tuple | None = None) -> DataFrame:
    """F16: per-column substring filter, global search, ranges, sort and a page.

    The sort is total (``tie_break`` appended) so a page is deterministic; with a
    limit Spark plans a top-k (TakeOrderedAndProject), not a full sort.  An
    ``offset`` costs offset + limit rows in one place; for deep pages give
    ``after``, the sort values (not null) of the last row of the page before:
    rows up to it are filtered out and any page costs ``limit`` rows.
    """
    conds: list[Column] = []
    for c, s in (contains or {}).items():
        conds.append(F.coalesce(F.lower(F.col(c).cast("string")).contains(s.lower()), F.lit(False)))
    for c, (lo, hi) in (ranges or {}).items():
        if lo is not None:
            conds.append(F.col(c) >= F.lit(lo))
        if hi is not None:
            conds.append(F.col(c) <= F.lit(hi))
    if search:
        any_col = [F.coalesce(F.lower(F.col(c).cast("string")).contains(search.lower()), F.lit(False)) for c in df.columns]
        conds.append(reduce(lambda a, b: a | b, any_col))
    if after is not None:
        conds.append(_beyond([*(order_by or []), *([(tie_break, False)] if tie_break else [])], after))
    out = df.where(reduce(lambda a, b: a & b, conds)) if conds else df
    keys = [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first() for c, desc in (order_by or [])]
    if tie_break:
        keys.append(F.col(tie_break).asc())
    if keys:
        out = out.orderBy(*keys)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out
