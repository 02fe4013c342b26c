"""Statement operators over many statements at once: M1-M8 (+ the statement binding B3).

A statement is ``(statement_id, line_no, label, value)``; row order is the
``line_no`` carried from the scan.  Every metric is a ``groupBy(statement_id)``
with conditional aggregates, so N statements cost one shuffle of N small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import MONEY_SUM
from ..sources.bindings import ACCOUNTS
from .books import REVENUE_TYPES

# Statement layout (label, kind) in line order.  Leaf accounts are
# the book accounts; ``sub`` marks a parent account followed by its own total line.
COGS_ACCOUNTS = ACCOUNTS[:8] + ["Warranty Expense"]
EXPENSE_ACCOUNTS = ACCOUNTS[8:17]
SUB_TOTALLED = {
    "60700 Legal & Professional Fees",
    "60900 Marketing",
    "61800 Office Expenses",
    "62100 Staffing",
    "63200 Travel",
}


def _layout() -> list[tuple[str, str]]:
    lines = [("Income", "header"), ("Total for Income", "income")]
    lines.append(("Cost of Goods Sold", "header"))
    lines += [(a, "leaf") for a in COGS_ACCOUNTS]
    lines += [("Total for Cost of Goods Sold", "cogs"), ("Gross Profit", "gross_profit")]
    lines.append(("Expenses", "header"))
    for a in EXPENSE_ACCOUNTS:
        lines.append((a, "leaf"))
        if a in SUB_TOTALLED:
            lines.append(("Total for " + a, "subtotal"))
    lines += [("Total for Expenses", "expenses"), ("Net Operating Income", "noi"), ("Net Income", "net_income")]
    return lines


LAYOUT = _layout()
LINE_NO = {label: i + 1 for i, (label, _) in enumerate(LAYOUT)}

# Headline lookups (first match, any case), as in the P&L sheet.
METRIC_PATTERNS = {
    "gross_revenue": "^Total for Income",
    "cogs": "^Total for Cost of Goods Sold",
    "gross_profit": "^Gross Profit$",
    "total_expenses": "^Total for Expenses",
    "net_income": r"^Net Income$|^Net Income\b",
}
# Cost metrics as sums of exact labels.
COST_LABELS = {
    "product_cogs": ["50000 Product COGS"],
    "shipping_cost": ["50700 Shipping & Delivery", "50701 Freight IN"],
    "processing_fees_total": ["51000 Bank Charges", "51001 PayPal Fees", "51100 Credit Card Fees"],
    "packaging": ["50500 Packaging"],
    "commissions": ["50900 Commissions"],
    "warranty": ["Warranty Expense"],
}
FEE_LABELS = COST_LABELS["processing_fees_total"]
# Labels of COGS lines (any case).
COGS_LINE_PATTERN = "(?i)^5[0-9]{4}|^Cost of Goods|^Packaging|^Shipping|^Freight|^Commissions|^Warranty|^Bank Charge|^PayPal Fee|^Credit Card Fee"  # noqa: E501
# Key rows always shown in the statement display.
KEY_ROWS = [
    "Total for Income", "Total for Cost of Goods Sold", "Gross Profit",
    "Total for Expenses", "Net Operating Income", "Net Income",
]
# The 13 waterfall steps (label, measure).
WATERFALL_STEPS = [
    ("Gross Revenue", "absolute"),
    ("Product COGS", "relative"),
    ("Other COGS", "relative"),
    ("Gross Profit", "total"),
    ("Legal & Prof.", "relative"),
    ("Marketing", "relative"),
    ("Staffing", "relative"),
    ("Office & Rent", "relative"),
    ("Website Costs", "relative"),
    ("Amortization", "relative"),
    ("Travel & Taxes", "relative"),
    ("Finance & Other", "relative"),
    ("Net Income", "total"),
]
# First non-null match (case-sensitive) for the named waterfall costs.
WATERFALL_PATTERNS = {
    "pcogs": "^50000 Product COGS",
    "legal": "^Total for 60700",
    "mkt": "^Total for 60900 Marketing",
    "staff": "^Total for 62100 Staffing",
    "office": "^Total for 61800 Office",
    "web": "^63800 Website",
    "amort": "^65000 Amortization",
    "travel": "^Total for 63200 Travel",
    "tax_a": "^63001 MD PTE",
    "tax_b": "^63000 Taxes",
}


def _line_no(label: Column) -> Column:
    m = F.create_map(*[x for lbl, n in LINE_NO.items() for x in (F.lit(lbl), F.lit(n))])
    return m[label]


def statements_from_books(books: DataFrame) -> DataFrame:
    """Binding B3: one P&L statement per entity from its book entries.

    One pass over the books: an aggregate by (entity, account); section totals
    are windows by entity over that small aggregate (at most 18 rows per
    entity); every line is emitted by a single ``inline`` — leaf lines from each
    account row, section lines from the entity's first row.  No join, no cross
    product, and the books are read once.
    """
    out_amt = F.when(F.col("amount") < 0, -F.col("amount"))
    inc_amt = F.when(F.col("trans_type").isin(*REVENUE_TYPES) & (F.col("amount") > 0), F.col("amount"))
    acc = books.groupBy("entity", "split").agg(
        F.sum(out_amt).cast(MONEY_SUM).alias("spent"),
        F.sum(inc_amt).cast(MONEY_SUM).alias("income"),
    )
    z = F.lit(0).cast(MONEY_SUM)
    w = Window.partitionBy("entity")
    acc = acc.select(
        "entity", "split", "spent",
        F.coalesce(F.sum("income").over(w), z).alias("inc"),
        F.coalesce(F.sum(F.when(F.col("split").isin(*COGS_ACCOUNTS), F.col("spent"))).over(w), z).alias("cogs"),
        F.coalesce(F.sum(F.when(F.col("split").isin(*EXPENSE_ACCOUNTS), F.col("spent"))).over(w), z).alias("exp"),
        (F.row_number().over(w.orderBy("split")) == 1).alias("first"),
    )
    is_leaf = F.col("spent").isNotNull() & F.col("split").isin(*(COGS_ACCOUNTS + EXPENSE_ACCOUNTS))
    gp = F.col("inc") - F.col("cogs")
    noi = gp - F.col("exp")
    null = F.lit(None).cast(MONEY_SUM)
    section = [
        ("Income", null), ("Total for Income", F.col("inc")),
        ("Cost of Goods Sold", null), ("Total for Cost of Goods Sold", F.col("cogs")),
        ("Gross Profit", gp), ("Expenses", null), ("Total for Expenses", F.col("exp")),
        ("Net Operating Income", noi), ("Net Income", noi),
    ]
    rows = F.array(
        F.struct(F.when(is_leaf, F.col("split")).alias("label"), F.col("spent").alias("value")),
        F.struct(
            F.when(is_leaf & F.col("split").isin(*SUB_TOTALLED), F.concat(F.lit("Total for "), F.col("split"))).alias("label"),
            F.col("spent").alias("value"),
        ),
        *[F.struct(F.when(F.col("first"), F.lit(lbl)).alias("label"), v.cast(MONEY_SUM).alias("value")) for lbl, v in section],
    )
    lines = acc.select(F.col("entity").alias("statement_id"), F.inline(rows)).where(F.col("label").isNotNull())
    return lines.select(
        F.col("statement_id").cast("int").alias("statement_id"),
        _line_no(F.col("label")).cast("int").alias("line_no"),
        "label",
        F.col("value").cast(MONEY_SUM).alias("value"),
    )


def _first_match(pattern: str, *, non_null: bool = False) -> Column:
    """Value of the lowest ``line_no`` whose label matches (the value may be null)."""
    cond = X.rlike_or_false("label", pattern)
    if non_null:
        cond = cond & F.col("value").isNotNull()
    # rows that do not match get a null ordering, which min_by skips
    return F.min_by(F.col("value"), F.when(cond, F.col("line_no")))


def statement_metrics(stmts: DataFrame) -> DataFrame:
    """M1 (+ A12): five headline values per statement; first match wins, even if
    null; and the expense KPI |total expenses| with null as 0."""
    m = stmts.groupBy("statement_id").agg(
        *[_first_match("(?i)" + pat).alias(name) for name, pat in METRIC_PATTERNS.items()]
    )
    return m.withColumn("expenses_kpi", F.abs(F.coalesce("total_expenses", F.lit(0).cast(MONEY_SUM))))


def _sum_labels(labels: list[str]) -> Column:
    """Sum of non-null values of exact labels; null if none."""
    return F.sum(F.when(F.col("label").isin(*labels), F.col("value")))


def cost_metrics(stmts: DataFrame) -> DataFrame:
    """M2: cost metrics per statement (sums of exact labels) and total COGS (M1)."""
    return stmts.groupBy("statement_id").agg(
        _sum_labels(COST_LABELS["product_cogs"]).alias("product_cogs"),
        _sum_labels(COST_LABELS["shipping_cost"]).alias("shipping_cost"),
        _sum_labels(COST_LABELS["processing_fees_total"]).alias("processing_fees_total"),
        _first_match("(?i)" + METRIC_PATTERNS["cogs"]).alias("total_cogs"),
        _sum_labels(COST_LABELS["packaging"]).alias("packaging"),
        _sum_labels(COST_LABELS["commissions"]).alias("commissions"),
        _sum_labels(COST_LABELS["warranty"]).alias("warranty"),
    )


def cogs_breakdown(stmts: DataFrame) -> DataFrame:
    """M4 + F8 + P7: COGS lines with a value, not totals, by |value| desc per statement."""
    return (
        stmts.where(
            X.rlike_or_false("label", COGS_LINE_PATTERN)
            & F.col("value").isNotNull()
            & ~X.rlike_or_false("label", "^Total for")
        )
        .select("statement_id", "line_no", "label", "value", X.strip_account_code("label").alias("label_clean"))
        .orderBy("statement_id", F.abs("value").desc(), "line_no")
    )


def processing_fees(stmts: DataFrame) -> DataFrame:
    """M5 + W3: the three fee lines with a value, cleaned label and share per statement."""
    fees = stmts.where(F.col("label").isin(*FEE_LABELS) & F.col("value").isNotNull())
    tot = X.dbl(F.sum("value").over(Window.partitionBy("statement_id")))
    return fees.select(
        "statement_id", "line_no", "label",
        X.strip_account_code("label").alias("label_clean"),
        "value",
        (X.dbl("value") / tot).alias("share"),
    )


def _wide_waterfall(stmts: DataFrame) -> DataFrame:
    aggs = [_first_match("(?i)" + METRIC_PATTERNS[m]).alias(m) for m in ("gross_revenue", "cogs", "total_expenses", "net_income")]
    aggs += [F.coalesce(_first_match(pat, non_null=True), F.lit(0).cast(MONEY_SUM)).alias(k) for k, pat in WATERFALL_PATTERNS.items()]
    return stmts.groupBy("statement_id").agg(*aggs)


def waterfall(stmts: DataFrame) -> DataFrame:
    """M6 + M3: 13 steps per statement; 'other' = total expenses - named ones."""
    w = _wide_waterfall(stmts)
    z = F.lit(0).cast(MONEY_SUM)
    c = F.col
    rev = F.coalesce(c("gross_revenue"), z)
    ocogs = F.coalesce(c("cogs"), z) - c("pcogs")
    tax = c("tax_a") + c("tax_b")
    named = c("legal") + c("mkt") + c("staff") + c("office") + c("web") + c("amort") + c("travel") + tax
    other = F.coalesce(c("total_expenses"), z) - named
    net = F.coalesce(c("net_income"), z)
    values = [
        rev, -c("pcogs"), -ocogs, rev - c("pcogs") - ocogs, -c("legal"), -c("mkt"), -c("staff"),
        -c("office"), -c("web"), -c("amort"), -(c("travel") + tax), -other, net,
    ]
    steps = F.array(
        *[
            F.struct(F.lit(i + 1).alias("step"), F.lit(lbl).alias("label"), v.cast(MONEY_SUM).alias("value"), F.lit(meas).alias("measure"))
            for i, ((lbl, meas), v) in enumerate(zip(WATERFALL_STEPS, values))
        ]
    )
    return w.select("statement_id", F.inline(steps))


def waterfall_levels(wf: DataFrame) -> DataFrame:
    """M7 + W4: running level per statement (what the waterfall chart draws).

    ``level`` is the running sum of absolute/relative steps; a total step shows
    that level, and ``residual`` is how far the stated total is from it.
    """
    w = Window.partitionBy("statement_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    lvl = F.sum(F.when(F.col("measure") != "total", F.col("value")).otherwise(F.lit(0))).over(w)
    return wf.select(
        "statement_id", "step", "label", "measure", "value",
        lvl.cast(MONEY_SUM).alias("level"),
        F.when(F.col("measure") == "total", F.col("value") - lvl).cast(MONEY_SUM).alias("residual"),
    )


def statement_display(stmts: DataFrame) -> DataFrame:
    """M8 + P10 + F13: lines with a value or a key label, money text, key flag."""
    return (
        stmts.where(F.col("value").isNotNull() | F.col("label").isin(*KEY_ROWS))
        .select(
            "statement_id", "line_no", F.col("label").alias("account"),
            X.fmt_money2("value").alias("amount"),
            F.col("label").isin(*KEY_ROWS).alias("is_key"),
        )
        .orderBy("statement_id", "line_no")
    )
