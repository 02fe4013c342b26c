"""Gateway extracts (text) -> the 14-column typed ledger shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import CARD, CHECKOUT
from ..schema import LEDGER_BASE, MONEY

# The ten card-export columns read by name.
CARD_COLUMNS = [
    "Transaction ID", "Transaction Type", "Transaction Status", "Created Datetime",
    "Amount Submitted For Settlement", "Customer Email", "Customer First Name",
    "Customer Last Name", "Order ID", "Currency ISO Code",
]

# Wallet columns and the default used when a column is absent.
WALLET_DEFAULTS = {
    "Transaction ID": None,
    "Date": None,
    "Gross": "0",
    "Fee": "0",
    "Net": "0",
    "Status": "unknown",
    "Type": None,
    "Item Title": None,
    "Currency": "USD",
    "Name": None,
    "From Email Address": None,
    "Balance Impact": "credit",
}

# The ten checkout-export columns read by name.
CHECKOUT_COLUMNS = [
    "id", "Created date (UTC)", "Amount", "Amount Refunded", "Fee", "Status", "Description", "Currency",
    "Customer Description", "Customer Email",
]
#: columns of each kind of export with the default where a file lacks them
EXTRACT_COLUMNS: dict[str, dict[str, str | None]] = {
    "card": dict.fromkeys(CARD_COLUMNS),
    "wallet": WALLET_DEFAULTS,
    "checkout": dict.fromkeys(CHECKOUT_COLUMNS),
}


def _ledger_select(df: DataFrame, **cols: Column) -> DataFrame:
    """Project to the ledger schema, casting each column to its declared type."""
    return df.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in LEDGER_BASE.fields])


def get_col(df: DataFrame, name: str, default: str | None = None) -> Column:
    """Column by name, or a constant default when the extract lacks it (schema time)."""
    if name in df.columns:
        return F.col(f"`{name}`")
    return F.lit(default).cast("string")


def clean_header(df: DataFrame) -> DataFrame:
    """Strip a BOM, surrounding quotes and blanks from header names."""
    import re

    def clean(n: str) -> str:
        n = re.sub("^\ufeff", "", n)
        return re.sub('^"+|"+$', "", n).strip()

    return df.toDF(*[clean(c) for c in df.columns])


def card_kept() -> Column:
    """settled rows with an amount."""
    amount = F.col("`Amount Submitted For Settlement`")
    return amount.isNotNull() & (amount != "") & (F.lower(F.col("`Transaction Status`")) == "settled")


#: which records of an export its normaliser keeps
KEPT = {"card": card_kept, "wallet": lambda: F.lit(True), "checkout": lambda: F.lit(True)}


def card_fields() -> dict[str, Column]:
    amount = X.to_money(F.col("`Amount Submitted For Settlement`"))
    typ = F.col("`Transaction Type`")
    return dict(
        transaction_id=F.col("`Transaction ID`"),
        date=X.parse_us_date_prefix(F.col("`Created Datetime`")),
        amount=amount,
        fee=F.lit(None).cast(MONEY),
        net_amount=amount,
        status=F.lower(F.col("`Transaction Status`")),
        type=typ,
        description=F.col("`Order ID`"),
        currency=F.col("`Currency ISO Code`"),
        customer_name=X.full_name(F.col("`Customer First Name`"), F.col("`Customer Last Name`")),
        customer_email=F.col("`Customer Email`"),
        is_refund=typ == "credit",  # a row without type is neither sale nor refund
        balance_impact=F.when(typ == "credit", F.lit("debit")).when(typ.isNotNull(), F.lit("credit")),
    )


def wallet_fields(cell=None) -> dict[str, Column]:
    """``cell`` gives a column by name (a default where the extract lacks it); blank cells are NA as the wallet reader makes them."""
    c = lambda name: X.blank_to_null(cell(name) if cell else F.col(f"`{name}`"))
    typ = c("Type")
    return dict(
        transaction_id=c("Transaction ID"),
        date=X.parse_us_date(c("Date")),
        amount=X.clean_amount(c("Gross")),
        fee=X.clean_amount(c("Fee")),
        net_amount=X.clean_amount(c("Net")),
        status=F.lower(c("Status")),
        type=typ,
        description=c("Item Title"),
        currency=c("Currency"),
        customer_name=c("Name"),
        customer_email=c("From Email Address"),
        is_refund=X.rlike_or_false(typ, "(?i)refund"),
        balance_impact=F.lower(c("Balance Impact")),
    )


def checkout_fields() -> dict[str, Column]:
    """Refund iff ``Amount Refunded`` > 0; net = amount - refunded - fee."""
    amount = X.to_money(F.col("Amount"))
    refunded = X.to_money(F.col("`Amount Refunded`"))
    fee = X.to_money(F.col("Fee"))
    refund = F.coalesce(refunded > 0, F.lit(False))
    return dict(
        transaction_id=F.col("id"),
        date=X.parse_iso_date_prefix(F.col("`Created date (UTC)`")),
        amount=amount,
        fee=fee,
        net_amount=amount - F.coalesce(refunded, F.lit(0).cast(MONEY)) - fee,
        status=F.lower(F.col("Status")),
        type=F.when(refund, F.lit("refund")).otherwise(F.lit("payment")),
        description=F.col("Description"),
        currency=F.upper(F.col("Currency")),
        customer_name=F.col("`Customer Description`"),
        customer_email=F.col("`Customer Email`"),
        is_refund=refund,
        balance_impact=F.lit("credit"),
    )


def normalize_card(raw: DataFrame, source: str = CARD) -> DataFrame:
    """P1 + F4: settled card rows with an amount."""
    return _ledger_select(raw.where(card_kept()), source=F.lit(source), **card_fields())


def normalize_wallet(raw: DataFrame, source: str) -> DataFrame:
    """P2 + P4: wallet rows."""
    raw = clean_header(raw)
    return _ledger_select(raw, source=F.lit(source), **wallet_fields(lambda n: get_col(raw, n, WALLET_DEFAULTS[n])))


def normalize_checkout(raw: DataFrame, source: str = CHECKOUT) -> DataFrame:
    """Checkout rows."""
    return _ledger_select(raw, source=F.lit(source), **checkout_fields())


#: the columns of all kinds of export side by side, with the row's gateway and kind
TAGGED_COLUMNS = ["source", "kind", *dict.fromkeys(c for columns in EXTRACT_COLUMNS.values() for c in columns)]


def normalize_tagged(raw: DataFrame) -> DataFrame:
    """U1 + P1-P3 + F4 in one pass: rows of any number of gateways (``TAGGED_COLUMNS``), each by the rules of its kind."""
    kind = F.col("kind")
    card, wallet, checkout = card_fields(), wallet_fields(), checkout_fields()
    types = {f.name: f.dataType for f in LEDGER_BASE.fields}
    fields = {n: F.when(kind == "card", card[n].cast(types[n])).when(kind == "wallet", wallet[n].cast(types[n])).otherwise(
        checkout[n].cast(types[n])) for n in card}
    return _ledger_select(raw.where((kind != "card") | card_kept()), source=F.col("source"), **fields)


def union_extracts(parts: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns null, absent inputs (None) skipped."""
    present = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def failure_histogram(card_raw: DataFrame, statuses) -> DataFrame:
    """A1: failed card attempts by (month, lower status); not windowed at load.

    A partial aggregate per task then one shuffle of (month, status) keys; a hot
    status only grows a partial count, never a task's input.
    """
    st = F.lower(F.col("`Transaction Status`"))
    month = X.month_floor(X.parse_us_date_prefix(F.col("`Created Datetime`")))
    return (
        card_raw.where(st.isin(*statuses))
        .groupBy(month.alias("month"), st.alias("status"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
