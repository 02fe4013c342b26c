"""Bind the driver's TPC-H-like tables to the shapes the engine consumes.

The gateways' CSV extracts and the bookkeeping sheets are not part of the test
data, so they are derived from ``orders`` and ``lineitem ⋈ supplier ⋈ part`` by
fixed rules (FIXTURES.md B1-B3).  Extracts come out in *text form*, as a CSV
reader would hand them over, so that the parsers in ``normalize`` are exercised.
Everything is a lazy projection of a table scan: no driver-side data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import TAGGED_COLUMNS
from ..params import CARD, CHECKOUT, WALLET_A, WALLET_B

# Gateway of an order by o_custkey % 4.
GATEWAY_BY_MOD = {0: CARD, 1: WALLET_A, 2: WALLET_B, 3: CHECKOUT}
# An order of the gateway is a refund when o_orderkey % m == 0.
REFUND_MOD = {CARD: 23, WALLET_A: 47, WALLET_B: 101, CHECKOUT: 31}
# Status of a filled order ('F') per gateway.
FILLED_STATUS = {CARD: "settled", WALLET_A: "completed", WALLET_B: "completed", CHECKOUT: "paid"}
# Status of a failed order ('P') by o_orderpriority.
FAILED_STATUS = {
    "1-URGENT": "gateway_rejected",
    "2-HIGH": "processor_declined",
    "3-MEDIUM": "failed",
    "4-NOT SPECIFIED": "voided",
    "5-LOW": "settlement_declined",
}

# Chart of the 18 accounts a book entry is split to, by p_size % 18.
ACCOUNTS = [
    "50000 Product COGS",
    "50500 Packaging",
    "50700 Shipping & Delivery",
    "50701 Freight IN",
    "50900 Commissions",
    "51000 Bank Charges",
    "51001 PayPal Fees",
    "51100 Credit Card Fees",
    "60700 Legal & Professional Fees",
    "60900 Marketing",
    "61800 Office Expenses",
    "62100 Staffing",
    "63000 Taxes & Licenses",
    "63001 MD PTE Tax",
    "63200 Travel",
    "63800 Website & Software",
    "65000 Amortization",
    "Warranty Expense",
]
# Transaction type of a book entry by (l_returnflag, l_linestatus).
BOOK_TYPES = {
    ("N", "O"): "Sales Receipt",
    ("N", "F"): "Deposit",
    ("A", "F"): "Expense",
    ("A", "O"): "Bill",
    ("R", "F"): "Purchase Order",
    ("R", "O"): "Journal Entry",
}
# Carrier word put before the supplier name by s_suppkey % 5.
CARRIER_WORD = {0: "Northern Freight ", 1: "Metro Express "}


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Scan with column pruning; splits follow ``spark.sql.files.maxPartitionBytes`` at every size."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def _case(expr: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(expr == F.lit(k), F.lit(v)) if out is None else out.when(expr == F.lit(k), F.lit(v)))
    return out.otherwise(F.lit(default))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the gateway, refund flag, status and money of the binding."""
    o = read_table(
        spark, sf_dir, "orders",
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
    )
    g = _case(F.col("o_custkey") % 4, GATEWAY_BY_MOD)
    k = F.col("o_orderkey")
    refund = None
    for gw, m in REFUND_MOD.items():
        cond = (F.col("gateway") == gw) & (k % m == 0)
        refund = cond if refund is None else refund | cond
    status = (
        F.when(F.col("o_orderstatus") == "F", _case(F.col("gateway"), FILLED_STATUS))
        .when(F.col("o_orderstatus") == "O", F.lit("pending"))
        .otherwise(_case(F.col("o_orderpriority"), FAILED_STATUS))
    )
    currency = (
        F.when(k % 10 == 7, F.lit("EUR"))
        .when(k % 10 == 8, F.lit(""))
        .when(k % 10 == 9, F.lit(None).cast("string"))
        .otherwise(F.lit("usd"))
    )
    return (
        o.withColumn("gateway", g)
        .select(
            k.alias("k"),
            F.col("o_custkey").alias("ck"),
            "gateway",
            F.col("o_orderpriority").alias("pr"),
            F.col("o_orderdate").alias("ts"),
            refund.alias("rf"),
            status.alias("status"),
            currency.alias("currency"),
            F.expr("cast(round(cast(o_totalprice as decimal(18,2)) * 0.01, 2) as decimal(18,2))").alias("amt"),
        )
        .withColumn("fee", F.expr("cast(round(amt * 0.029 + 0.30, 2) as decimal(18,2))"))
    )


def _money_text(x: Column, k: Column) -> Column:
    """Wallet money text: sign, sometimes ``$`` or ``$ ``, thousands separators."""
    prefix = F.when(k % 3 == 0, F.lit("$")).when(k % 3 == 1, F.lit("$ ")).otherwise(F.lit(""))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), prefix, F.format_number(F.abs(x), 2))


def _named(*cells: tuple[str, Column]) -> dict[str, Column]:
    return dict(cells)


def _extract(spark: SparkSession, sf_dir: str, facts: DataFrame | None, gateway: str, columns: list[Column]) -> DataFrame:
    f = (facts if facts is not None else order_facts(spark, sf_dir)).where(F.col("gateway") == gateway)
    return f.select(*columns)


def card_extract(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Card gateway export: every attempt (failures too), all columns text."""
    return _extract(spark, sf_dir, facts, CARD, [c.alias(n) for n, c in card_cells().items()])


def wallet_extract(spark: SparkSession, sf_dir: str, gateway: str = WALLET_A, facts: DataFrame | None = None) -> DataFrame:
    """Wallet export (two wallets share the shape); blanks are ``''`` until read."""
    return _extract(spark, sf_dir, facts, gateway, [c.alias(n) for n, c in wallet_cells(gateway).items()])


def checkout_extract(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Checkout export: refunds appear as ``Amount Refunded`` on the payment row."""
    return _extract(spark, sf_dir, facts, CHECKOUT, [c.alias(n) for n, c in checkout_cells().items()])


def tagged_extracts(facts: DataFrame) -> DataFrame:
    """All gateways' exports as one table (``normalize.TAGGED_COLUMNS``): the orders are read once."""
    cells = {CARD: card_cells(), WALLET_A: wallet_cells(WALLET_A), WALLET_B: wallet_cells(WALLET_B), CHECKOUT: checkout_cells()}
    kinds = {CARD: "card", WALLET_A: "wallet", WALLET_B: "wallet", CHECKOUT: "checkout"}
    gateway, out = F.col("gateway"), [F.col("gateway").alias("source"), _case(F.col("gateway"), kinds).alias("kind")]
    for name in TAGGED_COLUMNS[2:]:
        cell = F.lit(None).cast("string")
        for g, own in cells.items():
            if name in own:
                cell = F.when(gateway == g, own[name]).otherwise(cell)
        out.append(cell.alias(name))
    return facts.select(*out)


def card_cells() -> dict[str, Column]:
    k, ck = F.col("k"), F.col("ck")
    return _named(
        ("Transaction ID", F.concat(F.lit("c-"), k)),
        ("Transaction Type", F.when(F.col("rf"), F.lit("credit")).otherwise(F.lit("sale"))),
        ("Transaction Status", F.col("status")),
        ("Created Datetime", F.date_format("ts", "MM/dd/yyyy HH:mm:ss")),
        ("Merchant Account ID", F.lit("main")),
        ("Amount Submitted For Settlement", F.when(k % 17 == 0, F.lit("")).otherwise(F.col("amt").cast("string"))),
        ("Customer Email", F.concat(F.lit("cust"), ck, F.lit("@example.com"))),
        ("Customer First Name", F.when(k % 19 == 0, F.lit("")).otherwise(F.lit("Cust"))),
        ("Customer Last Name", F.concat(F.lit("No"), ck)),
        ("Order ID", F.concat(F.lit("o-"), k)),
        ("Currency ISO Code", F.col("currency")),
    )


def wallet_cells(gateway: str) -> dict[str, Column]:
    k, ck = F.col("k"), F.col("ck")
    neg = F.col("rf") | (F.col("pr") == "3-MEDIUM")
    signed = F.when(neg, -F.col("amt")).otherwise(F.col("amt"))
    wtype = (
        F.when(F.col("rf"), F.lit("Payment Refund"))
        .when(F.col("pr") == "4-NOT SPECIFIED", F.lit("General Currency Conversion"))
        .when(k % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.lit("Website Payment"))
    )
    impact = (
        F.when(k % 11 == 0, F.lit(""))
        .when(F.col("pr") == "3-MEDIUM", F.lit("Debit"))
        .otherwise(F.lit("Credit"))
    )
    date_fmt = "MM/dd/yyyy" if gateway == WALLET_A else "M/d/yyyy"
    prefix = "wa-" if gateway == WALLET_A else "wb-"
    return _named(
        ("Date", F.date_format("ts", date_fmt)),
        ("Time", F.lit("00:00:00")),
        ("Name", F.concat(F.lit("Cust No"), ck)),
        ("Type", wtype),
        ("Status", F.initcap("status")),
        ("Currency", F.col("currency")),
        ("Gross", _money_text(signed, k)),
        ("Fee", _money_text(F.col("fee"), k)),
        ("Net", _money_text(signed - F.col("fee"), k)),
        ("From Email Address", F.concat(F.lit("cust"), ck, F.lit("@example.com"))),
        ("Transaction ID", F.concat(F.lit(prefix), k)),
        ("Item Title", F.concat(F.lit("Item "), k % 50)),
        ("Balance Impact", impact),
    )


def checkout_cells() -> dict[str, Column]:
    k, ck = F.col("k"), F.col("ck")
    refunded = (
        F.when(F.col("rf"), F.col("amt").cast("string"))
        .when(k % 2 == 0, F.lit("0"))
        .otherwise(F.lit(""))
    )
    return _named(
        ("id", F.concat(F.lit("k-"), k)),
        ("Created date (UTC)", F.date_format("ts", "yyyy-MM-dd HH:mm")),
        ("Amount", F.col("amt").cast("string")),
        ("Amount Refunded", refunded),
        ("Fee", F.when(k % 29 == 0, F.lit("")).otherwise(F.col("fee").cast("string"))),
        ("Status", F.col("status")),
        ("Description", F.concat(F.lit("Order o-"), k)),
        ("Currency", F.col("currency")),
        ("Customer Description", F.concat(F.lit("Cust No"), ck)),
        ("Customer Email", F.concat(F.lit("cust"), ck, F.lit("@example.com"))),
    )


def books_sheet(spark: SparkSession, sf_dir: str, date_from=None, date_to=None) -> DataFrame:
    """Transaction-list sheet (text cells) from ``lineitem ⋈ supplier ⋈ part``.

    Like the accounting package's export, the sheet covers a date range; the
    range is a predicate on the raw ``l_shipdate`` so that it reaches the
    parquet scan (``PushedFilters``) before any join.

    Join strategy is left to Catalyst/AQE: the dimension sides are broadcast only
    when their measured size is under ``spark.sql.autoBroadcastJoinThreshold``,
    else sort-merge with AQE skew splitting.
    """
    li = read_table(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        "l_extendedprice", "l_shipdate",
    )
    if date_from is not None:
        li = li.where(F.col("l_shipdate") >= F.lit(date_from.isoformat()).cast("timestamp_ntz"))
    if date_to is not None:
        end = date_to.fromordinal(date_to.toordinal() + 1).isoformat()
        li = li.where(F.col("l_shipdate") < F.lit(end).cast("timestamp_ntz"))
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    ttype = None
    for (rf, ls), v in BOOK_TYPES.items():
        cond = (F.col("l_returnflag") == rf) & (F.col("l_linestatus") == ls)
        ttype = F.when(cond, F.lit(v)) if ttype is None else ttype.when(cond, F.lit(v))
    amt = F.col("l_extendedprice").cast("decimal(18,2)")
    signed = F.when(F.col("l_returnflag") == "N", amt).otherwise(-amt)
    carrier = _case(F.col("s_suppkey") % 5, CARRIER_WORD, "")
    split = F.element_at(F.array(*[F.lit(a) for a in ACCOUNTS]), (F.col("p_size") % 18 + 1).cast("int"))
    return j.select(
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("date"),
        ttype.alias("trans_type"),
        F.col("l_orderkey").cast("string").alias("num"),
        F.lit("Yes").alias("posting"),
        F.concat(carrier, F.col("s_name")).alias("name"),
        F.col("p_type").alias("memo"),
        F.when(F.col("l_returnflag") == "N", F.lit("10100 Checking"))
        .otherwise(F.lit("20000 Accounts Payable")).alias("account"),
        split.alias("split"),
        signed.cast("string").alias("amount"),
        F.col("s_nationkey").alias("entity"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that keep books."""
    return read_table(spark, sf_dir, "supplier", "s_nationkey").select(F.col("s_nationkey").alias("entity")).distinct()


# --- delivered files: what gateways send is neither uniform nor whole -----------------------
PAGES = 3


def deliver(df: DataFrame, path: str, key: str, *, keep_blanks: bool, damaged: bool = False) -> str:
    """The extract as ``PAGES`` header files with different column orders: as given, reversed, rotated.

    With ``damaged``, rows whose number in ``key`` leaves 5, 6 or 7 divided by 97
    come a second time as a line that is no record: its last cell cut off, one cell
    too many, a quote that never closes.
    """
    names = df.columns
    orders = [names, names[::-1], names[1:] + names[:1]]
    options = {"nullValue": "NA" if keep_blanks else "", "escape": '"'}
    page = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(PAGES)).cast("int")
    text, head = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, order in enumerate(orders):
        text = F.when(F.col("page") == i, F.to_csv(F.struct(*[F.col(f"`{c}`") for c in order]), options)).otherwise(text)
        head = F.when(F.col("page") == i, F.lit(",".join(f'"{c}"' for c in order))).otherwise(head)
    number = F.regexp_extract(F.col(f"`{key}`"), "([0-9]+)$", 1).cast("long") % 97
    rows = df.withColumn("page", page).select("page", text.alias("line"), number.alias("odd"))
    lines = F.array(F.col("line"))
    if damaged:
        short = F.regexp_replace("line", r',("[^"]*"|[^,"]*)$', "")
        stray = F.regexp_replace("line", "^([^,]*),", '$1,"lost ')
        lines = F.when(F.col("odd") == 5, F.array("line", short)).when(
            F.col("odd") == 6, F.array(F.concat("line", F.lit(",more")), "line")).when(
            F.col("odd") == 7, F.array("line", stray)).otherwise(lines)
    body = rows.select("page", F.lit(1).alias("ord"), F.explode(lines).alias("line"))
    pages = df.sparkSession.range(PAGES, numPartitions=1).select(F.col("id").cast("int").alias("page"))
    top = pages.select("page", F.lit(0).alias("ord"), head.alias("line"))
    (
        top.unionByName(body)
        .repartition("page")
        .sortWithinPartitions("page", "ord")
        .select("page", "line")
        .write.mode("overwrite")
        .partitionBy("page")
        .text(path)
    )
    return path
