"""Query registry: one named DataFrame function per inventory item.

``QUERIES[name](ctx) -> DataFrame``.  ``run(spark, sf_dir, name)`` builds a
fresh :class:`Context` and casts money (decimal) to double at the edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators import books as B
from ..operators import explore as E
from ..operators import insights as I
from ..operators import ledger as L
from ..operators import normalize as N
from ..operators import revenue as R
from ..operators import statements as S
from ..params import CARD, CHECKOUT, DEFAULT, WALLET_A, WALLET_B, Params
from ..sources import bindings as BIND
from ..sources import files as FS
from .context import Context

QUERIES: dict[str, Callable[[Context], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def finish(df: DataFrame) -> DataFrame:
    """Money leaves as double; everything else keeps its type."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def run(spark: SparkSession, sf_dir: str, name: str, params: Params = DEFAULT, ctx: Context | None = None) -> DataFrame:
    ctx = ctx or Context(spark, sf_dir, params)
    return finish(QUERIES[name](ctx))


# Parameter variants used by some keys (fixed so that the oracle can mirror them).
SUBSET = (CARD, CHECKOUT)
EXPLORE = dict(amount_min=100, amount_max=2000, statuses=("completed", "settled"))


def _with(ctx: Context, **kw) -> Context:
    return ctx.derive(**kw)


# --- 2.1 sources / sinks ----------------------------------------------------
@query("scan_card")
def _scan_card(c: Context) -> DataFrame:
    path = BIND.deliver(c.card_raw, FS.new_path(c.spark, "card"), "Transaction ID", keep_blanks=True)
    return FS.read_extract_csv(c.spark, path, N.CARD_COLUMNS, keep_blanks=True)


@query("scan_wallet")
def _scan_wallet(c: Context) -> DataFrame:
    """Both wallets, each in files with column orders of their own; the names come from the headers."""
    path = FS.new_path(c.spark, "wallet")
    paths = [BIND.deliver(raw, f"{path}/{name}", "Transaction ID", keep_blanks=False)
             for name, raw in ((WALLET_A, c.wallet_a_raw), (WALLET_B, c.wallet_b_raw))]
    return FS.read_extract_csv(c.spark, paths, keep_blanks=False)


@query("scan_checkout")
def _scan_checkout(c: Context) -> DataFrame:
    path = BIND.deliver(c.checkout_raw, FS.new_path(c.spark, "checkout"), "id", keep_blanks=True)
    return FS.read_extract_csv(c.spark, path, N.CHECKOUT_COLUMNS, keep_blanks=True)


@query("scan_statement")
def _scan_statement(c: Context) -> DataFrame:
    return FS.scan_statements(c.spark, c.statements)


@query("scan_books")
def _scan_books(c: Context) -> DataFrame:
    return B.books_window(B.books_typed(FS.scan_books(c.spark, c.books_export, c.entities)), c.p)


@query("cache_roundtrip")
def _cache(c: Context) -> DataFrame:
    return _from_cache(c)[0]


def _from_cache(c: Context) -> tuple[DataFrame, DataFrame]:
    """Builds the cache, then loads it again: the second load must not build."""

    def never() -> DataFrame:
        raise AssertionError("a present cache was built again")

    path = FS.new_path(c.spark, "cache")
    FS.load_or_build_all(c.spark, path, lambda: c.ledger, lambda: c.failures)
    return FS.load_or_build_all(c.spark, path, never, never)


@query("cache_failures")
def _cache_failures(c: Context) -> DataFrame:
    return _from_cache(c)[1]


@query("load_report")
def _load_report(c: Context) -> DataFrame:
    return FS.load_report(c.spark, c.union, {"books": c.books}, c.p.gateways)


@query("export_csv")
def _export(c: Context) -> DataFrame:
    df = E.explore_filtered(c.filtered, c.p)
    path = FS.export_csv(df, FS.new_path(c.spark, "export"))
    return FS.read_back_typed(c.spark, path, df.schema)


@query("export_outgoing")
def _export_outgoing(c: Context) -> DataFrame:
    """S8, second export: the outgoing table written as CSV and read back."""
    df = E.outgoing(c.ledger, c.p)
    path = FS.export_csv(df, FS.new_path(c.spark, "outgoing"))
    return FS.read_back_typed(c.spark, path, df.schema)


# --- 2.2 projections / normalisation ------------------------------------------
@query("norm_card")
def _norm_card(c: Context) -> DataFrame:
    return c.norm_parts[0]


@query("norm_wallet")
def _norm_wallet(c: Context) -> DataFrame:
    return c.norm_parts[1].unionByName(c.norm_parts[2])


@query("norm_checkout")
def _norm_checkout(c: Context) -> DataFrame:
    return c.norm_parts[3]


@query("default_columns")
def _default_columns(c: Context) -> DataFrame:
    """P4 by file: wallet files that lack five columns."""
    parts = []
    for source, raw in ((WALLET_A, c.wallet_a_raw), (WALLET_B, c.wallet_b_raw)):
        thin = raw.drop("Balance Impact", "Fee", "Net", "Status", "Currency")
        path = BIND.deliver(thin, FS.new_path(c.spark, "thin"), "Transaction ID", keep_blanks=False)
        read = FS.read_extract_csv(c.spark, path, list(N.WALLET_DEFAULTS), keep_blanks=False, defaults=N.WALLET_DEFAULTS)
        parts.append(N.normalize_wallet(read, source))
    return N.union_extracts(parts)


@query("calendar_cols")
def _calendar(c: Context) -> DataFrame:
    return c.ledger.select("transaction_id", "date", "month", "yearmon", "yr")


@query("account_clean")
def _account_clean(c: Context) -> DataFrame:
    return c.books.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(
        "split", X.strip_account_code("split").alias("account_clean"), "n"
    )


@query("vendor_totals")
def _vendor_totals(c: Context) -> DataFrame:
    return c.vendors


@query("statement_display")
def _statement_display(c: Context) -> DataFrame:
    return S.statement_display(c.statements)


@query("clean_amount")
def _clean_amount(c: Context) -> DataFrame:
    w = c.wallet_a_raw.unionByName(c.wallet_b_raw)
    return w.select(
        F.col("`Transaction ID`").alias("transaction_id"),
        F.col("Gross").alias("gross_text"),
        X.clean_amount("Gross").alias("gross"),
        X.clean_amount("Fee").alias("fee"),
        X.clean_amount("Net").alias("net"),
    )


@query("parse_dates")
def _parse_dates(c: Context) -> DataFrame:
    card = c.card_raw.select(
        F.col("`Transaction ID`").alias("transaction_id"), X.parse_us_date_prefix("Created Datetime").alias("date")
    )
    wa = c.wallet_a_raw.select(F.col("`Transaction ID`").alias("transaction_id"), X.parse_us_date("Date").alias("date"))
    wb = c.wallet_b_raw.select(F.col("`Transaction ID`").alias("transaction_id"), X.parse_us_date("Date").alias("date"))
    ck = c.checkout_raw.select(
        F.col("id").alias("transaction_id"), X.parse_iso_date_prefix("Created date (UTC)").alias("date")
    )
    return card.unionByName(wa).unionByName(wb).unionByName(ck)


# --- 2.3 filters ------------------------------------------------------------------
@query("ledger_window")
def _ledger_window(c: Context) -> DataFrame:
    return c.ledger


@query("ledger_filtered")
def _ledger_filtered(c: Context) -> DataFrame:
    return _with(c, sources=SUBSET).filtered


@query("revenue")
def _revenue(c: Context) -> DataFrame:
    return c.revenue


@query("books_window")
def _books_window(c: Context) -> DataFrame:
    return c.books


@query("cogs_entries")
def _cogs_entries(c: Context) -> DataFrame:
    return c.cogs


@query("logistics_vendors")
def _logistics(c: Context) -> DataFrame:
    return B.logistics_vendors(c.vendors)


@query("logistics_table")
def _logistics_table(c: Context) -> DataFrame:
    return B.logistics_table(c.vendors)


@query("large_refunds")
def _large_refunds(c: Context) -> DataFrame:
    return I.large_refunds(c.ledger, c.p)


@query("outgoing")
def _outgoing(c: Context) -> DataFrame:
    return E.outgoing(c.ledger, c.p)


@query("explore_filtered")
def _explore_filtered(c: Context) -> DataFrame:
    cc = _with(c, **EXPLORE)
    return E.explore_filtered(cc.filtered, cc.p)


@query("month_window")
def _month_window(c: Context) -> DataFrame:
    return c.monthly_pl_filtered


@query("explore_page")
def _explore_page(c: Context) -> DataFrame:
    t = E.explore_filtered(c.filtered, c.p)
    return E.explore(
        t, contains={"status": "comp"}, ranges={"amount": (None, 3000)},
        order_by=[("amount", True)], limit=25, offset=25, tie_break="txn_id",
    )


# --- 2.4 joins -------------------------------------------------------------------------
@query("monthly_pl")
def _monthly_pl(c: Context) -> DataFrame:
    return c.monthly_pl


@query("monthly_pl_no_books")
def _monthly_pl_nb(c: Context) -> DataFrame:
    return B.monthly_pl_no_books(c.revenue_cube)


@query("source_semi")
def _source_semi(c: Context) -> DataFrame:
    return L.source_semi(c.spark, c.ledger, (WALLET_A, WALLET_B))


# --- 2.5 aggregations ------------------------------------------------------------------
@query("failure_histogram")
def _failures(c: Context) -> DataFrame:
    return c.failures


@query("monthly_revenue")
def _monthly_revenue(c: Context) -> DataFrame:
    return R.monthly_revenue(c.revenue_cube)


@query("monthly_sales_fees")
def _msf(c: Context) -> DataFrame:
    return R.monthly_sales_fees(c.revenue_cube)


@query("monthly_refunds")
def _mr(c: Context) -> DataFrame:
    return R.monthly_refunds(c.revenue_cube)


@query("books_monthly")
def _books_monthly(c: Context) -> DataFrame:
    return c.books_monthly


@query("books_monthly_window")
def _books_monthly_window(c: Context) -> DataFrame:
    return B.books_monthly_window(c.books_monthly, c.p)


@query("cogs_by_supplier_account")
def _cbsa(c: Context) -> DataFrame:
    return B.cogs_by_supplier_account(c.cogs)


@query("cogs_by_supplier")
def _cbs(c: Context) -> DataFrame:
    return B.cogs_by_supplier(B.unless_empty(c.cogs, c.p))


@query("cogs_monthly")
def _cm(c: Context) -> DataFrame:
    return B.cogs_monthly(c.cogs, c.p)


@query("cogs_detail")
def _cd(c: Context) -> DataFrame:
    return B.cogs_detail(B.unless_empty(c.cogs, c.p))


@query("yoy_monthly")
def _yoy(c: Context) -> DataFrame:
    return I.yoy_monthly(c.revenue_cube, c.p)


@query("q1_yoy")
def _q1(c: Context) -> DataFrame:
    return I.q1_yoy(c.revenue_cube)


@query("kpi_overview")
def _kpi_overview(c: Context) -> DataFrame:
    return R.kpi_overview(c.filtered_cube)


@query("monthly_trend")
def _trend(c: Context) -> DataFrame:
    return R.monthly_trend(c.filtered_cube)


@query("source_share")
def _share(c: Context) -> DataFrame:
    return R.source_share(c.filtered_cube)


@query("net_month_source")
def _nms(c: Context) -> DataFrame:
    return R.net_month_source(c.filtered_cube)


@query("refunds_month_source")
def _rms(c: Context) -> DataFrame:
    return R.refunds_month_source(c.filtered_cube)


@query("refunds_by_source")
def _rbs(c: Context) -> DataFrame:
    return R.refunds_by_source(c.filtered_cube)


@query("net_reconciliation")
def _recon(c: Context) -> DataFrame:
    return R.net_reconciliation(c.filtered_cube)


@query("kpi_volume")
def _kpi_volume(c: Context) -> DataFrame:
    return I.kpi_volume(c.filtered_cube, c.failures, c.p)


@query("count_month_source")
def _cms(c: Context) -> DataFrame:
    return R.count_month_source(c.filtered_cube)


@query("avg_by_source")
def _abs(c: Context) -> DataFrame:
    return R.avg_by_source(c.filtered_cube)


@query("failures_window")
def _fw(c: Context) -> DataFrame:
    return I.failures_window(c.failures, c.p)


def _metrics_one(c: Context) -> DataFrame:
    return c.statement_metrics.where(F.col("statement_id") == c.p.statement_id)


@query("kpi_pl")
def _kpi_pl(c: Context) -> DataFrame:
    return B.kpi_pl(c.monthly_pl_filtered, c.cogs_filtered, _metrics_one(c))


@query("kpi_cogs")
def _kpi_cogs(c: Context) -> DataFrame:
    cost = S.cost_metrics(c.statements).where(F.col("statement_id") == c.p.statement_id)
    return B.kpi_cogs(c.cogs_filtered, cost)


@query("refund_rates")
def _rates(c: Context) -> DataFrame:
    return I.refund_rates(c.spark, c.ledger, c.p)


@query("refund_rate_chart")
def _rate_chart(c: Context) -> DataFrame:
    return I.refund_rate_chart(I.refund_rates(c.spark, c.ledger, c.p))


@query("kpi_alerts")
def _alerts(c: Context) -> DataFrame:
    rates = I.refund_rates(c.spark, c.ledger, c.p)
    return I.kpi_alerts(c.monthly_pl_filtered, c.cogs_filtered, _metrics_one(c), rates, I.q1_yoy(c.revenue_cube), c.p)


@query("gateway_growth")
def _growth(c: Context) -> DataFrame:
    return I.gateway_growth(c.filtered_cube, c.p)


@query("distinct_status")
def _distinct_status(c: Context) -> DataFrame:
    return L.distinct_status(c.ledger)


# --- 2.6 statements ---------------------------------------------------------------------
@query("statement_metrics")
def _sm(c: Context) -> DataFrame:
    return c.statement_metrics


@query("cost_metrics")
def _cost(c: Context) -> DataFrame:
    return S.cost_metrics(c.statements)


@query("cogs_breakdown")
def _cb(c: Context) -> DataFrame:
    return S.cogs_breakdown(c.statements)


@query("processing_fees")
def _pf(c: Context) -> DataFrame:
    return S.processing_fees(c.statements)


@query("waterfall")
def _wf(c: Context) -> DataFrame:
    return S.waterfall(c.statements)


@query("waterfall_levels")
def _wfl(c: Context) -> DataFrame:
    return S.waterfall_levels(S.waterfall(c.statements))


# --- 2.7 windows --------------------------------------------------------------------------
@query("mom_change")
def _mom(c: Context) -> DataFrame:
    return I.mom_change(c.filtered_cube)


@query("mom_change_by_source")
def _mom_src(c: Context) -> DataFrame:
    return I.mom_change(c.filtered_cube, by_source=True)


@query("rolling3")
def _roll(c: Context) -> DataFrame:
    return I.rolling3(c.filtered_cube)


# --- 2.8 top-k -------------------------------------------------------------------------------
@query("top_vendors")
def _top(c: Context) -> DataFrame:
    return B.top_vendors(c.vendors, c.p.top_vendors)


@query("top_vendors_table")
def _top_t(c: Context) -> DataFrame:
    return B.top_vendors_table(c.vendors, c.p.top_vendors_table)


# --- 2.9 set operations ----------------------------------------------------------------------
@query("ledger_union")
def _union(c: Context) -> DataFrame:
    return c.union


@query("sources_available")
def _avail(c: Context) -> DataFrame:
    return L.sources_available(c.spark, c.ledger, c.p.gateways)


# --- 2.10 text forms ---------------------------------------------------------------------------
@query("fmt_kpis")
def _fmt(c: Context) -> DataFrame:
    k = R.kpi_overview(c.filtered_cube)
    v = I.kpi_volume(c.filtered_cube, c.failures, c.p)
    row = B.combine_rows(k, v)
    return row.select(
        X.fmt_currency("gross").alias("gross_text"),
        X.fmt_currency("refunds").alias("refunds_text"),
        X.fmt_currency("net").alias("net_text"),
        X.fmt_number("total_txn").alias("total_txn_text"),
        X.fmt_number("failed_txn").alias("failed_txn_text"),
        X.fmt_pct("failure_rate").alias("failure_rate_text"),
        X.fmt_currency("avg_value").alias("avg_value_text"),
    )


# --- streaming ingest ------------------------------------------------------------------------
@query("stream_ingest")
def _stream_ingest(c: Context) -> DataFrame:
    """Extract files dropped per gateway -> file-source stream -> normalise -> ledger table."""
    from ..schema import LEDGER
    from ..streaming import ingest as SI

    root = FS.new_path(c.spark, "drop")
    folders = {}
    for source, kind, raw, keep in (
        (CARD, "card", c.card_raw, True),
        (WALLET_A, "wallet", c.wallet_a_raw, False),
        (WALLET_B, "wallet", c.wallet_b_raw, False),
        (CHECKOUT, "checkout", c.checkout_raw, True),
    ):
        folder = f"{root}/{source}"
        FS.write_extract_csv(raw, folder, keep_blanks=keep)
        folders[source] = (kind, folder)
    table = f"{root}/_ledger"
    SI.ingest_folders(c.spark, folders, table, f"{root}/_checkpoint", c.p)
    return FS.read_ledger_cache(c.spark, table, LEDGER)


def _delivered(c: Context, root: str) -> list:
    """The gateways' files as they come: columns in any order, damaged lines, a wallet that never came."""
    from ..sources import catalogue as CAT

    def put(name: str, raw: DataFrame, key: str, keep: bool) -> str:
        return BIND.deliver(raw, f"{root}/{name}", key, keep_blanks=keep, damaged=True)

    odd = F.expr("cast(substr(`Transaction ID`, 3) as bigint) % 2 = 1")
    return [
        CAT.Entry(CARD, "card", put("card_odd", c.card_raw.where(odd), "Transaction ID", True)),
        CAT.Entry(CARD, "card", put("card_even", c.card_raw.where(~odd), "Transaction ID", True)),
        CAT.Entry(WALLET_A, "wallet", put("wallet_a", c.wallet_a_raw, "Transaction ID", False)),
        CAT.Entry(WALLET_B, "wallet", f"{root}/wallet_b"),  # never delivered
        CAT.Entry(CHECKOUT, "checkout", put("checkout", c.checkout_raw, "id", True)),
    ]


@query("load_extracts")
def _load_extracts(c: Context) -> DataFrame:
    """S1-S3 + S7 from files: a catalogue whose second wallet file is absent loads
    the present extracts, whatever their column orders and damaged lines."""
    from ..sources import catalogue as CAT

    ledger, _report = CAT.load_extracts(c.spark, _delivered(c, FS.new_path(c.spark, "extracts")), c.p)
    return ledger


@query("load_extracts_report")
def _load_extracts_report(c: Context) -> DataFrame:
    """Two files of the card gateway, one wallet file that never came, one line per entry."""
    from ..sources import catalogue as CAT

    _ledger, report = CAT.load_extracts(c.spark, _delivered(c, FS.new_path(c.spark, "extracts")), c.p)
    return report.select("source", F.element_at(F.split("path", "/"), -1).alias("file"), "status", "rows")


@query("load_rejects")
def _load_rejects(c: Context) -> DataFrame:
    """S2 + S7: what the load read, and the rejected lines by gateway and reason, with the orders they belong to."""
    from ..sources import catalogue as CAT

    loaded = CAT.load(c.spark, _delivered(c, FS.new_path(c.spark, "extracts")))
    # a short line may have lost the cell with its number
    mark = F.when(F.col("reason") != "short", F.regexp_extract("text", "(?:^|[,\" ])(?:c|wa|wb|k)-([0-9]+)", 1).try_cast("long"))
    bad = loaded.rejects().groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("order_sum"))
    read = loaded.report().groupBy("source").agg(F.sum("read").alias("read"))
    return read.join(bad, "source", "left").select("source", "read", "reason", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "order_sum")
