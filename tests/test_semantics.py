"""Unit tests on tiny literal tables: one per null/rounding rule
and per reference quirk (§2.12), hand-computed."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from finledger.functions import exprs as X
from finledger.operators import books as B
from finledger.operators import ledger as L
from finledger.operators import normalize as N
from finledger.operators import revenue as R
from finledger.operators import statements as S
from finledger.params import DEFAULT
from finledger.schema import LEDGER, STATEMENT, empty


def _ledger_rows(spark, rows):
    """rows: (id, date, amount, status, type, source, currency, is_refund, impact, fee)"""
    base = []
    for r in rows:
        tid, d, amt, st, ty, src, cur, ref, imp, fee = r
        base.append((tid, d, None if amt is None else Decimal(amt), None if fee is None else Decimal(fee),
                     None, st, ty, src, None, cur, None, None, ref, imp))
    df = spark.createDataFrame(base, "transaction_id string, date date, amount decimal(18,2), fee decimal(18,2), "
                               "net_amount decimal(18,2), status string, type string, source string, description string, "
                               "currency string, customer_name string, customer_email string, is_refund boolean, "
                               "balance_impact string")
    return L.with_calendar(df)


def test_clean_amount(spark):
    df = spark.createDataFrame([("$1,234.50",), (" -12.00 ",), ("$ 3",), ("abc",), (None,)], "t string")
    got = [r[0] for r in df.select(X.clean_amount("t")).collect()]
    assert got == [Decimal("1234.50"), Decimal("-12.00"), Decimal("3.00"), None, None]


def test_us_date_takes_unpadded_and_prefix(spark):
    df = spark.createDataFrame([("1/5/2026",), ("01/05/2026 13:45:00",), ("2026-01-05",), ("",)], "t string")
    got = [r[0] for r in df.select(X.parse_us_date_prefix("t")).collect()]
    assert got == [date(2026, 1, 5), date(2026, 1, 5), None, None]


def test_revenue_predicate_null_rules(spark):
    led = _ledger_rows(spark, [
        ("a", date(2000, 3, 1), "10", "completed", None, "wallet_a", "usd", False, None, None),   # null type, null impact: kept
        ("b", date(2000, 3, 1), "10", "completed", "Website Payment", "wallet_a", None, False, "credit", None),  # null currency: out
        ("c", date(2000, 3, 1), "10", "completed", "General Currency Conversion", "wallet_a", "USD", False, "credit", None),
        ("d", date(2000, 3, 1), "10", "settled", "sale", "card", "", False, "credit", None),      # blank currency: kept
        ("e", date(2000, 3, 1), "10", "settled", "credit", "card", "usd", True, "debit", None),  # card refund: out
        ("f", date(2000, 3, 1), "10", "pending", "sale", "card", "usd", False, "credit", None),  # status: out
    ])
    ids = sorted(r[0] for r in L.revenue(led).select("transaction_id").collect())
    assert ids == ["a", "d"]


def test_sum_over_no_rows_is_zero(spark):
    led = empty(spark, LEDGER)
    row = R.kpi_overview(R.daily_cube(led)).collect()[0]
    assert (row.gross, row.refunds, row.net) == (0.0, 0.0, 0.0)


def test_monthly_revenue_net_rule(spark):
    led = _ledger_rows(spark, [
        ("a", date(2000, 3, 1), "100", "completed", "x", "w", "usd", False, "credit", None),
        ("b", date(2000, 3, 2), "-5", "completed", "x", "w", "usd", False, None, None),    # negative sale: max(a,0)=0
        ("c", date(2000, 3, 3), "-30", "completed", "Payment Refund", "w", "usd", True, None, None),
    ])
    r = R.monthly_revenue(R.daily_cube(led)).collect()[0]
    assert (r.gross, r.refunds, r.net, r.tx_count) == (100.0, 30.0, 70.0, 3)


def test_full_name_skips_blank_parts(spark):
    df = spark.createDataFrame([("", "Smith"), (None, "Lee"), ("Ann", "Ho")], "a string, b string")
    assert [r[0] for r in df.select(X.full_name("a", "b")).collect()] == ["Smith", "Lee", "Ann Ho"]


def test_round_is_half_up_and_money_text(spark):
    df = spark.createDataFrame([(Decimal("-1234.5"),), (Decimal("2.25"),), (None,)], "v decimal(18,2)")
    got = df.select(X.fmt_money2("v"), F.round("v", 1)).collect()
    assert [g[0] for g in got] == ["-$1,234.50", "$2.25", ""]
    assert got[1][1] == Decimal("2.3")


def test_fmt_currency_and_pct(spark):
    df = spark.createDataFrame([(1234.5,), (-2.5,), (None,)], "v double")
    got = [r[0] for r in df.select(X.fmt_currency("v")).collect()]
    assert got == ["$1,234", "-$2", "N/A"]  # half-even like R
    assert [r[0] for r in df.select(X.fmt_pct("v", signed=True)).collect()] == ["+1234.5%", "-2.5%", "N/A"]
    whole = spark.createDataFrame([(60.0,), (0.0,), (100.5,)], "v double")
    assert [r[0] for r in whole.select(X.fmt_pct("v")).collect()] == ["60%", "0%", "100.5%"]


def test_default_columns_when_absent(spark):
    raw = spark.createDataFrame([("1/2/2000", "$5.00", "Website Payment")], "Date string, Gross string, Type string")
    r = N.normalize_wallet(raw, "wallet_a").collect()[0]
    assert (r.fee, r.net_amount, r.status, r.currency, r.balance_impact) == (Decimal("0.00"), Decimal("0.00"), "unknown", "USD", "credit")
    assert r.is_refund is False


def test_wallet_header_bom_and_quotes(spark):
    raw = spark.createDataFrame([("1/2/2000", "5")], ['﻿"Date"', ' Gross '])
    r = N.normalize_wallet(raw, "wallet_b").collect()[0]
    assert r.date == date(2000, 1, 2) and r.amount == Decimal("5.00")


def test_checkout_partial_refund_counts_full_amount(spark):
    raw = spark.createDataFrame(
        [("k-1", "2000-03-04 10:00", "100.00", "40.00", "3.20", "Paid", "d", "usd", "n", "e")],
        "id string, `Created date (UTC)` string, Amount string, `Amount Refunded` string, Fee string, "
        "Status string, Description string, Currency string, `Customer Description` string, `Customer Email` string",
    )
    r = N.normalize_checkout(raw).collect()[0]
    assert r.is_refund and r.type == "refund" and r.amount == Decimal("100.00")
    assert r.net_amount == Decimal("56.80") and r.currency == "USD" and r.status == "paid"


def test_first_match_returns_null_winner(spark):
    st = spark.createDataFrame(
        [(1, 1, "Income", None), (1, 2, "Total for Income", Decimal("10")), (1, 3, "Net Income", Decimal("4"))],
        STATEMENT,
    )
    m = st.groupBy("statement_id").agg(S._first_match("(?i)income").alias("v"), S._first_match("(?i)income", non_null=True).alias("w"))
    r = m.collect()[0]
    assert r.v is None and r.w == Decimal("10.00")
    sm = S.statement_metrics(st).collect()[0]
    assert sm.gross_revenue == Decimal("10.00") and sm.net_income == Decimal("4.00") and sm.cogs is None


def test_rolling_mean_needs_three_rows(spark):
    from finledger.operators import insights as I

    led = _ledger_rows(spark, [
        (str(i), date(2000, m, 1), str(10 * m), "completed", "x", "w", "usd", False, "credit", None) for i, m in enumerate([1, 2, 3, 4])
    ])
    rows = sorted(I.rolling3(R.daily_cube(led)).collect())
    assert [r.roll3 for r in rows] == [None, None, 20.0, 30.0]
    mom = sorted(I.mom_change(R.daily_cube(led)).collect())
    assert [r.mom_pct for r in mom] == [100.0, 50.0, 33.3]


def test_vendor_flattener_keeps_totals_only(spark):
    sheet = spark.createDataFrame(
        [("Acme", None), ("Total for Acme", "12.50"), ("Total for Zero", "0"), ("Total for Bad", "x"), (None, "3")],
        "_c0 string, _c9 string",
    )
    got = sorted((r.vendor, r.amount) for r in B.vendor_totals(sheet).collect())
    assert got == [("Acme", Decimal("12.50"))]


def test_month_window_drops_partial_first_month(spark):
    df = spark.createDataFrame([(date(2000, 2, 1),), (date(2000, 3, 1),)], "month date")
    p = DEFAULT.with_(date_from=date(2000, 2, 15))
    assert [r[0] for r in L.month_window(df, p).collect()] == [date(2000, 3, 1)]


def test_combine_rows_without_cross_join(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([], "y int")
    out = B.combine_rows(a, b)
    assert out.collect()[0].asDict() == {"x": 1, "y": None}
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty_window_falls_back_to_whole_table(spark):
    from finledger.plans.context import Context
    from finledger.plans import registry as RG

    from .conftest import SF001

    sid = Context(spark, SF001).statement_metrics.orderBy("statement_id").first().statement_id
    far = DEFAULT.with_(date_from=date(1990, 1, 1), date_to=date(1990, 12, 31), statement_id=sid)
    whole = RG.run(spark, SF001, "cogs_by_supplier").count()
    assert whole > 0
    ctx = Context(spark, SF001, far)
    assert RG.finish(RG.QUERIES["cogs_by_supplier"](ctx)).count() == whole
    assert RG.finish(RG.QUERIES["books_monthly_window"](ctx)).count() == ctx.books_monthly.count()
    # KPI fallbacks to the statement when the window holds no month
    k = RG.finish(RG.QUERIES["kpi_pl"](ctx)).collect()[0]
    st = ctx.statement_metrics.where(f"statement_id = {far.statement_id}").collect()[0]
    assert k.revenue == float(st.gross_revenue) and k.net_income == float(st.net_income)
    assert k.cogs == abs(float(st.cogs)) and k.profit == 0.0


def test_money_text_round_trip_property(spark):
    """Any amount written as wallet money text (sign, optional '$'/'$ ',
    thousands separators) parses back to the same decimal."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    amounts = st.decimals(min_value=Decimal("-99999999.99"), max_value=Decimal("99999999.99"), places=2,
                          allow_nan=False, allow_infinity=False)

    @settings(max_examples=1, deadline=None)
    @given(st.lists(amounts, min_size=50, max_size=200))
    def check(values):
        rows = [(v, i) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "v decimal(18,2), k long")
        from finledger.sources.bindings import _money_text

        out = df.select("v", X.clean_amount(_money_text(F.col("v"), F.col("k"))).alias("back")).collect()
        assert all(r.v == r.back for r in out)

    check()


def test_refunds_from_ledger_counts_card_refunds(spark):
    led = _ledger_rows(spark, [
        ("s", date(2000, 3, 1), "100", "settled", "sale", "card", "usd", False, "credit", None),
        ("r", date(2000, 3, 2), "40", "settled", "credit", "card", "usd", True, "debit", None),
        ("d", date(2000, 3, 3), "-5", "completed", "x", "wallet_a", "usd", False, "debit", None),
    ])
    default = R.kpi_overview(R.daily_cube(L.revenue(led))).collect()[0]
    assert (default.gross, default.refunds) == (100.0, 0.0)  # card refunds never reach V
    wide = R.kpi_overview(R.daily_cube(L.revenue(led, refunds_from="ledger"))).collect()[0]
    assert (wide.gross, wide.refunds, wide.net) == (100.0, 40.0, 60.0)
    # a non-refund debit row stays out either way
    assert sorted(r[0] for r in L.revenue(led, refunds_from="ledger").select("transaction_id").collect()) == ["r", "s"]


def test_derive_rebuilds_what_a_parameter_changes(spark):
    from finledger.plans.context import Context

    from .conftest import SF001

    base = Context(spark, SF001)
    _ = base.ledger, base.revenue, base.revenue_cube, base.monthly_pl, base.books
    d = base.derive(sources=("card",))
    assert d.ledger is base.ledger and d.revenue_cube is base.revenue_cube and d.books is base.books
    w = base.derive(refunds_from="ledger")
    assert w.ledger is base.ledger and w.revenue is not base.revenue and w.revenue_cube is not base.revenue_cube
    assert w.revenue.count() >= base.revenue.count()
    f = base.derive(fiscal_from=date(2001, 1, 1))
    assert f.ledger is not base.ledger


def test_cache_is_preferred_when_present(spark):
    """S6 policy: an existing cache wins over a rebuild (no staleness check)."""
    from finledger.schema import LEDGER_BASE
    from finledger.sources import files as FS

    led = _ledger_rows(spark, [("a", date(2000, 3, 1), "10", "completed", "x", "w", "usd", False, "credit", None)])
    path = FS.new_path(spark, "cache-test")
    first = FS.load_or_build(spark, path, lambda: led)
    assert first.count() == 1
    other = _ledger_rows(spark, [("b", date(2000, 4, 1), "5", "completed", "x", "w", "usd", False, "credit", None)] * 3)
    again = FS.load_or_build(spark, path, lambda: other)  # cache present: not rebuilt
    assert [r.transaction_id for r in again.collect()] == ["a"]
    rebuilt = FS.load_or_build(spark, FS.new_path(spark, "cache-test"), lambda: other, prefer_cache=True)
    assert rebuilt.count() == 3 and set(rebuilt.columns) >= {f.name for f in LEDGER_BASE.fields}


def test_explore_search_sort_and_page(spark):
    from finledger.operators import explore as EX

    df = spark.createDataFrame(
        [(i, f"name{i}", "paid" if i % 2 else "failed", float(i)) for i in range(10)], "id int, name string, status string, v double"
    )
    page = EX.explore(df, contains={"status": "PAI"}, search="name", ranges={"v": (2, None)},
                      order_by=[("v", True)], limit=2, offset=1, tie_break="id")
    assert [r.id for r in page.collect()] == [7, 5]
