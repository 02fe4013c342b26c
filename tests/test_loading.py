"""What a load must not lose: dates with text behind them, quotes, line breaks, blanks, files of one gateway, fallbacks."""

from __future__ import annotations

import os
import time
from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from finledger.functions import exprs as X
from finledger.operators import books as B
from finledger.operators import insights as I
from finledger.operators import ledger as L
from finledger.operators import normalize as N
from finledger.params import DEFAULT
from finledger.plans.context import Context
from finledger.sources import catalogue as CAT
from finledger.sources import files as FS
from finledger.streaming import ingest as SI

from .conftest import SF001

CARD_HEADER = ",".join(f'"{c}"' for c in N.CARD_COLUMNS)


def card_line(i, **cells):
    row = {"Transaction ID": f"c-{i}", "Transaction Type": "sale", "Transaction Status": "settled",
           "Created Datetime": "1/5/2000 13:45:00", "Amount Submitted For Settlement": "10.00", "Currency ISO Code": "USD"} | cells
    return ",".join('"' + str(row.get(c, "x")).replace('"', '""') + '"' for c in N.CARD_COLUMNS)


def write(path, *lines):
    os.makedirs(path)
    with open(f"{path}/part.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_dates_keep_their_rows_whatever_follows(spark):
    df = spark.createDataFrame([("1/5/2026 13:45:00",), (" 01/05/2026 PST",), ("5.1.2026",), (None,)], "t string")
    assert [r[0] for r in df.select(X.parse_us_date("t")).collect()] == [date(2026, 1, 5)] * 2 + [None] * 2
    df = spark.createDataFrame([("2026-1-5 10:00",), ("2026/01/05 10:00",), ("2026-01-05T10:00Z",), ("x",)], "t string")
    assert [r[0] for r in df.select(X.parse_iso_date_prefix("t")).collect()] == [date(2026, 1, 5)] * 3 + [None]


def test_quotes_and_line_breaks_inside_cells(spark, tmp_path):
    lines = [CARD_HEADER, card_line(1, **{"Order ID": 'He said "hi", ok'}), card_line(2, **{"Order ID": "two\nlines"})]
    df = FS.read_extract_csv(spark, write(str(tmp_path / "card"), *lines), N.CARD_COLUMNS, keep_blanks=True)
    out = {r.transaction_id: r for r in N.normalize_card(df).collect()}
    assert out["c-1"].description == 'He said "hi", ok' and out["c-2"].description == "two\nlines"
    assert {r.date for r in out.values()} == {date(2000, 1, 5)} and len(out) == 2


def test_extract_round_trip_of_odd_cells(spark):
    df = spark.createDataFrame([('a "b", c', "x\ny"), ("", None)], "p string, q string")
    path = FS.write_extract_csv(df, FS.new_path(spark, "odd"), keep_blanks=True)
    back = FS.read_extract_csv(spark, path, ["p", "q"], keep_blanks=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_wallet_cells_are_trimmed_and_na_is_null(spark):
    cols = list(N.WALLET_DEFAULTS)
    row = {"Status": " completed ", "Type": "NA", "Date": "1/5/2000 x", "Gross": "$1.00", "Transaction ID": "w-1"}
    df = spark.createDataFrame([tuple(row.get(c, "") for c in cols)], ", ".join(f"`{c}` string" for c in cols))
    r = N.normalize_wallet(df, "wallet_a").first()
    assert r.status == "completed" and r.type is None and r.date == date(2000, 1, 5)


def test_card_row_without_type_is_neither_sale_nor_refund(spark):
    cells = {c: "x" for c in N.CARD_COLUMNS} | {"Transaction Type": None, "Transaction Status": "settled",
                                                "Created Datetime": "01/05/2000", "Amount Submitted For Settlement": "5", "Currency ISO Code": "USD"}
    df = spark.createDataFrame([tuple(cells[c] for c in N.CARD_COLUMNS)], ", ".join(f"`{c}` string" for c in N.CARD_COLUMNS))
    led = N.normalize_card(df)
    assert led.first().is_refund is None
    assert led.where(X.is_sale()).count() == 0 and led.where(X.is_refund()).count() == 0


def test_two_files_of_one_gateway_missing_and_empty(spark, tmp_path):
    a = write(str(tmp_path / "a"), CARD_HEADER, card_line(1))
    b = write(str(tmp_path / "b"), CARD_HEADER, card_line(2), card_line(3))
    os.makedirs(tmp_path / "none")
    entries = [CAT.Entry("card", "card", a), CAT.Entry("card", "card", b), CAT.Entry("card", "card", str(tmp_path / "no")),
               CAT.Entry("card", "card", str(tmp_path / "none"))]
    led, report = CAT.load_extracts(spark, entries, DEFAULT)
    assert led.count() == 3
    assert [(r.status, r.rows) for r in report.orderBy("path").collect()] == [("loaded", 1), ("loaded", 2), ("missing", 0), ("empty", 0)]


def test_unreadable_cache_is_an_error_and_stays(spark, tmp_path):
    path = tmp_path / "cache"
    os.makedirs(path)
    (path / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|CANNOT_READ|FAILED_READ"):
        FS.load_or_build(spark, str(path), lambda: pytest.fail("built over an unreadable cache")).count()
    assert (path / "part-0.parquet").read_bytes() == b"not parquet"


def test_missing_path_still_raises_outside_the_catalogue(spark, tmp_path):
    with pytest.raises(AnalysisException):
        FS.read_extract_csv(spark, str(tmp_path / "nothing"), keep_blanks=True).count()


def test_fifth_gateway_shows_up(spark):
    p = DEFAULT.with_(gateways=(*DEFAULT.gateways, "checkout_eu"), sources=(*DEFAULT.gateways, "checkout_eu"))
    led = Context(spark, SF001).ledger
    more = led.unionByName(led.where("source = 'checkout'").withColumn("source", F.lit("checkout_eu")))
    assert "checkout_eu" in {r.source for r in L.sources_available(spark, more, p.gateways).collect()}
    rates = I.refund_rates(spark, more, p)
    assert "checkout_eu" in {r.source for r in rates.collect()}
    chart = [r.rate for r in I.refund_rate_chart(rates).collect()]
    assert chart and chart == sorted(chart, reverse=True)


def test_fallbacks_take_all_rows_and_run_no_job_while_the_plan_is_built(spark):
    ctx = Context(spark, SF001, DEFAULT.with_(date_from=date(1990, 1, 1), date_to=date(1990, 12, 31)))
    inputs = (ctx.cogs, ctx.revenue_cube, ctx.books_monthly)  # their files' schemas are read here
    assert len(inputs) == 3
    spark.sparkContext.setJobGroup("plan-building", "")
    monthly, yoy = B.cogs_monthly(ctx.cogs, ctx.p), I.yoy_monthly(ctx.revenue_cube, ctx.p)
    detail, months = B.cogs_detail(B.unless_empty(ctx.cogs, ctx.p)), B.books_monthly_window(ctx.books_monthly, ctx.p)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan-building")
    full = ctx.cogs.groupBy("month", "account_clean").agg(F.sum("amount").alias("total"))
    assert sorted(map(str, monthly.collect())) == sorted(map(str, full.collect()))
    assert yoy.count() > 0 and detail.count() == ctx.cogs.count() and months.count() == ctx.books_monthly.count()
    some = Context(spark, SF001)
    assert B.unless_empty(some.cogs, some.p).count() == some.cogs_filtered.count() < some.cogs.count()
    assert B.cogs_monthly(some.cogs, some.p).agg(F.sum("total")).first()[0] == some.cogs_filtered.agg(F.sum("amount")).first()[0]


def test_late_file_with_an_old_time_stamp_is_ingested(spark, tmp_path):
    drop = tmp_path / "drop"
    write(str(drop / "one"), CARD_HEADER, card_line(1))
    args = ({"card": ("card", f"{drop}/*")}, str(tmp_path / "table"), str(tmp_path / "ck"), DEFAULT)
    SI.ingest_folders(spark, *args)
    write(str(drop / "two"), CARD_HEADER, card_line(2))
    old = time.time() - 30 * 86400
    os.utime(drop / "two" / "part.csv", (old, old))
    SI.ingest_folders(spark, *args)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def first_statement(ctx):
    return ctx.statements.agg(F.min("statement_id")).first()[0]


def user_files(spark, tmp_path):
    """The test tables written out as a user's extracts and sheets; wallet_b never came."""
    ctx = Context(spark, SF001)
    at = lambda name: f"{tmp_path}/{name}"
    FS.write_extract_csv(ctx.card_raw, at("card"), keep_blanks=True)
    FS.write_extract_csv(ctx.wallet_a_raw, at("wallet_a"), keep_blanks=False)
    FS.write_extract_csv(ctx.checkout_raw, at("checkout"), keep_blanks=True)
    FS.write_extract_csv(ctx.checkout_raw, at("checkout_eu"), keep_blanks=True)
    books = ctx.books_sheet.drop("entity")
    title = spark.createDataFrame([("Transaction List", *[""] * 8), ("Date", *["x"] * 8)], books.schema)
    title.unionByName(books).coalesce(1).write.option("escape", '"').csv(at("books"))
    one = ctx.statements.where(F.col("statement_id") == first_statement(ctx)).orderBy("line_no").select("label", F.col("value").cast("string"))
    one.coalesce(1).write.option("escape", '"').csv(at("statement"))
    ctx.vendor_sheet.write.option("escape", '"').csv(at("vendors"))
    entries = [CAT.Entry(n, k, at(n)) for n, k in (
        ("card", "card"), ("wallet_a", "wallet"), ("wallet_b", "wallet"), ("checkout", "checkout"), ("checkout_eu", "checkout"),
        ("books", "books"), ("statement", "statement"), ("vendors", "vendors"))]
    return ctx, entries


def test_context_from_a_users_files(spark, tmp_path):
    from finledger.plans import registry as RG

    bound, entries = user_files(spark, tmp_path)
    names = ("card", "wallet_a", "wallet_b", "checkout", "checkout_eu")
    ctx, report = Context.from_catalogue(spark, entries, DEFAULT.with_(gateways=names, sources=names))
    status = {r.source: r.status for r in report.collect()}
    assert status.pop("wallet_b") == "missing" and set(status.values()) == {"loaded"}
    by = {r.source: r["count"] for r in ctx.ledger.groupBy("source").count().collect()}
    want = {r.source: r["count"] for r in bound.ledger.groupBy("source").count().collect()}
    assert by["checkout_eu"] == by["checkout"] == want["checkout"] and by["card"] == want["card"]
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(ctx.books_monthly, bound.books_monthly) and same(ctx.failures, bound.failures) and same(ctx.vendors, bound.vendors)
    first = bound.statement_metrics.where(F.col("statement_id") == first_statement(bound)).drop("statement_id")
    assert same(ctx.statement_metrics.drop("statement_id"), first) and first.count() == 1
    assert {r.source: r.rows for r in report.collect()}["card"] == bound.norm_parts[0].count()
    assert "checkout_eu" in {r.source for r in RG.run(spark, "", "refund_rates", ctx=ctx).collect()}
    assert RG.run(spark, "", "monthly_pl", ctx=ctx).count() > 0


def test_absent_books_and_sheets(spark, tmp_path):
    from finledger.plans import registry as RG

    _, entries = user_files(spark, tmp_path)
    ctx, _ = Context.from_catalogue(spark, [e for e in entries if e.kind in ("card", "checkout")])
    rows = RG.run(spark, "", "monthly_pl", ctx=ctx).collect()
    assert rows and all(r.total_expenses is None and r.net_income is None for r in rows)
    assert ctx.books.count() == ctx.vendors.count() == ctx.statements.count() == 0
    none, report = Context.from_catalogue(spark, [])
    assert none.ledger.count() == 0 and report.count() == 0


def test_pages_after_the_last_row_equal_pages_by_offset(spark):
    from finledger.operators import explore as E

    ctx = Context(spark, SF001)
    table = E.explore_filtered(ctx.filtered, ctx.p)
    how = {"order_by": [("amount", True)], "limit": 20, "tie_break": "txn_id"}
    last = None
    for page in range(4):
        by_offset = E.explore(table, offset=20 * page, **how).collect()
        rows = E.explore(table, after=last, **how).collect()
        assert rows == by_offset and len(rows) == 20
        last = (rows[-1].amount, rows[-1].txn_id)
    plan = E.explore(table, after=last, **how)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=20" in plan
