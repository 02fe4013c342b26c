"""The record reader: headers by file, quoted line breaks, damaged lines, sheets; at every size of a split."""

from __future__ import annotations

import gzip
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from finledger.operators import normalize as N
from finledger.params import DEFAULT
from finledger.plans import registry as RG
from finledger.plans.context import Context
from finledger.sources import bindings as BIND
from finledger.sources import catalogue as CAT
from finledger.sources import files as FS
from finledger.sources import records as R

from .conftest import SF001

ONE = """﻿"id", b ,c
1,x,"two
lines"
2,"q ""z"" w",
3,short
4,a,b,long
5,"stray,c
6,ok,fine
7,5" pipe,y

8,"l1

l3, with, commas
l4",z
9,,""
"a,b",NA,3
10,"never closed,z
11,last,one
"""
TWO = "c,id\r\nC1,20\r\nC2,21\r\n"


@pytest.fixture(params=[1 << 27, 64, 7])
def split(request, spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def put(path, text):
    os.makedirs(path.parent, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def test_records_of_whole_and_damaged_files(spark, tmp_path, split):
    put(tmp_path / "x" / "one.csv", ONE)
    put(tmp_path / "x" / "sub" / "two.csv", TWO)
    read = R.read_extract(spark, str(tmp_path / "x"), ["id", "b", "c"], null_value="NA", defaults={"b": "none"})
    good = {r["id"]: (r["b"], r["c"], r["__line"]) for r in read.where("__why is null").collect()}
    assert good == {
        "1": ("x", "two\nlines", 2), "2": ('q "z" w', "", 4), "6": ("ok", "fine", 8), "7": ('5" pipe', "y", 9),
        "8": ("l1\n\nl3, with, commas\nl4", "z", 11), "9": ("", "", 15), "a,b": (None, "3", 16), "11": ("last", "one", 18),
        "20": ("none", "C1", 2), "21": ("none", "C2", 3)}
    bad = {(r.line_no, r.reason, r.text) for r in R.rejects(read).collect()}
    assert bad == {(5, "short", "3,short"), (6, "long", "4,a,b,long"), (7, "quote", '5,"stray,c'), (17, "quote", '10,"never closed,z')}
    assert R.column_names(spark, str(tmp_path / "x")) == ["id", "b", "c"]


def test_long_open_quotes_are_read_line_by_line(spark, tmp_path):
    lines = ["id,b", '0,"open'] + [f"{i},x" for i in range(1, 300)] + ['300,close"', "301,y"]
    path = put(tmp_path / "f.csv", "\n".join(lines) + "\n")
    read = R.read_extract(spark, path, ["id", "b"], span=20)
    assert {int(r["id"]) for r in R.kept(read).collect()} == set(range(1, 302))  # 300's quote stands inside a plain cell
    assert [(r.line_no, r.reason) for r in R.rejects(read).collect()] == [(2, "quote")]


def test_sheets_keep_row_order_titles_and_line_breaks(spark, tmp_path, split):
    text = 'Report,,\n"Two\nlines",x\n\nIncome,\n"Total for\nSmith, J\nIncome","1,5",note\nNet Income,2.00,"n ""q"""\n'
    for i in range(3):
        put(tmp_path / f"s{i}.csv", text)
    put(tmp_path / "open.csv", 'a,1\n"b,2\nc,3\n')
    rows = R.read_sheets(spark, str(tmp_path), ["label", "value"]).collect()
    of = {}
    for r in sorted(rows, key=lambda r: r.row):
        of.setdefault(r.file.rsplit("/", 1)[1], []).append((r.row, r.label, r.value))
    want = [(1, "Report", None), (2, "Two\nlines", "x"), (4, "Income", None), (5, "Total for\nSmith, J\nIncome", "1,5"), (6, "Net Income", "2.00")]
    assert of["s0.csv"] == of["s1.csv"] == of["s2.csv"] == want
    assert of["open.csv"] == [(1, "a", "1"), (2, '"b', "2"), (3, "c", "3")]
    cut = R.read_sheets(spark, str(tmp_path / "s0.csv"), ["label"], skip=4).collect()
    assert sorted((r.row, r.label) for r in cut) == [(1, "Total for\nSmith, J\nIncome"), (2, "Net Income")]


def test_many_sheets_are_one_scan_and_a_long_one_is_split(spark, tmp_path):
    for i in range(40):
        put(tmp_path / "many" / f"{i:03}.csv", f"Income,{i}\nNet Income,{i + 1}\n")
    inputs, report = CAT.load_inputs(spark, [CAT.Entry("pl", "statement", str(tmp_path / "many"))])
    assert [(r.status, r.rows) for r in report.collect()] == [("loaded", 80)]
    got = sorted(map(tuple, inputs.statements.collect()))
    assert [g[:3] for g in got] == [(i, k + 1, x) for i in range(40) for k, x in enumerate(("Income", "Net Income"))]
    put(tmp_path / "long.csv", "".join(f"line {i},{i}\n" for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        lines = R.scan(spark, str(tmp_path / "long.csv"))
        assert R.blocks(lines).count() > 5
        rows = R.read_sheets(spark, str(tmp_path / "long.csv"), ["label"])
        assert rows.where(F.col("label") != F.concat(F.lit("line "), F.col("row") - 1)).count() == 0 and rows.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_columns_in_any_order_are_bound_by_name(spark):
    raw = Context(spark, SF001).checkout_raw
    path = BIND.deliver(raw, FS.new_path(spark, "order"), "id", keep_blanks=True)
    back = FS.read_extract_csv(spark, path, raw.columns, keep_blanks=True)
    assert back.exceptAll(raw).count() == raw.exceptAll(back).count() == 0


def test_unreadable_missing_and_empty_entries_do_not_stop_a_load(spark, tmp_path):
    good = put(tmp_path / "good" / "a.csv", ",".join(N.CHECKOUT_COLUMNS) + "\nk-1,2000-03-01 10:00,5.00,,0.10,paid,d,usd,n,e\nk-2,2000\n")
    broken = tmp_path / "broken.csv.gz"
    broken.write_bytes(gzip.compress(b"id,Amount\n" + os.urandom(4000).hex().encode())[:900])
    os.makedirs(tmp_path / "none")
    put(tmp_path / "head" / "a.csv", "id,Amount\n")
    entries = [CAT.Entry("checkout", "checkout", p) for p in (
        good, str(broken), str(tmp_path / "no"), str(tmp_path / "none"), str(tmp_path / "head"))]
    load = CAT.load(spark, entries)
    rows = load.report().collect()
    assert [(r.status, r.read, r.rejected, r.rows) for r in rows] == [
        ("loaded", 2, 1, 1), ("unreadable", 0, 0, 0), ("missing", 0, 0, 0), ("empty", 0, 0, 0), ("empty", 0, 0, 0)]
    assert "FAILED_READ_FILE" in rows[1].reason
    assert [(r.entry, r.line_no, r.reason, r.text) for r in load.rejects().collect()] == [(0, 3, "short", "k-2,2000")]
    led, report = CAT.load_extracts(spark, entries, DEFAULT)
    assert [(r.transaction_id, r.date) for r in led.collect()] == [("k-1", date(2000, 3, 1))] and report.count() == 5


def test_rejected_lines_cost_no_good_row(spark):
    ctx = Context(spark, SF001)
    load = CAT.load(spark, RG._delivered(ctx, FS.new_path(spark, "delivered")))
    card = load.raw(0).unionByName(load.raw(1))
    want = ctx.card_raw.select(*N.CARD_COLUMNS)
    assert card.exceptAll(want).count() == want.exceptAll(card).count() == 0
    assert load.rejects().count() > 0
