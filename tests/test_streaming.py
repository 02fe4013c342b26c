"""Incremental ingest: files dropped later are picked up once, never twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from finledger.params import CARD, WALLET_A
from finledger.plans.context import Context
from finledger.schema import LEDGER
from finledger.sources import files as FS
from finledger.streaming import ingest as SI

from .conftest import SF001


def test_ingest_is_incremental_and_exactly_once(spark):
    ctx = Context(spark, SF001)
    root = FS.new_path(spark, "stream-test")
    card, wallet = f"{root}/card", f"{root}/wallet"
    # first delivery: even order keys of each extract
    first_card = ctx.card_raw.where(F.expr("cast(substr(`Transaction ID`, 3) as bigint) % 2 = 0"))
    first_wallet = ctx.wallet_a_raw.where(F.expr("cast(substr(`Transaction ID`, 4) as bigint) % 2 = 0"))
    FS.write_extract_csv(first_card, f"{card}/batch1", keep_blanks=True)
    FS.write_extract_csv(first_wallet, f"{wallet}/batch1", keep_blanks=False)
    folders = {CARD: ("card", f"{card}/*"), WALLET_A: ("wallet", f"{wallet}/*")}
    table, ck = f"{root}/_ledger", f"{root}/_checkpoint"
    SI.ingest_folders(spark, folders, table, ck, ctx.p)
    n1 = FS.read_ledger_cache(spark, table, LEDGER).count()
    # second delivery: the odd keys; a rerun must add only these
    FS.write_extract_csv(ctx.card_raw.exceptAll(first_card), f"{card}/batch2", keep_blanks=True)
    FS.write_extract_csv(ctx.wallet_a_raw.exceptAll(first_wallet), f"{wallet}/batch2", keep_blanks=False)
    SI.ingest_folders(spark, folders, table, ck, ctx.p)
    # and a rerun with nothing new adds nothing
    SI.ingest_folders(spark, folders, table, ck, ctx.p)
    got = FS.read_ledger_cache(spark, table, LEDGER)
    want = ctx.ledger.where(F.col("source").isin(CARD, WALLET_A))
    assert 0 < n1 < got.count()
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
