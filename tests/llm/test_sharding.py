from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from finledger.llm import queries as Q
from finledger.llm import sharding as S
from tests.conftest import SF001


def jump(key: int, n: int) -> int:
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * S.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_walk_equals_the_published_loop(spark):
    ks = [0, 1, -1, 42, 2**63 - 1, -(2**63), 123456789123, -987654321] + list(range(1000, 1100))
    df = spark.createDataFrame([(k,) for k in ks], "k long")
    for n in (1, 2, 8, 100, 1000):
        out = df.select("k", S.jump_hash(F.col("k"), n).alias("w")).collect()
        assert all(r.w.shard == jump(r.k, n) and r.w.grown == jump(r.k, n + 1) for r in out)


def test_query_law_slots_and_crc(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = Q.op10_jump_sharding(spark, SF001).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        b = texts[r.doc_id].encode()
        assert r["size"] == len(b) + 1 and r.text_crc32 == zlib.crc32(b) and r.law == "key"
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(None, None, 1), (None, "", 1), (5, "x", 2), (5, "x", 2), (5, "x", 3), (7, "é" * 50000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = S.shard_rows(df, ["doc_id"], 3, copies_step=2).collect()
    assert len(out) == 6
    assert len({(r.shard, r.slot) for r in out}) == 6
    assert {r["size"] for r in out if r.doc_id is None} == {1}
    assert len({r.shard for r in out if r.doc_id == 5}) == 1
    assert [r["size"] for r in out if r.doc_id == 7] == [100001]
    assert S.shard_rows(df.limit(0), ["doc_id"], 3).count() == 0
