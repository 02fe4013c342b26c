"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

The key columns are hashed to 64 bits; the jump walk turns that key and a shard
count into a shard without any ring table.  Growing from n to n + 1 shards moves
exactly the keys whose walk visits n, all of them into shard n.

Law: ``key``.  Defined results: a null key is a key like any other (all null
keys share a shard); a null text counts as empty (size 1, crc 0); rows with the
same key share a shard; identical rows get consecutive slots; an empty table
gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

# fixed values of the published generator: key = key * 2862933555777941757 + 1 (mod 2^64)
MULTIPLIER = 2862933555777941757
_M_HI, _M_LO = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW32, _LOW16 = 0xFFFFFFFF, 0xFFFF
MAX_STEPS = 256  # the walk takes about ln(n) steps; beyond 256 it stops with an error


def _low32_product(a: Column, m: int) -> Column:
    """(a * m) mod 2^32 for a < 2^32 without leaving the signed 64-bit range."""
    return (a * F.lit(m & 0xFFFF) + F.shiftleft((a * F.lit(m >> 16)).bitwiseAND(_LOW16), 16)).bitwiseAND(_LOW32)


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One generator step on a 64-bit state held as two unsigned 32-bit halves."""
    p0, p1 = lo * F.lit(_M_LO & 0xFFFF), lo * F.lit(_M_LO >> 16)
    low = p0.bitwiseAND(_LOW32) + F.shiftleft(p1.bitwiseAND(_LOW16), 16) + F.lit(1)
    high = (F.shiftright(low, 32) + F.shiftright(p0, 32) + F.shiftright(p1, 16)
            + _low32_product(hi, _M_LO) + _low32_product(lo, _M_HI))
    return high.bitwiseAND(_LOW32), low.bitwiseAND(_LOW32)


def jump_hash(key: Column, n_shards: int) -> Column:
    """struct<shard, grown>: the shard of a 64-bit key among n and among n + 1 shards.

    The walk for n + 1 visits strictly growing shards, so the last one it visits
    below n is the shard for n.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    n1 = F.lit(n_shards + 1).cast("long")
    start = F.struct(
        F.lit(0).cast("long").alias("prev"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_LOW32).alias("lo"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        ratio = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")
        moved = F.struct(
            F.when(s["b"] >= 0, s["b"]).otherwise(F.lit(0).cast("long")).alias("prev"), s["j"].alias("b"),
            F.least(F.floor((s["j"] + F.lit(1)).cast("double") * ratio), n1).cast("long").alias("j"),
            hi.alias("hi"), lo.alias("lo"),
        )
        return F.when(s["j"] < n1, moved).otherwise(s)

    def finish(s: Column) -> Column:
        done = F.struct(
            F.when(s["b"] >= F.lit(n_shards), s["prev"]).otherwise(s["b"]).cast("int").alias("shard"),
            s["b"].cast("int").alias("grown"),
        )
        return F.when(s["j"] >= n1, done).otherwise(F.raise_error(F.lit("jump walk too long")).cast(
            "struct<shard:int,grown:int>"))

    steps = F.sequence(F.lit(1), F.lit(min(n_shards + 1, MAX_STEPS)))
    return F.aggregate(steps, start, step, finish)


def shard_rows(df: DataFrame, keys: list[str], n_shards: int, text: str = "text",
               slot_buckets: int = 1024, copies_step: int = 65536) -> DataFrame:
    """One row per input row: keys, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers a shard's rows from 0 without gaps.  No task sees a whole
    shard: rows are dealt to ``slot_buckets`` hash buckets of each shard, the
    bucket totals (at most (n_shards + 1) * slot_buckets rows) give each bucket
    its first slot, and a window numbers the rows inside a bucket.  Identical rows are
    counted before the shuffle and spread again afterwards, so a row repeated
    any number of times costs one row.  Texts never leave the scan.
    """
    body = text_or_empty(text)
    hashed = F.xxhash64(*keys)
    rows = df.select(
        *keys, (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        hashed.alias("__key"),
    )
    rows = rows.withColumn("__walk", jump_hash(F.col("__key"), n_shards))
    rows = rows.select(
        *keys, "size", "text_crc32", F.col("__walk.shard").alias("shard"), F.col("__walk.grown").alias("grown_shard"),
        F.pmod(F.xxhash64(F.col("__key"), "size", "text_crc32"), F.lit(slot_buckets)).alias("__bucket"),
    )
    counted = rows.groupBy("shard", "__bucket", "grown_shard", *keys, "size", "text_crc32").agg(
        F.count(F.lit(1)).alias("__copies"))
    totals = counted.groupBy("shard", "__bucket").agg(F.sum("__copies").alias("__total"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(
        "shard", "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("shard", "__bucket").orderBy(*keys, "size", "text_crc32").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = counted.withColumn("__at", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
    # bounded by the number of shards times slot_buckets, whatever the input
    placed = placed.join(F.broadcast(firsts), ["shard", "__bucket"])
    # copies in two levels, so that no row ever holds an array of unbounded length
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(copies_step).cast("long")))
    placed = placed.withColumn("__part", part)
    last = F.least(F.col("__part") + copies_step, F.col("__copies")) - 1
    placed = placed.withColumn("__copy", F.explode(F.sequence(F.col("__part"), last)))
    return placed.select(
        *keys, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__first") + F.col("__at") + F.col("__copy")).cast("long").alias("slot"), "grown_shard",
    )
