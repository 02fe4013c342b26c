"""Mixing sources to target weights by Pareto order sampling (Rosen, 1997), in DataFrame functions only.

A source's target is its weight's share of a budget, stopped at ``most`` times
the source's words; what a stopped source cannot take goes to the others by
weight.  A document of a source with rate r = target / words is expected r times:
floor(r) whole copies are certain, and the fraction p = r - floor(r) is its
inclusion probability in a sample of fixed size.  The sample ranks documents by
random odds divided by inclusion odds,

    q = (u / (1 - u)) / (p / (1 - p)),   u a keyed hash of the document,

and takes the smallest.  Its size is fixed in words, not in documents, as the
target is: documents enter in rank order until the target's words are used, and
the last one enters with its first words only.  So every source meets its target
to a word, whatever the sizes of its documents.

Ranks never need a sort of a source: q / (1 + q) falls into ``steps`` equal bins
for each source; the bins' words tell the one bin in which the sample ends, bins
before it enter whole, and only that bin's rows are ranked one by one.  Texts never
leave the scan, and rows equal in key, source and size are counted before the
shuffle, so a row repeated any number of times costs one row.

Defined results: a null or empty text has size 0 and takes 0 words; a null source
is a source, the last one; a source without words has target 0; a null key is a
key like any other; of equal rows the first ones enter; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: words: runs of anything but blank and the controls from tab to carriage return
WORD = r"[^\x20\x09-\x0D]+"
U_BITS = 52


def targets(sizes: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """``sizes`` (source, source_size) with target: shares of ``percent`` % of all words by weight.

    Sorted by the share at which they stop (most * size / weight), sources stop
    one after the other; the level c at which the rest divide what is left is the
    first that lies below the next stop.  One row per source reaches these windows.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("w", F.element_at(cycle, (place % len(weights) + 1).cast("int")).cast("long"))
    order = [F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    # left to divide, in hundredths of words: exact integers
    rows = rows.withColumn("left", F.sum("source_size").over(every) * percent
                           - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * (100 * most))
    rows = rows.withColumn("of", F.sum("w").over(after)).withColumn(
        "goes", F.col("left") * F.col("w") <= F.col("source_size") * F.lit(100 * most) * F.col("of"))
    # the first that is not stopped fixes the level for all from there on
    first = F.min_by(F.struct("left", "of"), F.when(F.col("goes"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(
        (F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source")))]))).over(every)
    rows = rows.withColumn("level", first)
    share = (F.col("level.left") * F.col("w")).cast("double") / (F.col("level.of") * 100).cast("double")
    cap = (F.col("source_size") * most).cast("double")
    return rows.select("source", "source_size", F.least(cap, F.coalesce(share, cap)).alias("target"))


def uniform(seed: str, *cols: Column) -> Column:
    """A number strictly between 0 and 1 from a keyed hash of the columns."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in cols])
    bits = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, U_BITS // 4), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << U_BITS))


def pareto(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds; null where nothing or everything is included."""
    return F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))


def copies(df: DataFrame, n: str, step: int) -> DataFrame:
    """Each row ``n`` times with ``__copy`` from 0; in two levels, so that no row ever holds an array of unbounded length."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(step).cast("long")))
    df = df.withColumn("__part", part)
    return df.withColumn("__copy", F.explode(F.sequence(F.col("__part"), F.least(F.col("__part") + step, F.col(n)) - 1)))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2, key: str = "doc_id",
        source: str = "source", text: str = "text", seed: str = "finledger", steps: int = 4096,
        copies_step: int = 65536) -> DataFrame:
    """One row per document: key, size, source_size, target (its source's), taken (words, repeats counted)."""
    if percent < 0 or percent > 100 * most:
        raise ValueError("the sources cannot take that many words")
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"))
    rows = staged(spark, rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("c")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"))
    plan = targets(sizes, weights, percent, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")
    plan = plan.withColumn("whole", whole).withColumn("p", F.when(F.col("source_size") > 0, rest / F.col("source_size")))
    plan = staged(spark, plan.withColumn("budget", F.round(rest).cast("long")).withColumnRenamed("source", "of"), "targets")

    joined = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).drop("of")
    q = pareto(uniform(seed, F.col("id"), F.col("source"), F.col("size")), F.col("p"))
    ranked = joined.withColumn("q", q).withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * steps), F.lit(steps - 1)))
    words = F.col("size") * F.col("c")
    # at most ``steps`` rows for each source
    bins = ranked.where(F.col("q").isNotNull() & (F.col("size") > 0)).groupBy("source", "bin", "budget").agg(F.sum(words).alias("held"))
    upto = F.sum("held").over(Window.partitionBy("source").orderBy("bin"))
    last = bins.withColumn("upto", upto).where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("held") <= F.col("budget")))
    last = staged(spark, last.select(F.col("source").alias("of"), F.col("bin").alias("last"),
                                     (F.col("budget") - F.col("upto") + F.col("held")).alias("room")), "last-bins")
    placed = ranked.join(last, ranked["source"].eqNullSafe(last["of"]), "left").drop("of")
    inside = F.coalesce(F.col("bin") == F.col("last"), F.lit(False)) & (F.col("size") > 0)
    # words that the rows of a last bin may still use, in rank order; other rows are in or out whole
    order = Window.partitionBy("source").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.where(inside).withColumn("open", F.col("room") - F.coalesce(F.sum(words).over(order), F.lit(0)))
    # all is taken where the budget holds the whole source (its fraction rounds to one)
    full = F.when(F.col("p").isNull() | (F.col("budget") <= 0), F.lit(0).cast("long")).when(
        F.col("last").isNull() | (F.col("bin") < F.col("last")), words).otherwise(F.lit(0).cast("long"))
    others = placed.where(~inside).withColumn("open", full)
    every = copies(ends.unionByName(others), "c", copies_step)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("open") - F.col("__copy") * F.col("size")))
    return every.select(F.col("id").alias(key), "size", "source_size", "target",
                        (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


#: the same rows in DuckDB for the defaults; the whole rank order instead of bins
SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sizes as (
  select source, sum(size)::bigint as source_size,
    [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as w
  from sized group by source
), pool as (
  select *, (sum(source_size) over () * 150)::bigint
      - coalesce(sum(source_size) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint * 200 as free,
    sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following)::bigint as of
  from sizes
), stop as (
  select free, of from pool where free * w <= source_size * 200 * of order by source_size / w, source nulls last limit 1
), plan as (
  select source, source_size, least((source_size * 2)::double,
    coalesce((s.free * w)::double / (s.of * 100)::double, (source_size * 2)::double)) as target
  from pool left join stop s on true
), rated as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from plan
), dealt as (
  select *, case when source_size > 0 then (target - whole * source_size) / source_size end as p,
    round(target - whole * source_size)::bigint as budget from rated
), drawn as (
  select d.doc_id, d.size, r.*, (('0x' || substr(sha256('finledger' || chr(31) || coalesce(d.doc_id::varchar, chr(30)) || chr(31)
      || coalesce(d.source, chr(30)) || chr(31) || d.size), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u
  from sized d join dealt r on d.source is not distinct from r.source
), ranked as (
  select *, case when p > 0 and p < 1 then (u / (1 - u)) / (p / (1 - p)) end as q from drawn
), ordered as (
  select *, budget - coalesce(sum(size) over (partition by source order by q, doc_id nulls first, size
    rows between unbounded preceding and 1 preceding), 0) as room from ranked
)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, room)))::bigint as taken from ordered
"""
