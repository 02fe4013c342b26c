"""Exact Jaccard join of word shingle sets and its connected components.

Sets of 5-word shingles with the Jaccard distance form a metric space; two
documents link at a distance of at most 0.2.  Unrelated documents all stand at
distances near 1 from any pivot, where the triangle inequality excludes nothing
(a window of 2 * 0.2 around equal distances keeps everybody), so regions are
first cut where distances do differ:

1.  Equal sets collapse to one node.
2.  Shingles get one order, frequent ones (counted on a fixed share of the
    documents) last.  Linked sets share a shingle among their first
    n - ceil(0.8 n) + 1, so the nodes that hold a shingle there form a region,
    and every link lies in a region.
3.  Each region joins by pivots.  Every node is compared with its region's
    pivots; linked nodes merge.  Regions whose nodes are all merged are done;
    the others recur with new pivots from their classes.
4.  What is left after ``rounds`` is joined completely, but for pairs in one
    class.  Nodes near a pivot form its cell (a pivot's regions share one cell);
    a cell is dealt out in tiles, each joining at most ``TILE`` nodes outside the
    pivot's class with ``TILE`` nodes inside the triangle inequality's window.
    Nodes far from their pivot join within their region, again but for those
    that the triangle inequality excludes.
5.  A comparison first bounds the distance by the two prefixes, which are known
    completely below their smaller end; only pairs that pass fetch whole sets.

Only components are returned, so pairs in one class need no comparison; no link
between classes is lost.  Any order of shingles gives the same result; the
sample (``share`` of the distinct texts, the ``hot`` most frequent shingles)
only keeps regions small.

Defined results: documents without words link with nothing; equal texts share a
component; a null key counts after all others when the smallest key is sought;
rows with equal key and text are one document; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, release, ship, staged

WIDTH = 5
HOT_BIT = np.int64(1) << np.int64(61)
# odd multipliers for the places of a shingle, from the fractional bits of square roots of 2, 3, 5, 7, 11
_PLACES = np.array([0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1],
                   np.uint64)
FILTER_BITS = 1 << 22
PART_CHARS = 4_000_000
TILE = 256


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str], hot: np.ndarray) -> Iterator[np.ndarray]:
    """The set of each text as sorted 62-bit numbers, those of hot shingles above all others."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < PART_CHARS):
            size += len(texts[stop])
            stop += 1
        low = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts[at:stop], pa.large_string())))
        words = pc.ascii_split_whitespace(low)
        flat = words.flatten().dictionary_encode()
        codes = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
        h = codes[flat.indices.to_numpy()] if len(flat) else codes
        ends = np.cumsum([0, *pc.list_value_length(words).to_pylist()]).tolist()
        n = max(0, len(h) - WIDTH + 1)
        whole = np.zeros(n, np.uint64)
        for i in range(WIDTH):
            whole += _mixed(h[i:i + n] + _PLACES[i]) * _PLACES[i]
        whole = (_mixed(whole) >> np.uint64(3)).view(np.int64)
        empty = [not t for t in low.to_pylist()]
        for x, y, none in zip(ends[:-1], ends[1:], empty, strict=True):
            if none:
                yield np.zeros(0, np.int64)
                continue
            if y - x < WIDTH:  # the whole sequence, its length in the hash
                short = xxhash.xxh64_intdigest(h[x:y].tobytes(), seed=y - x)
                s = np.array([short >> 3], np.uint64).view(np.int64)
            else:
                s = np.unique(whole[x:y - WIDTH + 1])
            if len(hot):
                near = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                if near.any():
                    s = np.concatenate([s[~near], s[near] | HOT_BIT])
            yield s
        at = stop


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def signer(hot):
    """(id, h, text) to (id, h, n, node, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, prefix = [], [], []
            for s in shingle_sets([t or "" for t in b.column(2).to_pylist()], hot.value):
                n.append(len(s))
                node.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                prefix.append(s[:prefix_size(len(s))])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                 pa.array(prefix, pa.list_(pa.int64()))], ["id", "h", "n", "node", "prefix"])

    return run


def whole_sets(hot, flags):
    """(node, place, text) to (node, whole set as bytes), for flagged places only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = flags.value
        for b in batches:
            place = b.column(1).to_numpy()
            want = np.flatnonzero(f[place >> 3] >> (place & 7) & 1)
            for lo in range(0, len(want), 1000):
                part = b.take(pa.array(want[lo:lo + 1000]))
                sets = list(shingle_sets([t or "" for t in part.column(2).to_pylist()], hot.value))
                node = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "s"])

    return run


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, na, nb, pa, pb) to (a, b, may, least): whether they may link, and a bound below their distance."""
    for b in batches:
        may, least = [], []
        for na, nb, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            # strictly below the smaller end both sets are known whole; equal upper halves count as equal
            end = min(x[-1], y[-1])
            x, y = x[:np.searchsorted(x, end)], y[:np.searchsorted(y, end)]
            apart = len(x) + len(y) - 2 * min(len(x), len(y), int(np.isin(x, y).sum()))
            apart = max(apart, abs(na - nb))
            may.append(9 * apart <= na + nb)
            least.append(2 * apart / (na + nb + apart))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(may, pa.bool_()), pa.array(least, pa.float64())], ["a", "b", "may", "least"])


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) to (a, b, linked, distance)."""
    for b in batches:
        linked, far = [], []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            linked.append(100 * both >= 80 * union)
            far.append(1 - both / union)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(linked, pa.bool_()), pa.array(far, pa.float64())],
            ["a", "b", "linked", "distance"])


def shared(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by blocks of their common elements."""
    fx, fy = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(fx, fy)
    out = np.zeros((len(x), len(y)), np.float32)
    parts = []
    for flat, sets in ((fx, x), (fy, y)):
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        ok = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        parts.append((at[ok][order], row[ok][order], len(sets)))
    for lo in range(0, len(both), columns):
        m = []
        for at, row, n in parts:
            x0, x1 = np.searchsorted(at, [lo, lo + columns])
            one = np.zeros((n, columns), np.float32)
            one[row[x0:x1], at[x0:x1] - lo] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out


def tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the classes of two tiles of a cell: one for each node of the left and class of the right."""
    a, b = [], []
    if left.num_rows and right.num_rows:
        da, db = left["d"].to_numpy(), right["d"].to_numpy()
        right = right.take(np.flatnonzero((db >= da.min() - 0.2 - 1e-9) & (db <= da.max() + 0.2 + 1e-9)))
    if left.num_rows and right.num_rows:
        x, y = ([np.frombuffer(s, np.int64) for s in t["s"].to_pylist()] for t in (left, right))
        nx, ny = (np.array([len(s) for s in sets])[:, None] for sets in (x, y))
        both = shared(x, y)
        linked = 100 * both >= 80 * (nx + ny.T - both)
        rx, ry = left["root"].to_numpy(), right["root"].to_numpy()
        kx, ky = left["node"].to_numpy(), right["node"].to_numpy()
        for i in range(len(x)):
            at = np.flatnonzero(linked[i] & (ry != rx[i]))
            at = at[np.unique(ry[at], return_index=True)[1]]
            a += [kx[i]] * len(at)
            b += ky[at].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, root (smallest node reachable) for all ends of (a, b): alternating large and small stars."""
    spark = links.sparkSession
    edges = staged(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = staged(spark, small.where(F.col("u") != F.col("v")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


class Space:
    """The nodes of a corpus, their prefixes, and whole sets where they were asked for."""

    def __init__(self, docs: DataFrame, key: str, text: str, share: int, hot: int):
        self.spark = spark = docs.sparkSession
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        self.rows = docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))
        self.kind = docs.schema[key].dataType.simpleString()
        none = spark.sparkContext.broadcast(np.zeros(0, np.int64))
        one = "id {0}, h long, n long, node long, prefix array<long>".format(self.kind)
        # frequent shingles: whole sets of a fixed share of the distinct texts, the most frequent ones first
        some = self.rows.where(F.pmod(F.col("h"), F.lit(share)) == 0).dropDuplicates(["h"])
        flags = spark.sparkContext.broadcast(np.full(1, 255, np.uint8))
        sets = map_batches(some.select(F.col("h"), F.lit(0).cast("long").alias("place"), "text"), listed(none, flags),
                           "node long, s array<long>").dropDuplicates(["node"])
        often = sets.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= 3)
        # the least count that at most ``hot`` shingles reach: no sort of all of them
        often, least, total = staged(spark, often, "frequent"), 3, 0
        none.destroy()
        flags.destroy()
        for r in often.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toLocalIterator():
            total += r["n"]
            if total > hot:
                least = r["c"] + 1
                break
        often = often.where(F.col("c") >= least)
        self.hot = spark.sparkContext.broadcast(np.sort(np.array([r["s"] for r in often.toLocalIterator()], np.int64)))
        signed = staged(spark, map_batches(self.rows, signer(self.hot), one), "signatures")
        known = signed.where(F.col("node").isNotNull()).select("node", "n", "prefix").dropDuplicates(["node"])
        self.nodes = staged(spark, known, "nodes")
        self.signed = staged(spark, signed.drop("prefix"), "classes-of-equals")
        release(signed)
        self.sets: DataFrame | None = None

    def fetch(self, need: DataFrame) -> None:
        """Adds the whole sets of ``need`` (node) that are not there yet: one pass over the texts, filtered before any shuffle."""
        if self.sets is not None:
            need = need.join(self.sets, "node", "left_anti")
        first = self.signed.join(need, "node", "left_semi").groupBy("node").agg(F.min("h").alias("h"))
        first = staged(self.spark, first, "wanted")
        place = F.pmod(F.col("h"), F.lit(FILTER_BITS))
        # Spark's bitmaps number positions from 1, in buckets of 32768 that begin at 1
        bits = first.select((place + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
        flags = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
        any_ = False
        for r in bits.toLocalIterator():  # a bitmap of fixed size in at most 128 rows
            part, lo = np.frombuffer(bytes(r["bits"]), np.uint8), (r["k"] - 1) * 4096
            flags[lo:lo + len(part)] |= part
            any_ = True
        if not any_:
            return
        flags = self.spark.sparkContext.broadcast(flags)
        rows = self.rows.where(F.col("text") != "").select("h", place.cast("long").alias("place"), "text")
        found = map_batches(rows, whole_sets(self.hot, flags), "node long, s binary")
        found = found.join(first, "node", "left_semi").dropDuplicates(["node"])
        found = staged(self.spark, found, "sets")
        flags.destroy()  # the sets are stored
        if (lost := first.count() - found.count()) != 0:
            raise RuntimeError(f"{lost} wanted sets were not found")
        self.sets = found if self.sets is None else self.sets.union(found)

    def compare(self, pairs: DataFrame) -> DataFrame:
        """a, b, linked, distance (null where the prefixes exclude a link), least (a bound below it) for the pairs (a, b)."""
        # the upper halves of the numbers keep their order and are enough for a bound
        upper = F.transform("prefix", lambda x: F.shiftright(x, 31).cast("int"))
        n = self.nodes.select("node", "n", upper.alias("prefix"))
        both = pairs.join(n.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa")), "a")
        both = both.join(n.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb")), "b")
        both = both.select("a", "b", "na", "nb", "pa", "pb")
        every = staged(self.spark, map_batches(both, bounded, "a long, b long, may boolean, least double"), "bounded")
        may, out = every.where("may").select("a", "b"), every.where("not may").select(
            "a", "b", F.lit(False).alias("linked"), F.lit(None).cast("double").alias("distance"), "least")
        self.fetch(may.select(F.col("a").alias("node")).union(may.select("b")).distinct())
        if self.sets is None:
            return out
        s = self.sets
        both = may.join(s.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
        both = both.join(s.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
        found = staged(self.spark, map_batches(both, measured, "a long, b long, linked boolean, distance double"), "measured")
        return out.union(found.withColumn("least", F.col("distance")))

    def join_cells(self, cells: DataFrame) -> DataFrame:
        """Links (a, b) between classes in each cell; ``cells``: p, node, root, d (distance from p)."""
        own = cells.where("node = p").select("p", F.col("root").alias("main"))
        rows = cells.join(own, "p").withColumn("open", (F.col("root") != F.col("main")).cast("int"))
        size = rows.groupBy("p").agg(F.sum("open").alias("no"), F.count(F.lit(1)).alias("nk"))
        size = size.where("no > 0").select("p", *[F.ceil(F.col(c) / TILE).cast("int").alias(t) for c, t in (("no", "to"), ("nk", "tk"))])
        rows = rows.join(size, "p").join(self.sets, "node")
        first = F.pmod(F.xxhash64("node", F.lit(1)), F.col("to")).cast("int")
        second = F.pmod(F.xxhash64("node", F.lit(2)), F.col("tk")).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.where("open = 1").select("p", first.alias("i"), all_of("tk").alias("j"), "node", "root", "d", "s")
        right = rows.select("p", all_of("to").alias("i"), second.alias("j"), "node", "root", "d", "s")
        ship(self.spark)
        # new names, as both sides come from the same rows
        names = ["p", "i", "j", "node", "root", "d", "s"]
        left, right = left.toDF(*names), right.toDF(*names)
        return left.groupBy("p", "i", "j").cogroup(right.groupBy("p", "i", "j")).applyInArrow(tile, "a long, b long")


def listed(hot, flags):
    """As ``whole_sets``, with the set as an array."""
    inner = whole_sets(hot, flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in inner(batches):
            sets = [np.frombuffer(s.as_buffer(), np.int64) for s in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return run


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 32, hot: int = 1 << 18,
                    rounds: int = 2) -> DataFrame:
    """id, h (hash of the text), n (set size), root (class; null without words) for every row."""
    space = Space(docs, key, text, share, hot)
    spark = space.spark
    entries = space.nodes.select("node", F.explode("prefix").alias("s"))
    # regions of more than one node; the aggregate combines before its shuffle
    regions = entries.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("q")).where("c > 1")
    held = staged(spark, entries.join(regions, "s"), "regions")
    # the first pivot is the node whose shingles most others hold: the middle of a group of near copies
    weight = held.groupBy("node").agg(F.sum("c").alias("w")).join(space.nodes.select("node", "n"), "node")
    weight = staged(spark, weight, "weights")
    weighted = held.select("s", "node", "q").join(weight, "node")
    middle = weighted.groupBy("s").agg(F.max(F.struct("w", "node", "n")).alias("m"),
                                       F.min(F.struct("node", "n")).alias("q"))
    middle = middle.select("s", F.col("m.node").alias("p"), F.col("m.n").alias("np"), F.col("q.node").alias("q"), F.col("q.n").alias("nq"))
    open_ = staged(spark, weighted.drop("q").join(middle, "s"), "pivots")
    release(held)

    def pairs_of(*ends: DataFrame) -> DataFrame:
        """Distinct pairs (a, b), a < b, of the given (x, y)."""
        every = ends[0] if len(ends) == 1 else ends[0].union(ends[1])
        return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    # sizes alone exclude most pairs of unrelated nodes
    alike = lambda m: f"5 * least(n, {m}) >= 4 * greatest(n, {m})"
    stars = pairs_of(open_.where("node != p and " + alike("np")).select(F.col("node").alias("x"), F.col("p").alias("y")),
                     open_.where("node != q and " + alike("nq")).select(F.col("node").alias("x"), F.col("q").alias("y")))
    stars = staged(spark, stars, "stars")
    seen = space.compare(stars)
    roots = components(seen.where("linked").select("a", "b"))

    def merged(new: DataFrame) -> DataFrame:
        if new.isEmpty():
            return roots
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new.select("a", "b")))

    def unmerged(name: str, r: int) -> DataFrame:
        """The regions that still hold several classes, with a node of their first (l) and last class (g)."""
        now = open_.select("s", "node", "n", "p", "np", "w").join(roots, "node", "left")
        now = now.withColumn("root", F.coalesce("root", "node"))
        low = F.struct("root", -F.col("w") if r == 1 else F.xxhash64("node", F.lit(r)), "node", "n")
        high = F.struct("root", F.col("w") if r == 1 else F.xxhash64("node", F.lit(r)), "node", "n")
        ends = now.groupBy("s").agg(F.min(low).alias("lo"), F.max(high).alias("hi"), F.count(F.lit(1)).alias("c"))
        ends = ends.where("lo.root != hi.root and c > 2").select(
            "s", F.col("lo.node").alias("l"), F.col("lo.root").alias("lr"), F.col("lo.n").alias("nl"),
            F.col("hi.node").alias("g"), F.col("hi.root").alias("gr"), F.col("hi.n").alias("ng"))
        return staged(spark, now.join(ends, "s"), name)

    for r in range(1, rounds):
        open_ = unmerged(f"regions-{r}", r)
        more = pairs_of(open_.where("root != lr and " + alike("nl")).select(F.col("node").alias("x"), F.col("l").alias("y")),
                        open_.where("root != gr and " + alike("ng")).select(F.col("node").alias("x"), F.col("g").alias("y")))
        new = space.compare(staged(spark, more.join(seen, ["a", "b"], "left_anti"), f"pairs-{r}"))
        seen = seen.union(new)
        roots = merged(new.where("linked"))

    open_ = unmerged("regions-last", rounds)
    far = seen.select(F.col("a").alias("node"), F.col("b").alias("p"), "distance", "least").union(
        seen.select(F.col("b").alias("node"), F.col("a").alias("p"), "distance", "least"))
    placed = open_.join(far, ["node", "p"], "left").withColumn(
        "d", F.when(F.col("node") == F.col("p"), 0.0).otherwise(F.col("distance")))
    by_size = F.lit(1.0) - F.least("n", "np") / F.greatest("n", "np")
    least = F.greatest(by_size, F.coalesce("d", "least", F.lit(0.0)))
    placed = staged(spark, placed.select("s", "p", "node", "n", "root", "d", least.alias("least")), "placed")
    if space.sets is not None:
        cells = placed.where(F.col("d").isNotNull()).select("p", "node", "root", "d").distinct()
        roots = merged(staged(spark, space.join_cells(cells), "cell-links"))
    # nodes far from their pivot: pairs in a region that are not both in its cell
    x = placed.select("s", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("d").alias("da"), F.col("n").alias("na"))
    y = placed.where(F.col("d").isNull()).select(
        "s", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("least").alias("lb"), F.col("n").alias("nb"))
    rest = x.join(y, "s").where("ra != rb and 5 * least(na, nb) >= 4 * greatest(na, nb) and "
                                "(da is null and a < b or da is not null and lb <= da + 0.2 + 1e-9)")
    rest = pairs_of(rest.select(F.col("a").alias("x"), F.col("b").alias("y")))
    rest = staged(spark, rest.join(seen, ["a", "b"], "left_anti"), "pairs-last")
    if not rest.isEmpty():
        roots = merged(space.compare(rest).where("linked"))
    space.hot.destroy()  # what follows reads stored tables only
    out = space.signed.select("id", "h", "n", "node").join(roots, "node", "left")
    return out.select("id", "h", "n", F.coalesce("root", "node").alias("root"))


def join_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key, n_shingles, component_id (the smallest key that links reach) for every row."""
    rows = staged(docs.sparkSession, link_components(docs, key, text, **how), "classes")
    least = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least"))
    out = rows.join(least, "root", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest key; all columns are kept."""
    rows = staged(docs.sparkSession, link_components(docs, key, text, **how), "classes")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    first = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(order).alias("f"))
    mark = rows.where(F.col("root").isNotNull()).join(first, "root")
    gone = mark.where(~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("h") == F.col("f.h"))))
    gone = staged(docs.sparkSession, gone.select(F.col("id").alias("__id"), F.col("h").alias("__gone")).distinct(), "gone")
    own = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    out = own.join(gone, own[key].eqNullSafe(gone["__id"]) & (own["__own"] == gone["__gone"]), "left_anti")
    # rows with equal key and text are one document; where there are none, texts need no second shuffle
    if not rows.groupBy("id", "h").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([key, "__own"])
    return out.select(*docs.columns)
