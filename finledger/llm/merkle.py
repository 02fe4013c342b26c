"""Merkle manifest of a dataset: trees of fan-out 8 in blocks laid out after van Emde Boas.

Every row becomes a leaf digest.  The leaves of a group ascend by key; every 8
consecutive nodes become one parent until one node, the subroot, remains.  The
subroots, ordered by group, grow a tree of the same kind to the root.

1.  Leaves get gapless places within their group from one range sort: a row's
    number in its sorted partition, plus the sizes of the group's parts before.
    A group of any size is spread over partitions and never lies in one task.
2.  The leaves are cut into aligned blocks of 8 ** ``height``.  A block is one
    row holding its whole subtree: a tree of h levels is the tree of its upper
    h // 2 levels followed by the subtrees below, each laid out the same way.
    The first place of any laid-out tree is its root, so construction lays out
    the lower subtrees, hashes their first places in runs and lays out the tree
    above them; the place of a node follows from its depth and index alone.
3.  The roots of the blocks are the leaves of the next tier; tiers are built
    until every group has one block, so the driver loops log(n) / log(8 ** height)
    times, and sees only whether a tier is the last.
4.  Siblings are read from the top tier down: a block gets the path above its
    root, adds its own siblings by address and hands each place its path.  A
    block is one row of bounded size, so no group meets in a task.

Digests are SHA-256; parents and proofs hash the hexadecimal text of digests.

Defined results: a null group is a group and comes before all others; null keys
come first in their group; rows with equal key ascend by their digest, identical
rows are leaves of their own; a null column counts as ``-``; a lone leaf is its
group's subroot, a lone subroot the root, and the proof of a leaf without
siblings hashes nothing; an empty table has no leaves and gives no rows; columns
that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, ship, staged

FAN = 8
DIGEST = 32
HEIGHT = 3  # a block holds 8 ** 3 leaves, about 19 KB of digests


# --- the layout -----------------------------------------------------------------------
def nodes_of(levels: int) -> int:
    """Nodes of a complete tree."""
    return (FAN**levels - 1) // (FAN - 1)


def levels_of(n: int) -> int:
    """Levels of the tree over n leaves."""
    levels = 1
    while FAN ** (levels - 1) < n:
        levels += 1
    return levels


def address(levels: int, depth: int, index):
    """Place of a node (or an array of nodes of one depth) in the laid-out tree."""
    if levels == 1:
        return index * 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    under = FAN ** (depth - top)
    return nodes_of(top) + index // under * nodes_of(levels - top) + address(levels - top, depth - top, index % under)


def parent(digests: list[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def runs(digests: list) -> list[list]:
    return [digests[k:k + FAN] for k in range(0, len(digests), FAN)]


def laid_out(levels: int, leaves: list[bytes]) -> list[bytes]:
    """The tree over the leaves, its root first; places after the last node are left out."""
    if levels == 1:
        return leaves
    top = levels // 2
    wide = FAN ** (levels - top - 1)
    below = [laid_out(levels - top, leaves[k:k + wide]) for k in range(0, len(leaves), wide)]
    above = laid_out(top, [parent(r) for r in runs([tree[0] for tree in below])])
    out = above + [bytes(DIGEST)] * (nodes_of(top) - len(above))
    for tree in below[:-1]:  # all but the last are complete
        out += tree
    return out + below[-1]


@lru_cache(maxsize=64)
def _places(levels: int) -> list[list[int]]:
    """Places by depth, from the address arithmetic."""
    return [address(levels, d, np.arange(FAN**d)).tolist() for d in range(levels)]


class Path:
    """Siblings from a node to the top: per level the node's place in its run and the run's others."""

    @staticmethod
    def packed(steps: list[tuple[int, list[bytes]]]) -> bytes:
        return b"".join(bytes([at, len(others)]) + b"".join(others) for at, others in steps)

    @staticmethod
    def steps(raw: bytes) -> list[tuple[int, list[bytes]]]:
        out, i = [], 0
        while i < len(raw):
            at, n = raw[i], raw[i + 1]
            out.append((at, [raw[i + 2 + DIGEST * k:i + 2 + DIGEST * (k + 1)] for k in range(n)]))
            i += 2 + DIGEST * n
        return out

    @staticmethod
    def folded(digest: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
        for at, others in steps:
            digest = parent([*others[:at], digest, *others[at:]])
        return digest


def siblings(store: bytes, levels: int, n: int, leaf: int) -> list[tuple[int, list[bytes]]]:
    """The steps from a leaf to the root of a laid-out tree over n leaves."""
    steps, i = [], leaf
    for depth in range(levels - 1, 0, -1):
        places, first = _places(levels)[depth], i // FAN * FAN
        others = [j for j in range(first, min(first + FAN, n)) if j != i]
        steps.append((i - first, [store[DIGEST * places[j]:DIGEST * (places[j] + 1)] for j in others]))
        i, n = i // FAN, -(-n // FAN)
    return steps


def span(n: int, wide: int) -> int:
    """Levels of a block: those of its group's tree, all levels of a block where there are several."""
    return levels_of(min(n, wide))


# --- places -----------------------------------------------------------------------------
def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with g (a number of the group, ascending like it), i (place in it), n (its size).

    Rows that are equal in every ordering column are told apart by their place in
    the input alone, so that they too are spread over the range partitions.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [group, *order, "tie"]
    # a row's id is its partition's number and its place in the sorted partition
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    at = staged(spark, at.withColumn("m", F.monotonically_increasing_id()), name)
    part = F.shiftright("m", 33).alias("part")
    # one row for each partition and group that meet
    parts = at.groupBy(part, group).agg(F.min("m").alias("m0"), F.count(F.lit(1)).alias("c"))
    of = Window.partitionBy(group)
    before = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(spark, parts.select(
        F.col("part").alias("part0"), F.col(group).alias("group0"), "m0", F.min("m0").over(of).alias("g"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(of).alias("n")), f"{name}-parts")
    out = at.withColumn("part", part).join(
        parts, (F.col("part") == F.col("part0")) & F.col(group).eqNullSafe(F.col("group0")))
    return out.withColumn("i", F.col("m") - F.col("m0") + F.col("before")).drop("m", "m0", "part", "part0", "group0", "before")


# --- blocks -------------------------------------------------------------------------------
def builder(wide: int, carried: list[str]):
    """Rows of one block to one row: its number, the laid-out digests, their root and the carried columns as lists."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        n = rows["n"][0].as_py()
        tree = laid_out(span(n, wide), rows["digest"].to_pylist())
        lists = {c: pa.array([rows[c].combine_chunks().to_pylist()], pa.list_(rows.schema.field(c).type)) for c in carried}
        return pa.table({"g": [key[0].as_py()], "b": [key[1].as_py()], "n": [n], "size": [rows.num_rows],
                         "store": [b"".join(tree)], "root": [tree[0]], **lists})

    return run


def blocks(leaves: DataFrame, wide: int, carried: dict[str, str], name: str) -> DataFrame:
    """(g, i, n, digest, carried) to one row per block: g, b, n, size, store, root, carried lists."""
    ship(leaves.sparkSession)
    kinds = "".join(f", {c} array<{k}>" for c, k in carried.items())
    rows = leaves.withColumn("b", F.floor(F.col("i") / wide).cast("long")).groupBy("g", "b")
    out = rows.applyInArrow(builder(wide, list(carried)), "g long, b long, n long, size long, store binary, root binary" + kinds)
    return staged(leaves.sparkSession, out, name)


def tiers(leaves: DataFrame, wide: int, carried: dict[str, str], name: str) -> list[DataFrame]:
    """Blocks of the leaves, blocks of those blocks' roots, and so on until every group has one block."""
    out = [blocks(leaves, wide, carried, f"{name}-0")]
    while True:
        up = out[-1].where(F.col("n") > wide)
        if up.isEmpty():
            return out
        up = up.select("g", F.col("b").alias("i"), F.ceil(F.col("n") / wide).cast("long").alias("n"), F.col("root").alias("digest"))
        out.append(blocks(up, wide, {}, f"{name}-{len(out)}"))


def roots(layers: list[DataFrame], wide: int) -> DataFrame:
    """g, digest: the root of every group."""
    tops = [t.where(F.col("n") <= wide).select("g", F.col("root").alias("digest")) for t in layers]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the path above them to one row per place: its group, its place, its whole path and the subroot."""
    for batch in batches:
        for r in batch.to_pylist():
            levels = span(r["n"], r["wide"])
            here = [Path.packed(siblings(r["store"], levels, r["size"], k)) + r["path"] for k in range(r["size"])]
            first = r["b"] * r["wide"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["g"]] * r["size"], pa.int64()), pa.array(range(first, first + r["size"]), pa.int64()),
                 pa.array(here, pa.binary()), pa.array([r["subroot"]] * r["size"], pa.binary()),
                 pa.array([r["top"]] * r["size"], pa.binary())], ["g", "b", "path", "subroot", "top"])


def _above(block: DataFrame, path: DataFrame | None, top: DataFrame, wide: int) -> DataFrame:
    """The blocks of a tier with the path above each, its group's subroot and the root."""
    # a group's only block meets its group's path, the others the path of their place one tier up
    ends = top.select("g", F.lit(0).cast("long").alias("b"), "path", "subroot", "top")
    last = block.where(F.col("n") <= wide).join(ends, ["g", "b"])
    if path is None:
        return last
    return last.unionByName(block.where(F.col("n") > wide).join(path, ["g", "b"]))


def descended(layers: list[DataFrame], top: DataFrame, wide: int, name: str) -> DataFrame:
    """The first tier's blocks with path, subroot and top; ``top``: g, path, subroot, top of every group."""
    path = None
    for k in range(len(layers) - 1, -1, -1):
        here = _above(layers[k], path, top, wide)
        if k == 0:
            return here
        rows = here.select("g", "b", "n", "size", "store", "path", "subroot", "top", F.lit(wide).alias("wide"))
        path = staged(rows.sparkSession, map_batches(
            rows, opened, "g long, b long, path binary, subroot binary, top binary"), f"{name}-paths-{k}")
    raise AssertionError("no tier")


class Manifest:
    """The stored trees of a dataset.

    ``layers``: tiers of blocks of the groups' trees; ``upper``: those of the tree
    over the subroots.  All are tables in the shared folder.
    """

    def __init__(self, leaves: DataFrame, group: str, order: list[str], carried: dict[str, str], height: int = HEIGHT):
        self.spark, self.wide, self.carried = leaves.sparkSession, FAN**height, carried
        placed = numbered(leaves, group, order, "leaves")
        self.layers = tiers(placed.select("g", "i", "n", "digest", *carried), self.wide, carried, "blocks")
        # one leaf per group, in the groups' order
        tops = roots(self.layers, self.wide).withColumn("all", F.lit(0)).withColumnRenamed("g", "of")
        self.subroots = staged(self.spark, numbered(tops, "all", ["of"], "subroots"), "subroots-placed")
        self.upper = tiers(self.subroots.select("g", "i", "n", "digest", "of"), self.wide, {"of": "bigint"}, "upper")

    def root(self) -> DataFrame:
        """One row (digest): the root; none for an empty dataset."""
        return roots(self.upper, self.wide).select("digest")

    def group_paths(self) -> DataFrame:
        """g, path, subroot, top: from every subroot to the root."""
        top = roots(self.upper, self.wide).select(
            "g", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("top"))
        rows = descended(self.upper, top, self.wide, "upper")
        rows = rows.select("g", "b", "n", "size", "store", "path", "subroot", "top", F.lit(self.wide).alias("wide"))
        paths = map_batches(rows, opened, "g long, b long, path binary, subroot binary, top binary").drop("subroot")
        at = self.subroots.select("g", F.col("i").alias("b"), F.col("of"), F.col("digest").alias("subroot"))
        # the place in the upper tree names the group whose subroot it is
        return staged(self.spark, paths.join(at, ["g", "b"]).select(F.col("of").alias("g"), "path", "subroot", "top"), "group-paths")

    def blocks_with_paths(self) -> DataFrame:
        """The leaves' blocks with the path above each, subroot and top."""
        return descended(self.layers, self.group_paths(), self.wide, "blocks")

    def proofs(self) -> DataFrame:
        """One row per leaf: the carried columns, digest, path (packed siblings), subroot, root (all binary)."""
        kinds = ", ".join(f"{c} {k}" for c, k in self.carried.items())
        return map_batches(self._rows(), prover(list(self.carried)),
                           f"{kinds}, digest binary, path binary, subroot binary, root binary")

    def checks(self, seen: str) -> DataFrame:
        """One row per leaf: the carried columns, digest, subroot, root, proof (hash of its siblings), folded.

        ``folded`` is the root recomputed from the carried digest ``seen`` (the leaf itself where null) and the stored siblings.
        """
        kinds = ", ".join(f"{c} {k}" for c, k in self.carried.items())
        return map_batches(self._rows(), checker(list(self.carried), seen),
                           f"{kinds}, digest binary, subroot binary, root binary, proof binary, folded binary")

    def _rows(self) -> DataFrame:
        return self.blocks_with_paths().select(
            "n", "size", "store", "path", "subroot", "top", F.lit(self.wide).alias("wide"), *self.carried)


def _leaves(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[list], dict, list]]:
    """Per block: its row number in the batch, its leaves, their steps within the block, the row, the steps above."""
    fixed = batch.select(["n", "size", "store", "path", "subroot", "top", "wide"]).to_pylist()
    for at, r in enumerate(fixed):
        n, store, levels = r["size"], r["store"], span(r["n"], r["wide"])
        places = _places(levels)[levels - 1]
        leaves = [store[DIGEST * p:DIGEST * (p + 1)] for p in places[:n]]
        yield at, leaves, [siblings(store, levels, n, k) for k in range(n)], r, Path.steps(r["path"])


def prover(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, leaves, steps, r, _ in _leaves(b):
                n = len(leaves)
                cols = [b.column(b.schema.get_field_index(c))[at].values for c in carried]
                cols += [pa.array(leaves, pa.binary()), pa.array([Path.packed(s) + r["path"] for s in steps], pa.binary()),
                         pa.array([r["subroot"]] * n, pa.binary()), pa.array([r["top"]] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*carried, "digest", "path", "subroot", "root"])

    return run


def checker(carried: list[str], seen: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, leaves, steps, r, above in _leaves(b):
                n = len(leaves)
                cols = [b.column(b.schema.get_field_index(c))[at].values for c in carried]
                shown = cols[carried.index(seen)].to_pylist()
                upper = "".join(o.hex() for _, others in above for o in others)
                proof = [sha256(("".join(o.hex() for _, others in s for o in others) + upper).encode()).digest() for s in steps]
                folded = [Path.folded(x or d, s + above) for x, d, s in zip(shown, leaves, steps, strict=True)]
                cols += [pa.array(leaves, pa.binary()), pa.array([r["subroot"]] * n, pa.binary()),
                         pa.array([r["top"]] * n, pa.binary()), pa.array(proof, pa.binary()), pa.array(folded, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*carried, "digest", "subroot", "root", "proof", "folded"])

    return run


# --- documents --------------------------------------------------------------------------------
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def row_digest(*cols: Column) -> Column:
    """SHA-256 (hex) over the columns: ``-`` for null, else the value's UTF-8 length, a colon and the value."""
    parts = []
    for c in cols:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def verified_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                       n_chars: str = "n_chars", height: int = HEIGHT) -> DataFrame:
    """One row per document: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 3 divides the unsigned crc32 of the decimal key, the copy that is checked
    has A-Z of its text in lower case; a null key is never tampered with.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    c = {n: F.col(x) for n, x in (("id", key), ("source", source), ("lang", lang), ("n", n_chars), ("text", text))}
    leaf = row_digest(c["id"], c["source"], c["lang"], c["n"], c["text"])
    changed = F.pmod(F.crc32(c["id"].cast("string").cast("binary")), F.lit(3)) == 0
    other = row_digest(c["id"], c["source"], c["lang"], c["n"], F.translate(c["text"].cast("string"), UPPER, LOWER))
    rows = docs.select(c["id"].alias("id"), c["lang"].cast("string").alias("lang"), F.unhex(leaf).alias("digest"),
                       F.when(changed, F.unhex(other)).alias("seen"))
    rows = staged(spark, rows, "digests")  # texts are read and hashed once
    tree = Manifest(rows, "lang", ["id", "digest"], {"id": kind, "seen": "binary"}, height)
    hexed = lambda x: F.lower(F.hex(x))
    return tree.checks("seen").select(
        F.col("id").alias(key), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
        hexed("proof").alias("proof_sha256"), hexed("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


#: the same rows in DuckDB: crc32 as a fold over its table, trees and paths level by level
SQL = """
with recursive bit as (
  select i, 0 as k, i as v from range(256) t(i)
  union all
  select i, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from bit where k < 8
), crc as (select list(v order by i) as t from bit where k = 8),
part as (
  select d.doc_id, d.lang, d.source, d.n_chars, d.text, c.t,
    [ord(x) for x in string_split(d.doc_id::varchar, '')] as chars
  from documents d cross join crc c
), leaf0 as (
  select doc_id, lang, sha256(a || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when crc % 3 = 0 then sha256(a || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '-')) end as seen
  from (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as a,
    xor(list_reduce(list_prepend(4294967295::bigint, chars), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) as crc
    from (select * replace ([x::bigint for x in chars] as chars) from part))
), leaves as (
  select *, dense_rank() over (order by lang nulls first) as g,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from leaf0
), tree as (
  select g, 0 as lvl, i, leaf as h, count(*) over (partition by g) as n from leaves
  union all
  select g, lvl + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8
  from tree where n > 1 group by g, lvl, i // 8, n
), subroot as (select g, h from tree where n = 1),
top as (
  select 0 as lvl, row_number() over (order by g) - 1 as i, h, count(*) over () as n from subroot
  union all
  select lvl + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from top where n > 1 group by lvl, i // 8, n
), place as (select g, row_number() over (order by g) - 1 as i, h from subroot),
run as (
  select g, lvl, i // 8 as r, list(h order by i) as hs from tree where n > 1 group by g, lvl, i // 8
), toprun as (select lvl, i // 8 as r, list(h order by i) as hs from top where n > 1 group by lvl, i // 8),
step as (
  select l.g, l.i, r.lvl as lvl, r.hs, (l.i // (8 ** r.lvl)::bigint) % 8 as pos
  from leaves l join run r on r.g = l.g and r.r = l.i // (8 ** (r.lvl + 1))::bigint
  union all
  select l.g, l.i, 1000 + t.lvl, t.hs, (p.i // (8 ** t.lvl)::bigint) % 8
  from leaves l join place p on p.g = l.g join toprun t on t.r = p.i // (8 ** (t.lvl + 1))::bigint
), path as (
  select g, i, list({'hs': hs, 'pos': pos} order by lvl) as steps,
    string_agg(array_to_string(list_concat(hs[1:pos], hs[pos + 2:]), ''), '' order by lvl) as others
  from step group by g, i
), folded as (
  select l.g, l.i, list_reduce(list_prepend({'hs': [coalesce(l.seen, l.leaf)], 'pos': 0::bigint}, coalesce(p.steps, [])),
    lambda x, y: {'hs': [sha256(array_to_string(list_concat(y.hs[1:y.pos], x.hs, y.hs[y.pos + 2:]), ''))], 'pos': 0::bigint}).hs[1] as f,
    coalesce(p.others, '') as others
  from leaves l left join path p using (g, i)
)
select l.doc_id, l.leaf, s.h as subroot, t.h as root, sha256(f.others) as proof_sha256, f.f as folded_root, f.f = t.h as verified
from leaves l join subroot s using (g) join folded f using (g, i) cross join (select h from top where n = 1) t
"""
