"""Benchmark decontamination with a generalised suffix automaton over words.

The test items' words form one automaton of all their substrings.  A document's
words stream through it; the automaton keeps the length of the longest match
that ends at each word.  A window is ``width`` words of an item in a row, or all
words of a shorter item; the state reached tells which items' windows end here.
Words inside a window are hit; runs of hit words are spans.

The automaton of a chunk of items (``chunk_words`` words at most, or one item)
is small and sent to all executors; a larger benchmark is cut into several
chunks, which pass over the documents one after the other.

Defined results: null texts and items have no words and match nothing; equal
items and items with the same id are reported once per id; items without an id
match but are reported without one; an empty benchmark hits nothing; repeated
documents are scored one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, map_batches

#: lower-cases A-Z and turns everything but digits, letters and bytes beyond ASCII into blanks
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUN = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Substrings of all items: states with suffix links, grown item by item."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.width = width
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int]] = []  # (state of a prefix, item)
        whole: list[tuple[int, int, int]] = []  # (state, length, item) of short items
        self.ids = [i for i, _ in items]
        for at, (_, ws) in enumerate(items):
            last = 0
            for w in ws:
                last = self._add(last, w)
                ends.append((last, at))
            if 0 < len(ws) < width:
                whole.append((last, len(ws), at))
        self._mark(ends, whole, {at for at, (_, ws) in enumerate(items) if len(ws) >= width})
        self.shortest = min((min(len(ws), width) for _, ws in items if ws), default=0)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        n = len(self.vocabulary) + 1
        self.pair_codes = np.unique(np.array(
            [self.vocabulary[a] * n + self.vocabulary[b] for _, ws in items for a, b in zip(ws, ws[1:], strict=False)],
            np.int64))

    def _state(self, long: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(long)
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """A state for the words that reach q from p by the shorter way."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def _mark(self, ends, whole, long_items: set[int]) -> None:
        """found[s]: items with a window of full width that ends a match in s; short[s]: whole short items."""
        here: list[set[int]] = [set() for _ in self.len]
        for s, at in ends:
            if at in long_items:
                here[s].add(at)
        order = sorted(range(1, len(self.len)), key=lambda s: -self.len[s])
        for s in order:  # a substring occurs wherever its extensions to the left do
            if self.link[s] > 0:
                here[self.link[s]] |= here[s]
        self.found: list[frozenset[int]] = [frozenset()] * len(self.len)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        own: dict[int, list[tuple[int, int]]] = {}
        for s, long, at in whole:
            own.setdefault(s, []).append((long, at))
        for s in reversed(order):  # shorter states first
            up = self.link[s]
            # the suffix of full width lies in the state on the link path that spans this length
            self.found[s] = self.found[up] if self.len[up] >= self.width else (
                frozenset(here[s]) if self.len[s] >= self.width else frozenset())
            self.short[s] = self.short[up] + tuple(own.get(s, ()))

    def scan(self, ws: list[bytes], at: int, hit: bytearray, items: set[int]) -> None:
        """Streams words ws, which begin at word ``at`` of the document."""
        s = long = 0
        for i, w in enumerate(ws):
            while s and w not in self.next[s]:
                s = self.link[s]
                long = self.len[s]
            s = self.next[s].get(w, 0)
            long = long + 1 if s else 0
            back = 0
            if long >= self.width and self.found[s]:
                back = self.width
                items |= self.found[s]
            for n, item in self.short[s]:
                if n <= long:
                    back = max(back, n)
                    items.add(item)
            if back:
                hit[at + i + 1 - back:at + i + 1] = b"\x01" * back

    def match(self, ws: list[bytes]) -> tuple[bytearray, set[int]]:
        """Marks hit words; only runs of words that the automaton can follow are streamed."""
        hit, items = bytearray(len(ws)), set()
        if not self.shortest or len(ws) < self.shortest:
            return hit, items
        codes = np.fromiter((self.vocabulary.get(w, 0) for w in ws), np.int64, len(ws))
        known = codes > 0
        n = len(self.vocabulary) + 1
        both = codes[:-1] * n + codes[1:]
        pos = np.searchsorted(self.pair_codes, both)
        joined = known[:-1] & known[1:]
        if len(self.pair_codes):
            joined &= self.pair_codes[np.minimum(pos, len(self.pair_codes) - 1)] == both
        else:
            joined[:] = False
        # runs [b, e): every word known, every neighbouring pair in some item
        edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8), [0]])))
        for b, e in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist(), strict=True):
            if e - b >= self.shortest:
                self.scan(ws[b:e], b, hit, items)
        if self.shortest == 1:
            lone = np.concatenate([joined, [False]]) | np.concatenate([[False], joined])
            for i in np.flatnonzero(known & ~lone).tolist():
                self.scan(ws[i:i + 1], i, hit, items)
        return hit, items


def chunks(benchmark: DataFrame, item_key: str, text: str, chunk_words: int) -> Iterable[list[tuple]]:
    """The items, read in turn and handed on in chunks of bounded size."""
    now: list[tuple] = []
    size = 0
    rows = benchmark.select(F.col(item_key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    for r in rows.toLocalIterator():
        ws = words(r["t"])
        if not ws:
            continue
        if now and size + len(ws) > chunk_words:
            yield now
            now, size = [], 0
        now.append((r["k"], ws))
        size += len(ws)
    yield now


def digest(ids: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def spans_of(hit: bytearray) -> list[tuple[int, int]]:
    """Runs of hit words: (first, one past the last)."""
    return [(m.start(), m.end()) for m in re.finditer(b"\x01+", hit)]


def reporter(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = sent.value
        for b in batches:
            n, flags, found = [], [], []
            for t in b.column(1).to_pylist():
                ws = words(t)
                hit, items = auto.match(ws)
                n.append(len(ws))
                flags.append(spans_of(hit))
                found.append(sorted({auto.ids[i] for i in items if auto.ids[i] is not None}))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()),
                 pa.array([[{"b": x, "e": y} for x, y in f] for f in flags], pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))),
                 pa.array(found, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])

    return run


def merged(spans):
    """Column: overlapping or touching spans of several chunks as one, in order."""
    empty = F.array().cast("array<struct<b:bigint,e:bigint>>")

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1),
                          F.array(F.struct(last["b"].alias("b"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] >= x["b"]), joined).otherwise(
            F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, step)


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           width: int = 10, chunk_words: int = 100_000) -> DataFrame:
    """key, n_words, spans (hit words as [b, e)), items (sorted ids) for every document.

    One chunk: one pass, no shuffle.  Several chunks: equal rows are counted
    first, each chunk reports on the distinct ones, the reports of a row meet by
    (key, checksum), and a row is repeated as often as it stood in the input.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {kind}, n_words long, spans array<struct<b:long,e:long>>, items array<string>"
    sc = docs.sparkSession.sparkContext
    parts = [sc.broadcast(Automaton(c, width)) for c in chunks(benchmark, item_key, "text", chunk_words)]
    if len(parts) == 1:
        return map_batches(rows, reporter(parts[0]), schema).withColumnRenamed("id", key)
    named = rows.groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
    named = named.withColumn("id", F.struct("id", F.xxhash64("text").alias("h"), "copies"))
    inner = named.schema["id"].dataType.simpleString()
    schema = schema.replace(f"id {kind}", f"id {inner}")
    each = [map_batches(named.select("id", "text"), reporter(p), schema) for p in parts]
    every = each[0]
    for e in each[1:]:
        every = every.union(e)
    met = every.groupBy("id").agg(F.max("n_words").alias("n_words"), merged(F.flatten(F.collect_list("spans"))).alias("spans"),
                                  F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    met = met.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("id.copies"))))
    return met.select(F.col("id.id").alias(key), "n_words", "spans", "items")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from a report."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["b"])
    return found.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cutter(sent, max_coverage: float, min_span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = [s.value for s in sent]
        for b in in_parts(batches):
            own = b.schema.get_field_index("__own")
            keep, texts = [], []
            for t in b.column(own).to_pylist():
                ws = words(t)
                hit = bytearray(len(ws))
                for a in autos:
                    got, _ = a.match(ws)
                    for x, y in spans_of(got):
                        hit[x:y] = b"\x01" * (y - x)
                spans = [s for s in spans_of(hit) if s[1] - s[0] >= min_span]
                keep.append(sum(y - x for x, y in spans) <= max_coverage * len(ws) if spans else True)
                if spans:
                    raw = t.encode()
                    place = [m.span() for m in _RUN.finditer(raw.translate(_FOLD))]
                    out, last = [], 0
                    for x, y in spans:
                        out.append(raw[last:place[x][0]])
                        last = place[y - 1][1]
                    t = b"".join([*out, raw[last:]]).decode()
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if i == own else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names).filter(pa.array(keep, pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", width: int = 10,
          max_coverage: float = 0.5, min_span: int = 1, chunk_words: int = 100_000) -> DataFrame:
    """``docs`` without the spans of benchmark windows; documents covered beyond ``max_coverage`` go whole.

    Only spans of at least ``min_span`` words are removed. All columns are kept; no shuffle.
    """
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(Automaton(c, width)) for c in chunks(benchmark, item_key, "text", chunk_words)]
    names = docs.columns
    rows = docs.withColumn(text, F.col(text).cast("string")).select(
        *[F.col(c).alias("__own") if c == text else F.col(c) for c in names])
    return map_batches(rows, cutter(sent, max_coverage, min_span), rows.schema).withColumnRenamed("__own", text)
