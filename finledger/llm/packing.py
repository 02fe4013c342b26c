"""Packing by lexical retrieval: a sharded BM25 index fills each seed's window with unused neighbours.

Documents become token ids (plus an end id), are dealt to shards by their most
telling token (tf-idf over the corpus), so that documents with a rare token in
common meet, and each shard is packed in blocks bounded by their tokens alone.  A block's inverted index (BM25 over
token ids, with idf and mean length of the whole corpus) ranks the unused
documents for a seed; they fill the seed's window in that order and the last one
is cut at the window's end, its rest staying unused.  What is left at a block's
end moves on to the next block; at a shard's end it is cut into powers of two,
which need no padding.

Defined results: a null or empty text is the end id alone; documents longer
than a window give full windows of their own and pack their rest; equal
documents or ids are separate documents; ties in score go to the earlier
document; an empty table packs into nothing.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE_BATCHES, in_parts, map_batches, staged
from .tokens import END_ID, proved, tokenizer_file, words_of

K1, B = 1.2, 0.75
#: a block is full at so many tokens; its index is all that a task keeps
BLOCK_TOKENS = 1 << 20
#: tokens of a shard, up to so many shards (their bounds are kept by the driver); sampled documents for each bound
SHARD_TOKENS, MAX_SHARDS, SAMPLED = 4 * BLOCK_TOKENS, 1 << 16, 64
VOCABULARY = 1 << 16


def _u16(ids: list[int]) -> bytes:
    a = array("H", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def encoder(path: str, whole):
    """(id, text) to (id, ids, crc): ids as little-endian 16-bit numbers with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = words_of(path, whole.value, _u16, pa.binary()), _u16([END_ID])
        for b in batches:
            ids: list[bytes] = []
            for found, ends in words.of_texts([t or "" for t in b.column(1).to_pylist()]):
                if not len(found):
                    ids += [end] * (len(ends) - 1)
                    continue
                # the words' ids lie one after the other in the array's data
                place = np.frombuffer(found.buffers()[1], np.int32)[found.offset:found.offset + len(found) + 1][ends]
                data = memoryview(found.buffers()[2])
                ids += [bytes(data[x:y]) + end for x, y in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                ["id", "ids", "crc"])

    return run


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: documents holding each token; token -1 counts documents, -2 tokens."""
    df, docs, total = np.zeros(VOCABULARY, np.int64), 0, 0
    for b in in_parts(batches, 4096):
        _, token, n = distinct_tokens(b.column(0).to_pylist())
        df += np.bincount(token, minlength=VOCABULARY)
        docs, total = docs + b.num_rows, total + int(n.sum())
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, [-1, -2]), pa.int64()), pa.array(np.append(df[at], [docs, total]), pa.int64())],
        ["token", "n"])


def distinct_tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, token, count) of the distinct tokens of each of at most 65,536 id strings, in order; one sort for all."""
    pairs = np.repeat(np.arange(len(raws), dtype=np.uint32) << np.uint32(16), np.fromiter(map(len, raws), int, len(raws)) // 2)
    pairs |= np.frombuffer(b"".join(raws), "<u2")
    pairs.sort()
    first = np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))
    found = pairs[first]
    return found >> np.uint32(16), found & np.uint32(0xFFFF), np.diff(first, append=len(pairs))


def telling(idf):
    """Adds the token of the highest tf-idf weight to (id, ids, crc, ...); ties go to the smaller token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = idf.value
        for b in batches:
            if not b.num_rows:
                continue
            doc, token, n = distinct_tokens(b.column(1).to_pylist())
            weight = w[token] * np.log1p(n)
            most = np.maximum.reduceat(weight, np.flatnonzero(np.diff(doc, prepend=~doc[:1])))
            at = np.flatnonzero(weight == most[doc])
            best = token[at[np.unique(doc[at], return_index=True)[1]]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(best), *b.columns[3:]],
                                             ["id", "ids", "crc", "best", *b.schema.names[3:]])

    return run


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ids, crc, best, spread) to (id, ids, place): the token in the upper 16 bits, the checksum, 16 bits of
    ``spread`` that part equal documents."""
    for b in batches:
        best, crc, spread = (b.column(i).to_numpy().astype(np.int64) for i in (3, 2, 4))
        place = (best << 48 | crc << 16 | spread & 0xFFFF) ^ np.int64(-1 << 63)
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(place)], ["id", "ids", "place"])


def sharded(cuts):
    """Adds the shard to (id, ids, place): the number of cuts at or below the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = np.searchsorted(cuts.value, b.column(2).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32())], ["id", "ids", "place", "shard"])

    return run


class Block:
    """Unused pieces of documents and their inverted index."""

    def __init__(self, items: list[tuple], idf: np.ndarray, mean: float):
        self.items = items  # (id, ids, start): ids[start:] is unused, shorter than a window
        self.terms, tf, of = [], [], []
        for lo in range(0, len(items), VOCABULARY):
            part = items[lo:lo + VOCABULARY]
            i, t, n = distinct_tokens([ids[start:].tobytes() for _, ids, start in part])
            long = np.array([len(ids) - start for _, ids, start in part])[i]
            tf.append(idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * long / mean)))
            of.append(i.astype(np.int64) + lo)
            self.terms += np.split(t, np.flatnonzero(np.diff(i)) + 1)
        terms = np.concatenate(self.terms)
        order = np.argsort(terms.astype(np.uint16), kind="stable")
        self.weight, self.of = np.concatenate(tf)[order], np.concatenate(of)[order]
        self.first = np.searchsorted(terms[order], np.arange(VOCABULARY + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents, best BM25 score for the seed's terms first."""
        lo, hi = self.first[self.terms[seed]], self.first[self.terms[seed] + 1]
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        score = np.bincount(self.of[at], self.weight[at], len(self.items))
        return np.argsort(-score, kind="stable")


def packer(window: int, idf, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 36
        rows: list[tuple] = []
        n_sequences = 0

        def emit(pieces: list[tuple]) -> None:
            nonlocal n_sequences
            offset = 0
            for key, ids, start, long in pieces:
                crc = zlib.crc32(ids[start:start + long].astype("<u4").tobytes())
                rows.append((key, start, long, crc, len(ids), base + n_sequences, offset))
                offset += long
            n_sequences += 1

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                cols = list(zip(*rows, strict=True))
                kinds = [key_type] + [pa.int64()] * 6
                rows.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        def pack(items: list[tuple]) -> list[tuple]:
            """Fills windows; returns the pieces of a window that could not be filled."""
            while items:
                block, unused = Block(items, idf.value, mean), len(items)
                start = [s for _, _, s in items]
                left = [len(ids) - s for _, ids, s in items]
                for seed in range(len(items)):
                    if 2 * unused < len(items):
                        break  # the index is built again of what is unused
                    while left[seed]:
                        pieces, room = [], window
                        for i in (seed, *block.neighbours(seed).tolist()):
                            if (take := min(left[i], room)) > 0:
                                pieces.append((items[i][0], items[i][1], start[i], take))
                                start[i], left[i], room = start[i] + take, left[i] - take, room - take
                                unused -= not left[i]
                                if not room:
                                    break
                        if room:
                            return pieces
                        emit(pieces)
                items = [(key, ids, s) for (key, ids, _), s, n in zip(items, start, left, strict=True) if n]
            return []

        items: list[tuple] = []
        open_: list[tuple] = []  # pieces of an unfilled window: (id, ids, start, length)
        size = 0
        key_type = pa.int64()
        for b in batches:
            key_type = b.column(0).type
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2")
                start = len(ids) // window * window
                for s in range(0, start, window):
                    emit([(key, ids, s, window)])
                if start < len(ids):
                    items.append((key, ids, start))
                    size += len(ids) - start
                if size >= BLOCK_TOKENS:
                    open_ = pack(items)
                    # the ends of documents cut by the last window begin the next block
                    items, size = [(k, i, s) for k, i, s, _ in open_], sum(n for *_, n in open_)
                if len(rows) >= 10_000:
                    yield from out()
        if items:
            pieces = pack(items)
            rest = sum(n for *_, n in pieces)
            while rest:  # powers of two need no padding
                take, rest = 1 << (rest.bit_length() - 1), rest - (1 << (rest.bit_length() - 1))
                part = []
                while take:
                    key, ids, start, n = pieces.pop(0)
                    part.append((key, ids, start, min(n, take)))
                    if n > take:
                        pieces.insert(0, (key, ids, start + take, n - take))
                    take -= min(n, take)
                emit(part)
        yield from out()

    return run


def pack_documents(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text",
                   window: int = 4096) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids are written once to the shared folder; the corpus statistics
    (at most one row per token) and the packing read them there.  One shuffle
    moves the ids to their shards, ranged over (telling token, checksum, hash of the key),
    so that a token or a text held by many documents is split over shards; rows are
    sorted in a shard, so a task that runs again packs the same way.
    """
    spark = df.sparkSession
    path = path or tokenizer_file()
    kind = df.schema[key].dataType.simpleString()
    whole = proved(spark, path)
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    ids = staged(spark, map_batches(rows, encoder(path, whole), f"id {kind}, ids binary, crc long", caches=True),
                 "token-ids", LARGE_BATCHES)
    counts = map_batches(ids.select("ids"), frequencies, "token long, n long")
    found = {r["token"]: r["n"] for r in counts.groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator()}
    docs, total = found.pop(-1, 0), found.pop(-2, 0)
    idf = np.zeros(VOCABULARY)
    for t, n in found.items():
        idf[t] = np.log1p((docs - n + 0.5) / (n + 0.5))
    idf = spark.sparkContext.broadcast(idf)
    # the shards' bounds come from a hash sample of bounded size; every document is dealt by them
    shards = min(MAX_SHARDS, total // SHARD_TOKENS + 1)
    spread = ids.select("id", "ids", "crc", F.xxhash64("id").alias("spread"))
    places = f"id {kind}, ids binary, place long"
    some = spread.limit(0)
    if shards > 1:
        some = spread.where(F.pmod(F.xxhash64("spread", "crc"), F.lit(docs)) < SAMPLED * shards)
    some = map_batches(some, lambda batches: placed(telling(idf)(batches)), places).select("place")
    some = np.sort(np.array([r["place"] for r in some.toLocalIterator()], np.int64))
    cuts = some[np.linspace(0, len(some) - 1, shards + 1).astype(int)[1:-1]] if len(some) else some
    cuts = spark.sparkContext.broadcast(cuts)
    dealt = map_batches(spread, lambda batches: sharded(cuts)(placed(telling(idf)(batches))), places + ", shard int")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("place", "id")
    pieces = map_batches(dealt.select("id", "ids"), 
        packer(window, idf, max(1.0, total / max(1, docs))),
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", key)
