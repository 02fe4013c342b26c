"""Alignment of two tokenizers over a corpus by merge-path partitioning, with counts of linked id pairs.

Both tokenizers cut the same bytes, so their tokens' ends are two ascending
lists; ends in both lists cut the tokens into groups, and the two tokens that
end there are linked.

1.  A task joins the end lists of a run of texts into one pair of lists (texts
    end in both).  The merge of the two lists is a path through their grid; its
    crossings with every ``PIECE``-th diagonal, found by binary search on all
    diagonals at once, cut it into pieces of equal work that need nothing from
    each other: a long text becomes many pieces, many short texts share one.
    A piece emits the ends it finds in both of its slices; an end whose two
    tokens lie on either side of a diagonal is found by stitching neighbours.
2.  Pair counts: every task counts its links' pairs in bounded memory, one
    shuffle adds them up.  The highest count of each B id is one row per B id.
3.  A second pass over the stored links looks counts up.  The ``head`` most
    frequent pairs are broadcast; pairs beyond them are joined with the table of
    all counts, so a vocabulary product of any size works.  Frequent pairs are all
    in the broadcast, so the join has no hot key.

Defined results: texts that are null or empty, or whose tokens' joined bytes
differ from a space and the text, have no tokens: zeros and empty groups; special
strings inside texts are plain text; repeated rows count one by one; an empty
table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_batches, staged
from .tokens import byte_letters, load, tokenizer_file

PIECE = 1 << 16
PART_CHARS = 1_000_000
LINKS_AT_ONCE = 1 << 22
HELD_PAIRS = 1 << 20
HEAD = 1 << 18
IDS = 1 << 16  # a pair is one unsigned 32-bit number: A id * 65,536 + B id


# --- merge path ---------------------------------------------------------------------------
def crossings(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two ascending lists crosses every ``step``-th diagonal; equal values come from ``a`` first."""
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        # before the diagonal: a[mid] if it is not above the last b that the path would otherwise hold
        below = np.zeros(len(d), bool)
        below[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo, d - lo


def meets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that stand in both slices of one piece."""
    at = np.searchsorted(b, a)
    same = np.flatnonzero(at < len(b))
    same = same[b[at[same]] == a[same]]
    return same, at[same]


def shared_ends(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of their common values, ascending, piece by piece."""
    i, j = crossings(a, b, step)
    out_a, out_b = [], []
    for i0, i1, j0, j1 in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True):
        # stitched: the last of a before the diagonal may meet the first of b behind it
        if i0 and j0 < len(b) and a[i0 - 1] == b[j0]:
            out_a.append(np.array([i0 - 1]))
            out_b.append(np.array([j0]))
        x, y = meets(a[i0:i1], b[j0:j1])
        out_a.append(x + i0)
        out_b.append(y + j0)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


# --- tokenizers -----------------------------------------------------------------------------
class Pair:
    """Both tokenizers, their tokens' bytes and the decimal ids with each separator."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        to_byte = {c: b for b, c in byte_letters().items()}
        tok = load(a_path)
        special = set(tok.get_added_tokens_decoder())
        ranks = {bytes(map(to_byte.__getitem__, p)): i for p, i in tok.get_vocab(with_added_tokens=False).items()
                 if i not in special}
        # the same vocabulary; ids are merge ranks (tests compare with the file's own library)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = {i: p for p, i in ranks.items()}
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        top = max(max(self.a_bytes) + 1, len(self.b_bytes))
        if top > IDS:
            raise ValueError("ids must lie below 65,536")
        self.a_long = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, p in self.a_bytes.items():
            self.a_long[i] = len(p)
        self.b_long = np.array([len(p) for p in self.b_bytes], np.int64)
        self.written = [f"{i}{sep}" for sep in ",|;" for i in range(top)]
        self.top = top

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A of a space and the text, by B of the text; none where the joined bytes differ."""
        a, b = [self.a.encode_ordinary(" " + t) if t else [] for t in texts], self.b.encode(texts, num_threads=1)
        for k, t in enumerate(texts):
            want = (" " + t).encode()
            if not t or b"".join(map(self.a_bytes.__getitem__, a[k])) != want or b"".join(
                    map(self.b_bytes.__getitem__, b[k])) != want:
                a[k], b[k] = [], []
        return a, b

    def aligned(self, texts: list[str]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        """Per text: number of A and B tokens, its groups as text, its links' pairs in order."""
        a, b = self.encode(texts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        fa, fb = (np.fromiter((i for x in side for i in x), np.int64, n.sum()) for side, n in ((a, n_a), (b, n_b)))
        la, lb = shared_ends(np.cumsum(self.a_long[fa]), np.cumsum(self.b_long[fb]))
        # group of a token: the links before it; a group's A tokens come first, then its B tokens
        ga, gb = np.searchsorted(la, np.arange(len(fa))), np.searchsorted(lb, np.arange(len(fb)))
        sep_a, sep_b = np.zeros(len(fa), np.int64), np.zeros(len(fb), np.int64)
        sep_a[la], sep_b[lb] = 1, 2
        codes = np.empty(len(fa) + len(fb), np.int64)
        codes[np.arange(len(fa)) + np.append(0, lb + 1)[ga]] = fa + self.top * sep_a
        codes[np.arange(len(fb)) + np.append(la + 1, 0)[gb]] = fb + self.top * sep_b
        pairs = (fa[la] * IDS + fb[lb]).astype("<u4")
        ends = np.cumsum(n_a)
        first = np.append(0, np.searchsorted(la, ends)).tolist()
        at = np.append(0, ends + np.cumsum(n_b)).tolist()
        write = self.written.__getitem__
        for k in range(len(texts)):
            groups = "".join(map(write, codes[at[k]:at[k + 1]].tolist()))
            yield int(n_a[k]), int(n_b[k]), groups[:-1], pairs[first[k]:first[k + 1]]


def parts(texts: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < PART_CHARS):
            size += len(texts[stop])
            stop += 1
        yield texts[at:stop]
        at = stop


def aligner(a_path: str, b_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = kept(("alignment", a_path, b_path, pattern), lambda: Pair(a_path, b_path, pattern))
        for b in batches:
            at = 0
            for part in parts([t or "" for t in b.column(2).to_pylist()]):
                n_a, n_b, groups, links = zip(*pair.aligned(part), strict=True)
                here = b.slice(at, len(part))
                yield pa.RecordBatch.from_arrays(
                    [here.column(0), here.column(1), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                     pa.array([len(x) for x in links], pa.int64()), pa.array(groups, pa.string()),
                     pa.array([x.tobytes() for x in links], pa.binary())],
                    ["row", "id", "n_a", "n_b", "n_groups", "groups", "links"])
                at += len(part)

    return run


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, pattern: str | None = None,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``), links (pairs as little-endian 32-bit numbers)."""
    import public_tokenizers

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    run = aligner(a_path or tokenizer_file("byte_bpe_50k.json"), b_path or tokenizer_file("piece_bpe_32k.model"),
                  pattern or public_tokenizers.PATTERN)
    return map_batches(rows, run, f"row long, id {kind}, n_a long, n_b long, n_groups long, groups string, links binary", caches=True)


# --- counts ---------------------------------------------------------------------------------
def _added(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(k, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def pair_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links' pairs of a task with their numbers, given out whenever many different ones are held."""
    keys, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    for b in batches:
        for x in b.column(0):
            waiting.append(np.frombuffer(x.as_buffer(), "<u4"))
            size += len(waiting[-1])
            if size >= LINKS_AT_ONCE:
                k, c = np.unique(np.concatenate(waiting), return_counts=True)
                keys, n = _added(np.concatenate([keys, k]), np.concatenate([n, c]))
                waiting, size = [], 0
                if len(keys) >= HELD_PAIRS:
                    yield out()
                    keys, n = keys[:0], n[:0]
    k, c = np.unique(np.concatenate([np.zeros(0, np.uint32), *waiting]), return_counts=True)
    keys, n = _added(np.concatenate([keys, k]), np.concatenate([n, c]))
    yield out()


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus hold it."""
    counts = map_batches(links.select("links"), pair_counter, "pair long, n long")
    return staged(links.sparkSession, counts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")


def head_of(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs above the least count that at most ``most`` pairs reach, ascending, and their counts."""
    least, total = 1, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).toLocalIterator():
        total += r["c"]
        if total > most:
            least = r["n"] + 1
            break
    head = counts.where(F.col("n") >= least).toArrow()
    pair, n = head["pair"].to_numpy(), head["n"].to_numpy()
    order = np.argsort(pair)
    return pair[order].astype(np.uint32), n[order].astype(np.int64)


def looker(head, best):
    """(row, links) to (row, n_best, count_sum, rest): the pairs beyond the head are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, n), top = head.value, best.value
        for b in batches:
            good, sums, rest = [], [], []
            for x in b.column(1):
                pairs = np.frombuffer(x.as_buffer(), "<u4")
                at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
                known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                c = n[at[known]]
                good.append(int((c == top[pairs[known] % IDS]).sum()))
                sums.append(int(c.sum()))
                rest.append(pairs[~known].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(good, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.int64()))],
                ["row", "n_best", "count_sum", "rest"])

    return run


def link_figures(links: DataFrame, head: int = HEAD) -> DataFrame:
    """row, n_best, count_sum for every row of ``links`` (row, links)."""
    spark = links.sparkSession
    counts = pair_counts(links)
    best = counts.groupBy(F.pmod("pair", F.lit(IDS)).alias("b")).agg(F.max("n").alias("top"))
    top = np.zeros(IDS, np.int64)  # one number per B id
    found = best.toArrow()
    top[found["b"].to_numpy()] = found["top"].to_numpy()
    send = spark.sparkContext.broadcast
    looked = map_batches(links.select("row", "links"), looker(send(head_of(counts, head)), send(top)),
                         "row long, n_best long, count_sum long, rest array<long>")
    looked = staged(spark, looked, "looked-up")
    rare = looked.select("row", F.explode("rest").alias("pair")).join(counts, "pair")
    rare = rare.withColumn("b", F.pmod("pair", F.lit(IDS))).join(F.broadcast(best), "b")  # at most one row per B id
    rare = rare.groupBy("row").agg(F.sum((F.col("n") == F.col("top")).cast("long")).alias("more_best"), F.sum("n").alias("more"))
    out = looked.select("row", "n_best", "count_sum").join(rare, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("row", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
                      (F.col("count_sum") + F.coalesce("more", zero)).alias("count_sum"))


def aligned_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD, **how) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    found = align(docs, key=key, text=text, **how)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    found = staged(docs.sparkSession, found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    figures = link_figures(found, head)
    out = found.drop("links").join(figures, "row")
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
                      "n_best", "count_sum", "groups_sha256")
