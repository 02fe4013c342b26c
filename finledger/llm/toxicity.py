"""Toxicity by compression distance: one zstandard dictionary per class, compared window by window.

Two dictionaries are trained on separate texts: the ordinary one on whole
ordinary documents, the toxic one on what toxic documents say more often than
ordinary ones do: words, and runs of words covered by phrases of two to four
words.  (Trained on whole toxic texts it is mostly ordinary language and the
lengths tell little; README has the figures.)  A window is one word or four words
in a row, with padded ends, between two fixed pieces of ordinary text; its value
is the bytes that the toxic dictionary saves over the ordinary one (both hold the
ordinary content at the same distance, so that only toxic content can differ).
A window of four words can save more than its words only if two of them stand
side by side in the toxic dictionary, so only those are compressed.  A document
is described by how many of its windows save 2, 3, 4, 5, 6 or 8 bytes; a logistic
model on labelled documents that trained no dictionary calibrates these counts.
Every word of every text is scored; equal windows are compressed once for each
worker's bounded cache.

Bounds: at most ``per_class`` documents of each class and ``longest`` bytes
each train anything; they are the labelled rows with the smallest hash, whatever
the size of the corpus.  The toxic dictionary holds at most ``toxic_bytes`` of
words and as many of phrases, the ordinary one ``ordinary_bytes``.  A word counts as toxic from 3 sampled toxic
documents on, a phrase from 2 in 100 on, where it is 8 times as frequent as in
the ordinary ones.

Defined results: null and empty texts have no window and get the model's score
for none; without labels of both classes every score is the share of toxic
labels (0 without labels); a document labelled more than once counts as toxic if
any label says so; repeated rows are scored one by one.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import forget, in_parts, kept, map_batches, ship, smallest_hashes

PAD = b"   "
#: letters of a word: everything but ASCII blanks and punctuation
_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
STEPS = (2, 3, 4, 5, 6, 8)
CACHED_WORDS = 300_000
LONGEST_CACHED = 64
PHRASE = 4
SMALLEST = 1 << 15  # the library finds nothing in contents of a few KB: blanks before them fill up
FEATURES = 3 * len(STEPS)


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPLIT).split()


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes  # words
    phrases: bytes
    weights: np.ndarray  # bias, then one per feature
    shift: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        self._saved: dict[bytes, int] = {}
        ws = self.phrases.split(PAD)
        self.pairs = {(x, y) for x, y in zip(ws, ws[1:], strict=False) if x and y}

    def _compressors(self, **search):
        # no entropy tables and no frame data: only matches can differ; matches of 7 bytes and more
        p = zs.ZstdCompressionParameters.from_level(
            3, min_match=7, hash_log=17, chain_log=17, window_log=18,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS, **search)
        raw = [zs.ZstdCompressionDict(b.rjust(SMALLEST), dict_type=zs.DICT_TYPE_RAWCONTENT)
               for b in (self.ordinary, self.phrases + self.toxic + self.ordinary)]
        return [zs.ZstdCompressor(dict_data=d, compression_params=p).compress for d in raw]

    def saved(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves on the window of a word or of words with padding between them."""
        if (v := self._saved.get(word)) is None:
            if not hasattr(self, "_both"):
                # common words have many matches: a phrase's long one is looked for among all of them
                self._both = [self._compressors(strategy=zs.STRATEGY_GREEDY),
                              self._compressors(strategy=zs.STRATEGY_LAZY2, search_log=10)]
            n = len(self.ordinary)
            window = self.ordinary[n - 400:n - 336] + PAD + word + PAD + self.ordinary[n - 200:n - 150]
            plain, toxic = self._both[PAD in word]
            v = len(plain(window)) - len(toxic(window))
            if len(word) <= LONGEST_CACHED:
                if len(self._saved) > CACHED_WORDS:
                    self._saved.clear()
                self._saved[word] = v
        return v

    def features(self, ws: list[bytes]) -> list[float]:
        got = [v for w in ws if (v := self.saved(w)) >= STEPS[0]]
        n = [sum(v >= s for v in got) for s in STEPS]
        both = [self.saved(PAD.join(ws[i:i + PHRASE])) for i, p in enumerate(zip(ws, ws[1:], strict=False)) if p in self.pairs]
        return [*np.log1p(n), *(np.sqrt(x / max(1, len(ws))) for x in n), *np.log1p([sum(v >= s for v in both) for s in STEPS])]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - self.shift) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_both"} | {"_saved": {}}


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """A dictionary's content; of too few samples to train on, their own text."""
    try:
        return zs.train_dictionary(size, samples, k=k, d=8).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's steps with a ridge on all weights but the bias."""
    x = np.column_stack([np.ones(len(x)), x])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + keep, x.T @ (w * (y - p)) - keep @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def telling(first: dict[int, list[list[bytes]]], least: dict[int, int]) -> dict[int, set[tuple[bytes, ...]]]:
    """Runs of n words of at least ``least[n]`` toxic documents that are 8 times as frequent there, for each n.

    A run is counted only where the runs one word shorter inside it are frequent
    enough, so that few are held.
    """
    found, common = {}, None
    for n in sorted(least):
        def grams(ws: list[bytes], n=n, common=common) -> set[tuple[bytes, ...]]:
            every = set(zip(*(ws[i:] for i in range(n)), strict=False))
            return every if common is None else {g for g in every if g[:-1] in common and g[1:] in common}

        toxic = Counter(g for ws in first[1] for g in grams(ws))
        toxic = {g: k for g, k in toxic.items() if k >= least[n]}
        ordinary = Counter(g for ws in first[0] for g in grams(ws) if g in toxic)
        found[n] = {g for g, k in toxic.items() if k * len(first[0]) > 8 * ordinary[g] * len(first[1])}
        common = toxic
    return found


def said(ws: list[bytes], more: dict[int, set]) -> tuple[bytes, bytes]:
    """The document's toxic words, once each, and its runs of words that toxic phrases cover."""
    covered = np.zeros(len(ws), bool)
    for n in range(2, PHRASE + 1):
        for i in range(len(ws) - n + 1):
            if tuple(ws[i:i + n]) in more[n]:
                covered[i:i + n] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    runs = dict.fromkeys(PAD.join(ws[x:y]) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return tuple(PAD.join([b"", *found, b""]) for found in (dict.fromkeys(w for w in ws if (w,) in more[1]), runs))


def train(rows: list[tuple[str, int]], share: float, toxic_bytes: int = 3072, ordinary_bytes: int = 65536) -> Model:
    """``rows``: (text, label) in a fixed order; ``share``: of toxic labels in the whole table."""
    split = {c: list(dict.fromkeys(t for t, y in rows if y == c)) for c in (0, 1)}
    one: dict[bytes, bytes] = {}  # equal words are held once
    first = {c: [[one.setdefault(w, w) for w in words(t)] for t in ts[: (len(ts) + 1) * 3 // 5]] for c, ts in split.items()}
    rest = [(t, c) for c, ts in split.items() for t in ts[(len(ts) + 1) * 3 // 5:]]
    flat = Model(b" " * 512, b"", b"", np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES))
    flat.weights[0] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    if not first[0] or not first[1] or len({c for _, c in rest}) < 2:
        return flat
    more = telling(first, {n: 3 if n == 1 else max(3, len(first[1]) // 50) for n in range(1, PHRASE + 1)})
    if not any(more.values()):
        return flat
    toxic = [said(ws, more) for ws in first[1]]
    ordinary = [PAD + PAD.join(ws) + PAD for ws in first[0]]
    # words in short pieces, phrases in pieces that hold them whole
    m = Model(_trained(ordinary, ordinary_bytes, 64).rjust(512), _trained([s for s, _ in toxic if len(s) > 12], toxic_bytes, 12),
              _trained([s for _, s in toxic if len(s) > 12], toxic_bytes, 96), flat.weights, flat.shift, flat.scale)
    x = np.array([m.features(words(t)) for t, _ in rest])
    y = np.array([c for _, c in rest], float)
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    m.shift, m.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    m.weights = _logistic((x - m.shift) / m.scale, y, w)
    return m


def remainder(key: str) -> Column:
    """crc32 of the key as text, modulo 5; 0 is held out. A null key counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = 2500, longest: int = 65536) -> Model:
    """Trains on the labelled documents that are not held out."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(key) != 0))
    marked = marked.groupBy(F.col(key).alias("__k")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("y"))
    n = marked.agg(F.sum("y").alias("t"), F.count("y").alias("n")).first()
    share = (n["t"] or 0) / n["n"] if n["n"] else 0.0
    sample = None
    for c in (0, 1):
        # bounded: the smallest hashes of a class; texts join afterwards
        of = (n["t"] or 0) if c else n["n"] - (n["t"] or 0)
        ids = smallest_hashes(marked.where(F.col("y") == c).select("__k"), ["__k"], per_class, of)
        body = docs.select(F.col(key).alias("__k"), F.col(text).cast("string").alias("t"))
        body = body.where(F.octet_length("t").between(1, longest))
        got = body.join(F.broadcast(ids), "__k").groupBy("__k").agg(F.min("t").alias("t"))
        got = got.select(F.lit(c).alias("y"), F.xxhash64("__k").alias("o"), F.col("__k").cast("string").alias("k"), "t")
        sample = got if sample is None else sample.union(got)
    # the sample is trained on in one task, so that its words never fill the driver
    ship(docs.sparkSession)
    found = sample.groupBy(F.lit(0).alias("all")).applyInArrow(trainer(share), "model binary").first()
    return train([], share) if found is None else pickle.loads(found["model"])


def trainer(share: float):
    def run(table: pa.Table) -> pa.Table:
        forget()
        table = table.sort_by([("y", "ascending"), ("o", "ascending"), ("k", "ascending")])
        rows = list(zip(table["t"].to_pylist(), table["y"].to_pylist(), strict=True))
        return pa.table({"model": pa.array([pickle.dumps(train(rows, share))], pa.binary())})

    return run


def with_cache(model, name: str):
    """The broadcast model, its word cache that of the worker process."""
    m = model.value
    m._saved = kept(("toxicity", name), dict)
    return m


def scorer(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = with_cache(model, name)
        for b in batches:
            x = np.array([m.features(words(t)) for t in b.column(1).to_pylist()]).reshape(-1, FEATURES)
            s = m.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])
        m._saved = {}  # only the worker's cache holds on to the words

    return run


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every row of ``df``. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    out = map_batches(rows, scorer(sent, uuid4().hex), f"id {kind}, score double", caches=True)
    out = out.withColumnRenamed("id", key)
    return out.select(key, (remainder(key) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def marker(model, name: str, at: int, width: int):
    """The first ``width`` columns of the rows that are not toxic; ``at``: the place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = with_cache(model, name)
        for b in in_parts(batches):
            x = np.array([m.features(words(t)) for t in b.column(at).to_pylist()]).reshape(-1, FEATURES)
            yield b.select(range(width)).filter(pa.array(m.score(x) < 0.5, pa.bool_()))
        m._saved = {}

    return run


def drop_toxic(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the model does not call toxic, with all their columns. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    # a text that is a string already is sent once
    own = [i for i, f in enumerate(df.schema) if f.name == text and isinstance(f.dataType, StringType)]
    rows = df if own else df.withColumn("__text", F.col(text).cast("string"))
    run = marker(sent, uuid4().hex, own[0] if own else len(df.columns), len(df.columns))
    return map_batches(rows, run, df.schema, caches=True)
