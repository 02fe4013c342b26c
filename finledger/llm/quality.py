"""Quality classifier without gold labels: heuristic labellers, a label model, a hashed linear scorer.

Every document gets votes (good, bad, none) from overlapping heuristics.  Rows
with equal votes are counted together: at most 3^m patterns reach the driver,
whatever the corpus.  Expectation-maximisation on these counts estimates each
labeller's accuracy on either class and so a posterior for each pattern.  A
logistic scorer over hashed byte trigrams and word repeats then learns the posteriors of a bounded
sample and scores every document, also where no labeller votes.

Bounds: the scorer trains on the ``sample`` documents with the smallest hash of
key and text, up to ``longest`` bytes each; labellers and pattern counts read all rows.

Defined results: null texts count as empty; texts without any vote have the
model's prior as posterior; texts under 3 bytes score by the bias alone; equal
rows score equally; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, smallest_hashes, staged

BUCKETS = 1 << 16
GOOD, BAD, NONE = 1, 2, 0
# fixed values: frequent function words of English, German, French and Spanish
FUNCTION_WORDS = frozenset(w.encode() for w in (
    "the of and to in is that it for was with as der die und das den von zu mit sich des le la les de et un une en que "
    "du dans est el los las y del se por con para al su").split())
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_MARKS = b"#*$%&|{}<>=_^~\\@"


def votes(text: str) -> list[int]:
    """One vote of each labeller: share of letters, marks, capitals, digits, distinct words, function words, line ends, word length, words said twice in a row."""
    b = text.encode()
    n = max(1, len(b))
    ws = b.lower().split()
    k = max(1, len(ws))
    count = lambda chars: len(b) - len(b.translate(None, chars))
    letters, marks, capitals, digits = count(_LETTERS) / n, count(_MARKS) / n, count(_UPPER) / n, count(_DIGITS) / n
    lines = [x.rstrip() for x in b.split(b"\n") if x.strip()]
    ended = sum(x[-1:] in b".!?:;\"')" for x in lines) / max(1, len(lines))
    function = sum(map(FUNCTION_WORDS.__contains__, ws)) / k
    twice = sum(map(eq, ws, ws[1:])) / k
    long = sum(map(len, ws)) / k

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else NONE

    if not ws:
        return [BAD] + [NONE] * 8
    return [
        vote(letters < 0.6, letters > 0.75), vote(marks > 0.03, marks < 0.01), vote(capitals > 0.3, capitals < 0.1),
        vote(digits > 0.1, digits < 0.02), vote(k >= 20 and len(set(ws)) / k < 0.2, k >= 20 and len(set(ws)) / k > 0.4 or k > 500),
        vote(k >= 10 and function < 0.04, function > 0.12), vote(k >= 10 and ended < 0.4, ended > 0.8),
        vote(long > 14 or long < 2, 3 < long < 9), vote(k >= 10 and twice > 0.2, k >= 10 and twice < 0.02),
    ]


def code(vs: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(vs))


N_LABELLERS = 9


def pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [code(votes(t or "")) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:1], pa.array(got, pa.int32())], ["id", "pattern"])


def label_model(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good for each pattern, p(vote | class) as [labeller, class, vote], prior of good.

    Starts from the majority vote, so that class 1 is the one most labellers call good.
    """
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes], float)
    v = codes[:, None] // 3 ** np.arange(N_LABELLERS) % 3 if len(codes) else np.zeros((0, N_LABELLERS), int)
    post = np.clip(0.5 + ((v == GOOD).sum(1) - 2.0 * (v == BAD).sum(1)) / 8, 0.02, 0.98)
    prior, table = 0.5, np.full((N_LABELLERS, 2, 3), 1 / 3)
    for _ in range(rounds):
        w = np.stack([(1 - post) * n, post * n])
        prior = float((w[1].sum() + 1) / (n.sum() + 2))
        table = np.array([[[w[c][v[:, j] == x].sum() + 1 for x in range(3)] for c in (0, 1)] for j in range(N_LABELLERS)])
        table = table / table.sum(2, keepdims=True)
        log = np.log(table)
        z = np.log(prior / (1 - prior)) + sum(log[j, 1, v[:, j]] - log[j, 0, v[:, j]] for j in range(N_LABELLERS))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = len(new) == 0 or np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return dict(zip(codes.tolist(), post.tolist(), strict=True)), table, prior


def buckets(text: str) -> np.ndarray:
    """The hash of every byte trigram, and bucket 0 for each trigram's share of words said twice in a row."""
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    ws = raw.split()
    twice = sum(map(eq, ws, ws[1:])) * len(b) // len(ws) if ws else 0
    h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    return np.concatenate([h, np.zeros(twice, np.uint32)])


def learn(texts: list[str], target: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic weights on trigram shares (scaled), by full-batch Adam; bias apart."""
    idx, val, row = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0, int)]
    for i, t in enumerate(texts):
        u, c = np.unique(buckets(t), return_counts=True)
        idx.append(u)
        val.append(c / max(1, c.sum()) * 100)
        row.append(np.full(len(u), i))
    i, v, r = np.concatenate(idx), np.concatenate(val), np.concatenate(row)
    w, bias = np.zeros(BUCKETS), 0.0
    m, s = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, steps + 1 if texts else 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[i] * v, len(texts)) + bias, -30, 30)))
        g = (p - target) / len(texts)
        grad = np.append(np.bincount(i, g[r] * v, BUCKETS) + decay * w, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = sent.value
        for b in batches:
            z = []
            for t in b.column(1).to_pylist():
                h = buckets(t or "")
                z.append(float(w[h].sum() / max(1, len(h)) * 100 + bias))
            s = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])

    return run


def classify(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 6000, longest: int = 32768) -> DataFrame:
    """key, score (0 to 1, higher: better text), keep (score >= 0.5) for every row."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    counts = map_batches(rows, pattern, f"id {kind}, pattern int").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    found = {r["pattern"]: r["n"] for r in counts.toLocalIterator()}  # at most 3^9 rows
    posterior, _, _ = label_model(found)
    short = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) <= longest)
    picked = smallest_hashes(short, ["id", "text"], sample, sum(found.values()))
    texts = [r["text"] or "" for r in staged(spark, picked, "quality-sample").orderBy(F.xxhash64("id", "text"), "id").toLocalIterator()]
    target = np.array([posterior.get(code(votes(t)), 0.5) for t in texts])
    sent = spark.sparkContext.broadcast(learn(texts, target))
    out = map_batches(rows, scorer(sent), f"id {kind}, score double").withColumnRenamed("id", key)
    return out.select(key, "score", (F.col("score") >= 0.5).alias("keep"))
