"""Nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Largest inner product is turned into smallest distance by one more coordinate:
x becomes (x / M, sqrt(1 - |x|^2 / M^2)) for the largest norm M, a query becomes
(q / |q|, 0).  Vectors are projected to ``dims`` Gaussian (2-stable) coordinates;
a squared projected distance over the squared true one is then chi-square
distributed.  A kd-tree indexes the projected points: its upper splits (fitted
on a bounded sample) deal the points to cells, and each cell has a tree of
leaves.  A query looks at leaves by growing projected distance, verifies their
vectors exactly, and stops when the test says that a vector nearer than its k-th
would, with probability ``sure``, have been seen.  The first round searches the
query's own cell; the second sends it, with the distance found, to those other
cells that the test does not exclude.

Equal vectors are interchangeable but for their ids: candidates are the k + 1
smallest ids of each distinct vector (a window limited before its shuffle) and
queries are searched once per distinct vector, so a vector that a third of
the rows share costs as much as any other.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, rows without id, and vectors whose length is not the most common one
take no part; ties go to the smaller id; fewer candidates than k give fewer
rows; a repeated id is one candidate per row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, ship, smallest_hashes, staged

LEAF = 64
MAX_CELLS = 1 << 16


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    h = np.asarray(x, float) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, dims // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def reach(sure: float, dims: int) -> float:
    """The ratio of squared distances at which the test stops: the chi-square quantile of ``sure``."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < sure else (lo, mid)
    return hi


class Splits:
    """The upper kd-tree: 2^depth cells by medians of a sample, the widest coordinate first."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, int)
        self.at = np.zeros((1 << depth) - 1)
        stack = [(0, sample)]
        while stack:
            node, pts = stack.pop()
            if node >= len(self.axis):
                continue
            if len(pts):
                self.axis[node] = a = int(np.argmax(pts.max(0) - pts.min(0)))
                self.at[node] = m = float(np.median(pts[:, a]))
                right = pts[:, a] > m
                stack += [(2 * node + 1, pts[~right]), (2 * node + 2, pts[right])]

    def cells(self, pts: np.ndarray) -> np.ndarray:
        node = np.zeros(len(pts), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (pts[np.arange(len(pts)), self.axis[node]] > self.at[node])
        return node - len(self.axis)


def leaves(pts: np.ndarray) -> list[np.ndarray]:
    """Row numbers of a cell's kd-tree leaves."""
    out, stack = [], [np.arange(len(pts))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        p = pts[rows]
        order = np.argsort(p[:, int(np.argmax(p.max(0) - p.min(0)))], kind="stable")
        stack += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def outside(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of each query from each box."""
    d = np.zeros((len(q), len(low)))
    for a in range(q.shape[1]):
        c = q[:, a:a + 1]
        d += np.maximum(0, np.maximum(low[:, a] - c, c - high[:, a])) ** 2
    return d


def matrix(col, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), float).reshape(-1, width)


def search(x: np.ndarray, ids: np.ndarray, px: np.ndarray, q: np.ndarray, pq: np.ndarray, top: float,
           bound: np.ndarray, k: int, quantile: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best ids and scores in one cell for each query; ``bound``: squared k-th distance known so far."""
    rows = leaves(px)
    low, high = np.array([px[r].min(0) for r in rows]), np.array([px[r].max(0) for r in rows])
    far = outside(pq, low, high)
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    norm = np.linalg.norm(q, axis=1)
    best = np.full((len(q), k), -np.inf)
    seen: list[list[np.ndarray]] = [[] for _ in q]
    live = np.arange(len(q))
    for r in range(len(rows)):
        kth = best[live].min(1)
        near = np.where(np.isfinite(kth), np.maximum(0, 2 - 2 * kth / (norm[live] * top)), np.inf)
        live = live[far[live, r] <= quantile * np.minimum(near, bound[live]) + 1e-12]
        if not len(live):
            break
        leaf_of = order[live, r]
        for leaf in np.unique(leaf_of):
            who, pts = live[leaf_of == leaf], rows[leaf]
            s = q[who] @ x[pts].T
            least = best[who].min(1, keepdims=True)
            for i, (w, ok) in enumerate(zip(who.tolist(), s >= least - 1e-9 * np.abs(least), strict=True)):
                if ok.any():
                    seen[w].append(pts[ok])
                    both = np.concatenate([best[w], s[i][ok]])
                    best[w] = np.partition(both, len(both) - k)[len(both) - k:]
    found = []
    for w, parts in enumerate(seen):
        at = np.concatenate(parts) if parts else np.zeros(0, int)
        s = (x[at] * q[w]).sum(1)  # row by row, so that equal vectors score equally
        pick = np.lexsort((ids[at], -s))[:k]
        found.append((ids[at][pick], s[pick]))
    return found


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, dims: int = 8,
            sure: float = 0.95, sample: int = 100_000, cell_rows: int = 4096, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose key is divisible by ``every``."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(
        F.count(F.lit(1)).alias("c"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"))
    width = lengths.orderBy(F.desc("c"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    n, count, top = width["n"], width["c"], math.sqrt(width["m"])
    rows = rows.where(F.size("v") == n)

    first = Window.partitionBy("v").orderBy("id")
    candidates = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).drop("rn")
    asked = rows.where(F.col("id") % every == 0)
    distinct = asked.groupBy("v").agg(F.min("id").alias("gid"))
    members = asked.join(distinct, "v").select(F.col("id").alias("query_id"), "gid")

    gauss = np.random.default_rng(seed).normal(size=(n + 1, dims))

    def projected(is_query: bool):
        def run(batches):
            for b in batches:
                col = b.column(1)
                x = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                if is_query:
                    p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ gauss[:n]
                else:
                    rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1) / (top * top)))
                    p = x @ gauss[:n] / top + rest[:, None] * gauss[n]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in p], pa.binary())],
                    ["id", "x", "p"])

        return run

    points = staged(spark, map_batches(candidates.select("id", "v"), projected(False), "id long, x binary, p binary"), "points")
    # the index is fitted on the smallest hashes: a bounded sample, alike at every size
    taken = smallest_hashes(points.select("id", "p"), ["id"], sample, count).select("p")
    pts = matrix([bytes(r["p"]) for r in taken.toLocalIterator()], dims)
    depth = max(0, math.ceil(math.log2(max(1, min(MAX_CELLS, count / cell_rows)))))
    tree = spark.sparkContext.broadcast(Splits(pts, depth))

    def dealt(batches):
        for b in batches:
            cell = tree.value.cells(matrix(b.column(2).to_pylist(), dims)) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], ["id", "x", "p", "cell"])

    schema4 = "id long, x binary, p binary, cell int"
    points = map_batches(points, dealt, schema4)
    queries = map_batches(distinct.select("gid", "v"), projected(True), "id long, x binary, p binary")
    queries = staged(spark, map_batches(queries, dealt, schema4), "vector-queries")
    quantile = reach(sure, dims)

    def boxed(batches):
        low = np.full((1 << depth, dims), np.inf)
        high = -low
        for b in batches:
            p, c = matrix(b.column(2).to_pylist(), dims), b.column(3).to_numpy()
            np.minimum.at(low, c, p)
            np.maximum.at(high, c, p)
        at = np.flatnonzero(np.isfinite(low[:, 0]))
        for lo in range(0, len(at), 10_000):
            part = at[lo:lo + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(list(low[part])), pa.array(list(high[part]))], ["cell", "low", "high"])

    boxes = map_batches(points, boxed, "cell int, low array<double>, high array<double>")
    low, high = np.full((1 << depth, dims), np.inf), np.full((1 << depth, dims), -np.inf)
    mins = boxes.groupBy("cell").agg(*[F.min(F.col("low")[a]).alias(f"l{a}") for a in range(dims)],
                                     *[F.max(F.col("high")[a]).alias(f"h{a}") for a in range(dims)])
    for r in mins.toLocalIterator():  # at most MAX_CELLS rows
        low[r["cell"]], high[r["cell"]] = [r[f"l{a}"] for a in range(dims)], [r[f"h{a}"] for a in range(dims)]
    boxes = spark.sparkContext.broadcast((low, high))

    def found_in(cell, q, c):
        import pandas as pd  # on the executors only: the driver needs none of it

        if not len(q):
            return pd.DataFrame({"gid": [], "ids": [], "scores": [], "bound": []}, dtype=object)
        qx = matrix(q["x"], n)
        got = search(matrix(c["x"], n), c["id"].to_numpy(), matrix(c["p"], dims), qx, matrix(q["p"], dims), top,
                     q["bound"].to_numpy(float), k + 1, quantile) if len(c) else [(np.zeros(0, int), np.zeros(0))] * len(q)
        norm = np.linalg.norm(qx, axis=1) * top
        near = [max(0.0, 2 - 2 * s[k] / m) if len(s) > k else math.inf for (_, s), m in zip(got, norm, strict=True)]
        return pd.DataFrame({"gid": q["id"], "ids": [i for i, _ in got], "scores": [s for _, s in got],
                             "bound": np.minimum(near, q["bound"])})

    out_schema = "gid long, ids array<long>, scores array<double>, bound double"
    by_cell = lambda a, b: a.groupBy("cell").cogroup(b.groupBy("cell")).applyInPandas(found_in, out_schema)
    home = staged(spark, by_cell(queries.withColumn("bound", F.lit(float("inf"))), points), "home-cells")

    def routed(batches):
        lo, hi = boxes.value
        for b in batches:
            p, own = matrix(b.column(2).to_pylist(), dims), b.column(3).to_numpy()
            bound = b.column(4).to_numpy()
            for i in range(0, len(p), 256):
                d = outside(p[i:i + 256], lo, hi)
                d[np.arange(len(d)), own[i:i + 256]] = np.inf
                with np.errstate(invalid="ignore"):
                    r, c = np.nonzero(np.isfinite(d) & (d <= quantile * bound[i:i + 256, None]))
                at = pa.array(r + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(c, pa.int32()), b.column(4).take(at)],
                    ["id", "x", "p", "cell", "bound"])

    again = queries.join(home.select(F.col("gid").alias("id"), "bound"), "id").select("id", "x", "p", "cell", "bound")
    again = map_batches(again, routed, "id long, x binary, p binary, cell int, bound double")
    parts = home.select("gid", "ids", "scores").union(by_cell(again, points).select("gid", "ids", "scores"))
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda z: F.struct((-z["scores"]).alias("s"), z["ids"].alias("i")))
    # a query meets at most k + 1 rows from each cell that it visited
    merged = parts.groupBy("gid").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k + 1).alias("best"))
    own = members.join(merged, "gid")
    kept = F.slice(F.filter("best", lambda z: z["i"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(kept).alias("at", "z")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("z.i").alias("vec_id"), (-F.col("z.s")).alias("score"))
