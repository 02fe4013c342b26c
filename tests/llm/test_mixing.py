from __future__ import annotations

import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from finledger.llm import mixing as M
from finledger.llm import queries as Q
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, source string, size string, target int, taken int, c int, __copy int"


def shared(sizes: dict, weights=(3, 1, 2), percent=150, most=2):
    """Targets by dealing the budget out and resharing what lies above the stop, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = Fraction(sum(sizes.values()) * percent, 100), dict.fromkeys(names, Fraction(0)), set(names)
    while left > 0 and open_:
        of = sum(w[s] for s in open_)
        for s in list(open_):
            target[s] += left * w[s] / of
        left = Fraction(0)
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = Fraction(most * sizes[s])
                open_.remove(s)
    return target


def check(out, docs, most=2, percent=150):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = shared(sizes, percent=percent, most=most)
    taken = defaultdict(int)
    for r, s in out:
        assert 0 <= r.taken <= most * r["size"]
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(want[s]), rel=1e-12)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_query_equals_sql_and_meets_its_targets(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF001}/documents.parquet'")
    out = Q.op13_pareto_mix(spark, SF001).collect()
    assert sorted(map(tuple, out)) == sorted(con.sql(M.SQL).fetchall())
    docs = con.sql("select doc_id, text, source from documents").fetchall()
    source = {d: s for d, _, s in docs}
    check([(r, source[r.doc_id]) for r in out], docs)
    assert sorted(map(tuple, out)) == sorted(map(tuple, Q.op13_pareto_mix(spark, SF001).collect()))  # reruns agree


def test_bins_change_nothing(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    results = [sorted(map(tuple, M.mix(docs, steps=n).collect())) for n in (1, 7, 100_000)]
    assert results[0] == results[1] == results[2]


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(i, "w " * (i % 17), ("a", "b", None, "")[i % 4], "x", 1, 2, 3, 4) for i in range(300)]
    rows += [(None, "one two", "hot", "x", 1, 2, 3, 4)] * 500 + [(7, None, "none", "x", 1, 2, 3, 4), (8, "", "none", "x", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = M.mix(df, copies_step=7).collect()
    assert len(out) == len(rows)
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    check([(r, source[r.doc_id, r["size"]]) for r in out], [r[:3] for r in rows])
    assert all(r.target == 0 == r.taken for r in out if r.doc_id in (7, 8) and r["size"] == 0 and r.source_size == 0)
    assert M.mix(df.limit(0)).count() == 0
    nothing = M.mix(df.where("source = 'none'")).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in nothing] == [(0, 0, 0.0, 0)] * 2


def test_whole_budgets_and_bounds(spark):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    assert {r.taken for r in M.mix(df, percent=200).collect()} == {6}
    assert {r.taken for r in M.mix(df, weights=(1,), percent=100).collect()} == {3}
    assert {r.taken for r in M.mix(df, percent=0).collect()} == {0}
    with pytest.raises(ValueError):
        M.mix(df, percent=201)


def test_inclusion_follows_the_rate(spark):
    """Documents of a source sampled at rate p enter about that often over many seeds."""
    df = spark.createDataFrame([(i, "a b c d", f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    seen = defaultdict(float)
    for k in range(12):
        for r in M.mix(df, most=1, percent=50, seed=str(k), steps=8).collect():
            seen[r.doc_id % 3] += r.taken / r["size"] / 12 / 20
    want = shared({"s0": 80, "s1": 80, "s2": 80}, percent=50, most=1)
    assert [seen[i] for i in range(3)] == pytest.approx([float(want[f"s{i}"]) / 80 for i in range(3)], abs=0.02)


def test_only_built_in_functions(spark):
    plan = M.mix(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Cartesian") == 0
    assert spark.range(3).select(M.uniform("s", F.col("id")).alias("u")).where("u > 0 and u < 1").count() == 3
