from __future__ import annotations

import random
import re

import corpus_pipeline as C
from finledger.llm import decontaminate as D
from finledger.llm import jaccard as J
from finledger.llm import queries as Q
from tests.conftest import SF01, SF001
from tests.llm.test_tokens_packing import check_packing

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute(rows):
    """(id, text) -> {id: (set size, smallest id reachable)} over all pairs that share a shingle."""
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < k}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(k), find(j)))
                root[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert result(Q.op9_jaccard_join(spark, SF001)) == brute(rows)


def groups(seed=4):
    """Groups of near copies around the threshold, chains, copies, short and shared texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, k = [], 0
    shared = " ".join(word() for _ in range(40))
    for size in (60, 25, 6, 2):
        base = [word() for _ in range(rng.randrange(60, 140))]
        now = base
        for i in range(size):
            now = list(base if size != 6 else now)  # 6: a chain
            for _ in range(rng.randrange(0, 5)):
                now[rng.randrange(len(now))] = word()
            rows.append((k, " ".join(now)))
            k += 1
    for _ in range(40):
        rows.append((k, shared + " " + " ".join(word() for _ in range(rng.randrange(5, 60)))))
        k += 1
    for t in ["", None, " \t\n ", "one", "One", "two words", "a b c d", "a b c d", "a b c d e", "É é", "é é", "x " * 9000, "x " * 9001]:
        rows.append((k, t))
        k += 1
    rng.shuffle(rows)
    return rows


def test_groups_equal_brute_force_in_any_setting(spark, monkeypatch):
    rows = groups()
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, node int").repartition(5)
    want = brute(rows)
    assert result(J.join_documents(df)) == want
    assert result(J.join_documents(df, share=1, rounds=1)) == want  # many frequent shingles, no star round
    monkeypatch.setattr(J, "TILE", 4)
    assert result(J.join_documents(df, share=1, hot=3, rounds=1)) == want


def test_every_place_of_the_filter_is_fetched(spark, monkeypatch):
    # one text in eight stands at the filter's first place, 0
    monkeypatch.setattr(J, "FILTER_BITS", 8)
    rows = groups()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.join_documents(df)) == brute(rows)


def test_one_of_each_keeps_the_smallest_and_all_columns(spark):
    rows = groups(9)
    data = [(k, t, "q") for k, t in rows] + [(None, rows[0][1], "q"), (rows[3][0], rows[3][1], "q"), (None, "only here without id", "q")]
    df = spark.createDataFrame(data, "doc_id long, text string, __h string")
    df = df.withColumnRenamed("__h", "root")
    out = J.one_of_each(df)
    want = {c for _, c in brute(rows).values()}
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1
    assert out.columns == df.columns
    assert J.one_of_each(df.limit(0)).count() == 0 and J.join_documents(df.limit(0)).count() == 0


def test_pipeline_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    kept = docs
    out = {}
    for name, stage in C.STAGES:
        before = kept
        kept = stage(spark, before, SF01)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        out[name] = kept
        if name != "packing":
            assert kept.dtypes == docs.dtypes
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= ids
        if name == "line_dedup":
            assert after == ids
        if name == "jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            by = brute([x for x in rows if x[1]])
            assert after == {c for _, c in by.values()} | {k for k, t in rows if not t}
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF01}/benchmark.parquet")
            left = D.digests(D.report(kept, bench)).where("contaminated").count()
            assert left == 0 and D.digests(D.report(before, bench)).where("contaminated").count() > 0
        if name == "packing":
            assert check_packing(kept.collect(), {r.doc_id: r.text for r in before.collect()}, 4096) == 0
