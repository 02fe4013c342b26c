from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from finledger.llm import decontaminate as D
from finledger.llm import linededup as L
from finledger.llm import queries as Q
from tests.conftest import SF001, SF01

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, width=10):
    ws = fold(text)
    hit, found = [False] * len(ws), set()
    for key, t in items:
        iw = fold(t)
        n = min(width, len(iw))
        for a in range(len(iw) - n + 1 if n else 0):
            for i in range(len(ws) - n + 1):
                if ws[i:i + n] == iw[a:a + n]:
                    hit[i:i + n] = [True] * n
                    found.add(str(key))
    ids = sorted(found)
    return len(ws), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), sum(hit) > 0


def rows(df):
    return sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_query_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    grams = {tuple(w[i:i + 10]) for _, t in items for w in [fold(t)] for i in range(max(1, len(w) - 9))}
    want = []
    for d in docs:
        ws = fold(d.text)
        some = any(tuple(ws[i:i + 10]) in grams for i in range(len(ws)))
        want.append(brute(d.text, items) if some else (len(ws), 0, 0, hashlib.sha256(b"").hexdigest(), False))
    out = Q.op4_decontamination(spark, SF001)
    assert rows(out) == sorted(want) and any(w[4] for w in want)


def test_automaton_equals_brute_force_on_small_alphabets():
    rng = random.Random(3)
    for n in range(400):
        width = rng.choice([1, 2, 3, 4])
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))) for i in range(rng.randrange(0, 5))]
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25)))
        auto = D.Automaton([(str(k), D.words(t)) for k, t in items], width)
        hit, found = auto.match(D.words(text))
        want = brute(text, items, width)
        assert (sum(hit), len(found)) == (want[1], want[2]), (items, text, width)
        assert D.digest({auto.ids[i] for i in found}) == want[3]


def test_report_in_chunks_nulls_clashes_and_empty(spark):
    items = [(1, "one two three four"), (2, "two three"), (3, None), (None, "x y"), (5, "one two three four"), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["ONE, two three four five", None, "", "x y z", "two three two three", "ONE, two three four five", "Ä " * 30000]
    docs = spark.createDataFrame([(7 if i in (0, 5) else i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    one = D.digests(D.report(docs, bench, width=3))
    many = D.digests(D.report(docs, bench, width=3, chunk_words=4))
    assert rows(one) == rows(many)
    known = [(k, t) for k, t in items if k is not None]
    got = {(r.doc_id, r.n_hit, r.n_items) for r in one.collect()}
    assert (7, 4, 3) in got and brute(texts[0], known, 3)[1:3] == (4, 3)
    assert (3, 2, 0) in got  # an item without id hits, but is not reported
    assert D.report(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    assert D.report(docs.limit(0), bench).count() == 0


def test_clean_cuts_spans_and_drops_covered_documents(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    text = "Keep this. A b, c d\ne f g h i J! and all of the other words stay here"
    docs = spark.createDataFrame([(1, text, "k"), (2, "a b c d e f g h i j", "k"), (3, None, "k"), (4, "", None)],
                                 "doc_id long, text string, __x string")
    out = {r.doc_id: r for r in D.clean(docs, bench).collect()}
    assert sorted(out) == [1, 3, 4] and out[1].text == "Keep this. ! and all of the other words stay here"
    assert out[3].text is None and out[1]["__x"] == "k"
    assert D.clean(docs, bench).columns == docs.columns


def test_site_lines_against_duckdb(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF01}/pages.parquet'")
    want = sorted(map(str, con.sql(f"SELECT page_id, host, n_lines, n_dropped, text FROM ({Q.ORACLE_SQL['op2_site_lines']})").fetchall()))
    out = Q.op2_site_lines(spark, SF01).select("page_id", "host", "n_lines", "n_dropped", "text")
    assert sorted(str(tuple(r)) for r in out.collect()) == want
    assert sum(r.n_dropped for r in out.collect()) > 0


def test_document_lines_by_brute_force(spark):
    rng = random.Random(1)
    data = [(i, "\n".join(["Top line "] + [f"l{rng.randrange(8)}" for _ in range(4)] + ["", f"own {i}"]), "s" if i % 3 else "t", i) for i in range(60)]
    data += [(None, "Top line\n x", None, 0), (70, None, "s", 0), (71, "", "s", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, __bad long")
    df = df.withColumnRenamed("__bad", "host")
    out = {r.doc_id: r.text for r in L.clean_documents(df, max_ratio=0.5).collect()}
    for s in ("s", "t"):
        pages = [t for _, t, h, _ in data if h == s]
        n = Counter(x for t in pages for x in {x.strip(" ") for x in (t or "").split("\n")} if x)
        bad = {x for x, c in n.items() if c >= 4 and c > 0.5 * len(pages)}
        assert "Top line" in bad
        for i, t, h, _ in data:
            if h == s and t is not None:
                assert out[i] == "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad)
    assert out[None] == "Top line\n x" and out[70] is None and out[71] == ""
    assert L.clean_documents(df.limit(0)).columns == df.columns


def test_spans_are_cut_a_few_rows_at_a_time():
    class Sent:
        value = D.Automaton([("a", [b"x%d" % i for i in range(10)])], 10)

    hit = "before " + " ".join(f"x{i}" for i in range(10)) + " after " + "w " * 20
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "__own": [hit, None, "plain"] * 400})
    out = list(D.cutter([Sent], 0.5, 1)(iter([batch])))
    assert [b.num_rows for b in out] == [500, 500, 200] and out[0].schema.names == ["doc_id", "__own"]
    assert [t for b in out for t in b.column(1).to_pylist()] == [hit.replace(" ".join(f"x{i}" for i in range(10)), ""), None, "plain"] * 400
