from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard as zs
from pyspark.sql import functions as F

from finledger.llm import queries as Q
from finledger.llm import toxicity as T
from finledger.llm.common import map_batches
from tests.conftest import SF01


def corpus(n=1500, seed=2):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tu", "vos", "ne", "dri", "pal", "sho"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.randrange(20, 120))]
        y = int(rng.random() < 0.2)
        for _ in range(rng.randrange(2, 6) if y else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["grubbish", "blockhead", "wretchling", "dimwit"]))
        rows.append((i, " ".join(ws), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in T.score(docs, T.fit(docs, labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i, _ in held) and sum(r.held_out for r in out.values()) == len(held)
    assert np.mean([out[i].predicted == y for i, y in held]) > 0.95


def phrased(n=1500, seed=5, phrases=4):
    """Toxic texts marked by phrases of four words that all texts use one by one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ren", "tu", "vos"]) for _ in range(rng.randrange(2, 4))) for _ in range(400)]
    marks = [" ".join(rng.sample(vocabulary, 4)) for _ in range(phrases)]
    rows = []
    for i in range(n):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        y = int(rng.random() < 0.2)
        for _ in range(rng.randrange(1, 4) if y else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(marks))
        rows.append((i, " ".join(ws), y))
    return rows


@pytest.mark.parametrize("phrases", [1, 4])
def test_phrases_of_ordinary_words_are_found(phrases):
    rows = phrased(phrases=phrases)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    learn = [(t, y) for c in (1, 0) for i, t, y in rows if y == c and zlib.crc32(str(i).encode()) % 5]
    m = T.train(learn, 0.2)
    found = {y: np.mean([m.score(np.array([m.features(T.words(t))]))[0] >= 0.5 for _, t, z in held if z == y]) for y in (0, 1)}
    assert found[1] > 0.9 and found[0] < 0.05


def test_windows_are_compared_by_their_compressed_lengths():
    m = T.train([(t, y) for _, t, y in phrased(600)], 0.2)
    plain, toxic = m._compressors(strategy=zs.STRATEGY_LAZY2, search_log=10)
    word, worse = m._compressors(strategy=zs.STRATEGY_GREEDY)
    n = len(m.ordinary)
    around = lambda x: m.ordinary[n - 400:n - 336] + T.PAD + x + T.PAD + m.ordinary[n - 200:n - 150]
    for x, y in sorted(m.pairs)[:20]:
        w = around(T.PAD.join([x, y]))
        assert m.saved(T.PAD.join([x, y])) == len(plain(w)) - len(toxic(w))
        assert m.saved(x) == len(word(around(x))) - len(worse(around(x)))


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    schema = "doc_id long, toxic int"
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    a = T.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], schema))
    b = T.fit(docs, spark.createDataFrame(flip, schema))
    assert a.toxic == b.toxic and a.ordinary == b.ordinary and np.array_equal(a.weights, b.weights)


def test_nulls_empty_long_repeats_and_no_labels(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    m = T.fit(docs, labels)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "dimwit " * 50000, 1), (3, "x" * 300000, 1)],
                                "doc_id long, text string, score int")
    out = T.score(odd, m).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert T.score(odd.limit(0), m).count() == 0
    kept = T.drop_toxic(odd, m)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted == 0 for r in out)
    assert {r.score for r in T.score(odd, T.fit(docs, labels.limit(0))).collect()} <= {0.0} | {r.score for r in T.score(odd, T.fit(docs, labels.limit(0))).collect() if r.score < 0.01}


def test_query_has_one_row_per_document(spark):
    out = Q.op8_toxicity(spark, SF01)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()


def test_texts_are_marked_a_few_rows_at_a_time_and_sent_once(spark):
    rows = corpus(400)
    m = T.train([(t, y) for _, t, y in rows], 0.2)

    class Sent:
        value = m

    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _, _ in rows] * 4, "text": [t for _, t, _ in rows] * 4})
    out = list(T.marker(Sent, "test", 1, 2)(iter([batch])))
    assert len(out) == 4 and all(b.num_rows <= 500 and b.schema.names == ["doc_id", "text"] for b in out)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    want = [r.doc_id for r in T.score(docs, m).collect() if not r.predicted]
    assert sorted(i for b in out for i in b.column(0).to_pylist()) == sorted(want * 4)
    raw = docs.withColumn("text", F.encode("text", "UTF-8"))  # no string: cast, and given back as it was
    assert T.drop_toxic(raw, m).schema == raw.schema
    assert sorted(r.doc_id for r in T.drop_toxic(raw, m).collect()) == want


def test_a_worker_forgets_the_caches_of_earlier_operators(spark):
    def fills(batches):
        from finledger.llm import common

        common.kept("test", lambda: bytearray(1 << 20))
        yield from batches

    def left(batches):
        from finledger.llm import common

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._WORKER)] * b.num_rows, pa.int64())], ["n"])

    df = spark.range(0, 64, 1, 16)
    df.mapInArrow(fills, "id long").collect()
    assert {r.n for r in map_batches(df, left, "n long").collect()} == {0}
