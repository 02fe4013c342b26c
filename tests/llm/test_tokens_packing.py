from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from finledger.llm import packing as P
from finledger.llm import queries as Q
from finledger.llm import tokens as K
from tests.conftest import SF001

ODD = ["", None, "<|endoftext|> a<|startoftext|>b <|x", "ΑΣ ΣΑ it's I'LL 12½ x²", "ﬁ ﷺ ᏸ 漢字 \x1c x\x85y z　w",
       "a" * 5000, "é é É ÅÅ", "İstanbul ß ẞ", "日本語テキスト 👍🏽 ok", "x_y __ a\tb\n\nc"]


def test_words_equal_the_library_on_plain_and_odd_texts():
    tok = K.load(K.tokenizer_file())
    words = K.Words(tok, K.whole_tokens(K.tokenizer_file()), lambda ids: np.asarray(ids, "<u2").tobytes(), pa.binary())
    rng = random.Random(5)
    plain = [chr(c) for c in range(0x21, 0x2100) if K.PLAIN.fullmatch(chr(c))]
    texts = [t for t in ODD if t] + ["".join(rng.choice(plain) if rng.random() < 0.8 else " " for _ in range(60)) for _ in range(3000)]
    texts += ["".join(chr(rng.randrange(32, 127)) for _ in range(80)) for _ in range(1000)]
    texts += [f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in range(0x21, 0xD7FF) if K.PLAIN.fullmatch(chr(c))]
    texts += ["a,b. c.. d!. (e). f., g", "x. y, z.\nEnd. ", " lead", "", "É. Ü, ﬁ."]
    parts = [b"".join(found[x:y].to_pylist()) for found, ends in words.of_texts(texts)
             for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    for t, e, got in zip(texts, tok.encode_batch(texts, add_special_tokens=False), parts, strict=True):
        want = np.asarray(e.ids, "<u2").tobytes()
        assert b"".join(words.of_text(t)) == want == got, repr(t)


def test_query_counts_equal_the_library(spark):
    tok = K.load(K.tokenizer_file())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = Q.op3_token_counts(spark, SF001).collect()
    assert len(out) == len(texts)
    for r in out:
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048)


def test_counts_of_nulls_repeats_clashes_and_empty(spark):
    df = spark.createDataFrame([(i % 3 if i else None, t, 0) for i, t in enumerate(ODD + ODD)], "doc_id long, text string, n_tokens int")
    tok = K.load(K.tokenizer_file())
    got = sorted(r.n_tokens for r in K.count_tokens(df, K.tokenizer_file()).collect())
    assert got == sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for t in ODD + ODD)
    assert K.count_tokens(df.limit(0), K.tokenizer_file()).count() == 0


def check_packing(rows, texts, window):
    """rows: pieces; texts: doc_id -> text. Every id in one piece, sequences gapless and bounded."""
    tok = K.load(K.tokenizer_file())
    ids = {k: np.array([*tok.encode(t or "", add_special_tokens=False).ids, K.END_ID], "<u4") for k, t in texts.items()}
    of, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(of) == set(ids)
    for k, ps in of.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(ids[k][at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids[k])
    padding = 0
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query_packs_every_id_once_without_padding(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert check_packing(Q.op7_bm25_packing(spark, SF001).collect(), texts, 4096) == 0


def test_packing_of_nulls_copies_long_texts_clashes_and_empty(spark):
    texts = {i: t for i, t in enumerate(ODD)} | {100: "word " * 20000, 101: "x"} | {200 + i: "same text here" for i in range(700)}
    df = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "doc_id long, text string, ids int")
    assert check_packing(P.pack_documents(df, window=64).collect(), texts, 64) == 0
    assert P.pack_documents(df.limit(0)).count() == 0
    twice = P.pack_documents(df.limit(3).union(df.limit(3)).withColumn("doc_id", df.doc_id)).collect()
    assert sum(r.length for r in twice) % 2 == 0


def test_a_window_is_filled_by_a_far_neighbour_of_its_shard():
    # documents i and i + 600 hold the same tokens; a window has room for two documents
    class Sent:
        value = np.ones(P.VOCABULARY)

    ids = [np.arange(1000 + i % 600 * 20, 1020 + i % 600 * 20).astype("<u2").tobytes() for i in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array(ids, pa.binary())], ["id", "ids"])
    of = {}
    for out in P.packer(40, Sent, 20.0)(iter([batch])):
        of |= dict(zip(out.column(0).to_pylist(), out.column(5).to_pylist(), strict=True))
    assert len(of) == 1200 and all(of[i] == of[i + 600] for i in range(600))


def test_shards_follow_the_highest_tf_idf():
    class Sent:
        value = np.ones(P.VOCABULARY)

    Sent.value[7] = 5.0
    ids = np.array([7, 900, 40000], "<u2").tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([ids], pa.binary()), pa.array([0])], ["id", "ids", "crc"])
    assert next(P.telling(Sent)(iter([batch]))).column(3).to_pylist() == [7]


def test_neighbours_rank_by_bm25():
    idf = np.ones(P.VOCABULARY)
    docs = [[1, 2, 3], [9, 9, 9], [1, 2, 8], [1, 7, 6]]
    block = P.Block([(i, np.array(d, "<u2"), 0) for i, d in enumerate(docs)], idf, 3.0)
    assert block.neighbours(0).tolist() == [0, 2, 3, 1]


def test_telling_token_and_place_by_brute_force():
    rng = np.random.default_rng(3)

    class Sent:
        value = np.round(rng.random(P.VOCABULARY), 1)  # ties

    raws = [rng.integers(0, top, n).astype("<u2").tobytes()
            for top, n in zip(rng.choice([3, 50, 65536], 500), rng.integers(1, 300, 500), strict=True)]
    crc, spread = rng.integers(0, 1 << 32, 500), rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(raws, pa.binary()), pa.array(crc), pa.array(spread)],
                                       ["id", "ids", "crc", "spread"])
    told = next(P.telling(Sent)(iter([batch])))
    place = next(P.placed(iter([told]))).column(2).to_pylist()
    for i, raw in enumerate(raws):
        t, n = np.unique(np.frombuffer(raw, "<u2"), return_counts=True)
        best = int(t[np.argmax(Sent.value[t] * np.log1p(n))])
        assert told.column(3)[i].as_py() == best
        assert place[i] + (1 << 63) == best << 48 | int(crc[i]) << 16 | int(spread[i]) & 0xFFFF


def test_many_shards_hold_every_id_once(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_TOKENS", 500)
    rows = [(i, f"word{i % 7} " * (i % 40) + "the same end") for i in range(300)] + [(1000 + i, "one text " * 20) for i in range(300)]
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    assert got.select("sequence_id").distinct().count() > 10
    for doc, pieces in itertools.groupby(sorted(got.collect(), key=lambda r: (r.doc_id, r.start)), key=lambda r: r.doc_id):
        at = 0
        for p in pieces:
            assert p.start == at
            at += p.length
        assert at == p.doc_tokens
    # equal texts do not all meet in one shard
    assert got.where("doc_id >= 1000").select(F.shiftright("sequence_id", 36)).distinct().count() > 1


def test_words_that_stand_once_are_not_kept():
    words = K.Words(K.load(K.tokenizer_file()), K.whole_tokens(K.tokenizer_file()), len, pa.int64())
    list(words.of_texts(["again and again", *(f"once{i}x only" for i in range(50))]))
    assert set(words) == {"again", "only"}


def test_marks_after_letters_are_cut_off_without_the_pattern(monkeypatch):
    tok = K.load(K.tokenizer_file())
    words = K.Words(tok, K.whole_tokens(K.tokenizer_file()), list, pa.list_(pa.int64()))
    rng = random.Random(7)
    stems = ["zqkfoo", "the", "été", "größe", "бывший", "σας", "s", "t"]
    texts = [rng.choice(stems) + "".join(rng.choice(K.MARKS) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    texts = [t for t in texts if K.simple(t)] + ["zqkfoo'", "zqkfoo''s"]
    assert len(texts) > 1000
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [words.simple_ids(t) for t in texts] == want
    monkeypatch.setattr(words, "ids", None)
    assert [words.simple_ids(t) for t in texts[:-1]] == want[:-1]


def test_frequencies_by_brute_force():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 60, rng.integers(1, 40)).astype("<u2") for _ in range(5000)] + [np.array([65535], "<u2")]
    batch = pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in docs], pa.binary())], ["ids"])
    out = next(P.frequencies(iter([batch.slice(0, 0), batch])))
    want = Counter(t for d in docs for t in set(d.tolist())) | {-1: len(docs), -2: sum(map(len, docs))}
    assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)) == want


def test_a_shard_holds_several_blocks():
    # every shard is a task with costs of its own
    assert P.SHARD_TOKENS >= 4 * P.BLOCK_TOKENS
