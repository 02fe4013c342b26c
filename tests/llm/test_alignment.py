from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from finledger.llm import alignment as M
from finledger.llm import queries as Q
from finledger.llm.tokens import byte_letters
from tests.conftest import SF001

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row long, links string, n_a int, groups int"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def brute(texts, libraries):
    """Per text: (n_a, n_b, groups, links), by sets of byte offsets."""
    a, b = libraries
    byte = {c: x for x, c in byte_letters().items()}
    out = []
    for t in texts:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or not b"".join(ta) == b"".join(tb) == (" " + t).encode():
            out.append((0, 0, [], []))
            continue
        ea, eb = ({int(e): k for k, e in enumerate(np.cumsum([len(x) for x in side]))} for side in (ta, tb))
        groups, links, x, y = [], [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            groups.append(",".join(map(str, ia[x:ea[e] + 1])) + "|" + ",".join(map(str, ib[y:eb[e] + 1])))
            x, y = ea[e] + 1, eb[e] + 1
            links.append((ia[x - 1], ib[y - 1]))
        out.append((len(ia), len(ib), groups, links))
    return out


def expected(keys, texts, libraries):
    rows = brute(texts, libraries)
    n = Counter(p for *_, links in rows for p in links)
    best = defaultdict(int)
    for (_, y), c in n.items():
        best[y] = max(best[y], c)
    return sorted((
        (k, a, b, len(g), len(links), sum(n[p] == best[p[1]] for p in links), sum(n[p] for p in links),
         sha256(";".join(g).encode()).hexdigest() if a else "") for k, (a, b, g, links) in zip(keys, rows, strict=True)), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4)), st.lists(st.integers(1, 4)), st.integers(1, 9))
def test_pieces_find_every_shared_end(x, y, step):
    a, b = np.cumsum(np.array(x, np.int64)), np.cumsum(np.array(y, np.int64))
    i, j = M.crossings(a, b, step)
    assert ((i + j)[:-1] == np.arange(0, len(a) + len(b), step)).all() and i[-1] == len(a) and j[-1] == len(b)
    la, lb = M.shared_ends(a, b, step)
    assert a[la].tolist() == b[lb].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@settings(max_examples=300, deadline=None)
@given(st.text(min_size=1, max_size=60))
def test_first_tokenizer_equals_the_file_s_library(libraries, text):
    pair = test_first_tokenizer_equals_the_file_s_library.__dict__.setdefault(
        "pair", M.Pair(A_PATH, B_PATH, public_tokenizers.PATTERN))
    assert pair.a.encode_ordinary(" " + text) == libraries[0].encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("head", [M.HEAD, 100, 0])
def test_query_equals_brute_force(spark, libraries, head, monkeypatch):
    monkeypatch.setattr(M, "HEAD", head)
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = Q.op12_merge_path_alignment(spark, SF001) if head == M.HEAD and head else M.aligned_documents(docs, head=head)
    assert sorted(map(tuple, got.collect()), key=str) == expected([r.doc_id for r in rows], [r.text for r in rows], libraries)


def test_odd_texts_repeats_clashes_and_empty(spark, libraries):
    texts = [None, "", " ", "a  b", " lead", "trail ", "tab\there\n\n", "<s>x</s> <|endoftext|> <unk>", "▁mark", "\x00\x1f",
             "ﬁ 日本語 🙂🙂 é é", "word " * 30000, "x" * 50000, "hello world", "hello world", "hello world"]
    keys = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 13, None]
    df = spark.createDataFrame([(k, t, 1, "l", 2, 3) for k, t in zip(keys, texts, strict=True)], SCHEMA).repartition(3)
    got = sorted(map(tuple, M.aligned_documents(df).collect()), key=str)
    assert got == expected(keys, [t or "" for t in texts], libraries)
    assert M.aligned_documents(df.limit(0)).count() == 0


def test_groups_are_given_as_text(spark, libraries):
    df = spark.createDataFrame([(1, "Alignment of tokenizers, doch über Bytes")], "doc_id long, text string")
    r = M.align(df).first()
    want = brute(["Alignment of tokenizers, doch über Bytes"], libraries)[0]
    assert r.groups == ";".join(want[2])
    pairs = np.frombuffer(bytes(r.links), "<u4").tolist()
    assert [(p // M.IDS, p % M.IDS) for p in pairs] == want[3]
