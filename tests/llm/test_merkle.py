from __future__ import annotations

import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from finledger.llm import merkle as M
from finledger.llm import queries as Q
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, g long, path string, __copy int"


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def grown(nodes):
    """All levels from the leaves to the single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append((i - first, [level[j] for j in range(first, min(first + 8, len(level))) if j != i]))
        i //= 8
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, places = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        places.append(mine)
        trees.append(grown([leaf_of(r, r[1]) for r in mine]))
    top = grown([t[-1][0] for t in trees])
    out = []
    for k, mine in enumerate(places):
        for i, r in enumerate(mine):
            path = steps(trees[k], i) + steps(top, k)
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            f = leaf_of(r, text)
            for at, others in path:
                f = h(*others[:at], f, *others[at:])
            root = top[-1][0]
            out.append((r[0], trees[k][0][i], trees[k][-1][0], root, h(*[x for _, o in path for x in o]), f, f == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_permutation_with_whole_subtrees(levels):
    places = np.concatenate([M.address(levels, d, np.arange(8**d)) for d in range(levels)])
    assert sorted(places.tolist()) == list(range(M.nodes_of(levels)))
    if levels > 1:  # a lower subtree lies in one stretch, its root first
        top = levels // 2
        for k in (0, 8**top - 1):
            first = M.nodes_of(top) + k * M.nodes_of(levels - top)
            assert M.address(levels, top, k) == first
            last = M.address(levels, levels - 1, np.arange(8 ** (levels - 1 - top)) + k * 8 ** (levels - 1 - top))
            assert first <= last.min() and last.max() < first + M.nodes_of(levels - top)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 73, 511, 512])
def test_layout_holds_every_node_and_its_siblings(n):
    leaves = [sha256(str(i).encode()).digest() for i in range(n)]
    levels = grown([x.hex() for x in leaves])
    store = b"".join(M.laid_out(len(levels), leaves))
    for i in range(0, n, 5):
        got = [(at, [o.hex() for o in others]) for at, others in M.siblings(store, len(levels), n, i)]
        assert got == steps(levels, i)
        assert M.Path.folded(leaves[i], M.siblings(store, len(levels), n, i)).hex() == levels[-1][0]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF001}/documents.parquet'")
    got = sorted(map(tuple, Q.op11_merkle_manifest(spark, SF001).collect()))
    assert got == sorted(con.sql(M.SQL).fetchall()) and not all(r[-1] for r in got)


@pytest.mark.parametrize("height", [1, 2])
def test_blocks_nulls_ties_repeats_and_clashing_names(spark, height):
    rows = [(i % 97 if i % 13 else None, None if i % 11 == 0 else f"Text {i % 50} É" * (i % 4), ("a", "b", None, "é", "")[min(i % 23, 4)],
             None if i % 7 == 0 else f"s{i % 3}", None if i % 5 == 0 else i % 9, "x", 3, "y", 1) for i in range(700)]
    rows += rows[:40] + [(5000 + k, "One", f"lang{k}", None, 3, "x", 3, "y", 1) for k in range(70)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, M.verified_documents(df, height=height).collect()), key=str)
    assert got == brute(rows)
    tree = M.Manifest(df.selectExpr("doc_id id", "lang", "unhex(sha2(text, 256)) digest").where("digest is not null"),
                      "lang", ["id", "digest"], {"id": "long"}, height)
    root = tree.root().collect()
    proofs = tree.proofs().collect()
    assert len(root) == 1 and len(proofs) == sum(r[1] is not None for r in rows)
    assert all(M.Path.folded(bytes(p.digest), M.Path.steps(bytes(p.path))) == root[0].digest == p.root for p in proofs)


def test_lone_leaf_and_empty_table(spark):
    one = spark.createDataFrame([(3, "A", "en", "s", 1, "", 0, "", 0)], SCHEMA)
    r = M.verified_documents(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h()
    assert M.verified_documents(one.limit(0)).count() == 0
