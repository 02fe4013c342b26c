"""Static guards on the text operators, and the pipeline's stages on odd documents."""

from __future__ import annotations

import pathlib
import re

import corpus_pipeline as C
from finledger.llm import queries as Q
from tests.conftest import SF001

LLM = pathlib.Path(__file__).resolve().parents[2] / "finledger" / "llm"
FORBIDDEN = (r"\blocalCheckpoint\b", r"\bcrossJoin\b", r"\.toPandas\(\)", r"\.collect\(\)", r"[\"']/tmp", r"except (Exception|ImportError)")


def test_operators_avoid_what_does_not_scale():
    for f in [*LLM.glob("*.py"), LLM.parents[1] / "corpus_pipeline.py"]:
        for i, line in enumerate(f.read_text().splitlines(), 1):
            code = line.split("#", 1)[0]
            assert not any(re.search(p, code) for p in FORBIDDEN), f"{f.name}:{i}: {line.strip()}"


def test_native_operators_run_no_python(spark):
    for name in ("op1_surrogates", "op2_site_lines", "op10_jump_sharding"):
        plan = Q.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|MapInArrow", plan), name


def test_nothing_else_imports_the_operators():
    for f in LLM.parent.rglob("*.py"):
        if LLM not in f.parents:
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_stages_on_odd_documents(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "a b c", None, None, 5, 1),
            (3, "word " * 30000, "en", "s", 150000, 1), (4, "x\n\ny\nx", "en", "s", 6, 1), (5, None, "en", "s", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __text int")
    docs = docs.withColumnRenamed("__text", "score")
    for empty in (False, True):
        kept = docs.limit(0) if empty else docs
        for name, stage in C.STAGES:
            kept = stage(spark, kept, SF001)
            got = kept.collect()
            if name != "packing":
                assert kept.columns == docs.columns
                assert not empty or not got
            kept = spark.createDataFrame(got, kept.schema)
        assert empty or {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5}
