"""Static guards on the library code: the things a Spark-at-scale design must not do."""

from __future__ import annotations

import pathlib
import re

LIB = pathlib.Path(__file__).resolve().parent.parent / "finledger"
FORBIDDEN = {
    r"\blocalCheckpoint\b": "lineage is cut with tables in the shared folder, never localCheckpoint",
    r"\b(pandas_)?udf\s*\(": "no Python UDF: built-in functions only",
    r"\.collect\(\)|\.toPandas\(\)": "no data pulled to the driver inside an operator",
    r"\bcrossJoin\b": "no cross joins",
    r"\.rdd\b": "DataFrames, not RDD transforms, and no look at partitions while a plan is built",
    r"\.isEmpty\(\)": "no job while a plan is built",
}


def test_library_avoids_driver_side_and_slow_paths():
    offenders = []
    for f in LIB.rglob("*.py"):
        if "llm" in f.relative_to(LIB).parts:  # optional part with its own tests
            continue
        for i, line in enumerate(f.read_text().splitlines(), 1):
            code = line.split("#", 1)[0]
            for pat, why in FORBIDDEN.items():
                if re.search(pat, code):
                    offenders.append(f"{f.relative_to(LIB)}:{i}: {why}: {line.strip()}")
    assert not offenders, "\n".join(offenders)
