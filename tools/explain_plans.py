"""Write the physical plans of the headline queries to docs/PLANS.md.

Usage: python tools/explain_plans.py [sf_dir]

For each query: the operators that decide cost at scale (scans with their
pushed filters and read schema, exchanges, joins and their build side,
aggregates, windows, sorts/top-k), taken from ``explain("formatted")`` after the
query has run once (so AQE's final plan is shown).
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from finledger.plans import registry as RG  # noqa: E402
from finledger.plans.context import Context  # noqa: E402
from tests.conftest import make_spark  # noqa: E402

HEADLINE = [
    "monthly_revenue", "monthly_pl", "refund_rates", "kpi_pl", "statement_metrics", "waterfall_levels",
    "cogs_by_supplier_account", "top_vendors", "explore_page", "sources_available", "mom_change_by_source",
    "large_refunds",
]
KEEP = re.compile(
    r"Scan|Exchange|Join|Aggregate|Window|Sort|TakeOrdered|Union|Generate|AQEShuffleRead|Filter|Reused"
)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = make_spark()
    ctx = Context(spark, sf).materialize_shared()
    out = [
        "# Physical plans of the headline queries",
        "",
        f"Generated by `tools/explain_plans.py` at `{sf}` on local[8], after `materialize_shared()`",
        "(shared stages read back from Parquet in the shared folder). Operator lines of the",
        "formatted plan only; the details list each scan's pushed filters and read schema.",
        "",
    ]
    for name in HEADLINE:
        df = RG.run(spark, sf, name, ctx=ctx)
        df.write.format("noop").mode("overwrite").save()
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree, _, details = text.partition("\n\n")
        out += [f"## {name}", "", "```"]
        out += [ln.rstrip()[:160] for ln in tree.splitlines() if KEEP.search(ln) or ln.startswith("AdaptiveSparkPlan")]
        out += ["```", ""]
        scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?(?=\n|\Z)", details)
        for sc in scans:
            keep = [ln for ln in sc.splitlines() if re.match(r"(\(\d+\) Scan|Output|PartitionFilters|PushedFilters|ReadSchema|Location)", ln)]
            out += ["    " + ln[:200] for ln in keep] + [""]
    os.makedirs("docs", exist_ok=True)
    with open("docs/PLANS.md", "w") as f:
        f.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
