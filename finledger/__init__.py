"""finledger: payment-ledger and bookkeeping analytics as Spark DataFrame functions.

Typical use::

    from finledger import Context, Params, run, QUERIES

    entries = [Entry("card", "card", "/data/card"), Entry("books", "books", "/data/books.csv")]
    ctx, report = Context.from_catalogue(spark, entries, Params(gateways=("card",), sources=("card",)))
    ctx.materialize_shared()                 # optional: stage shared tables once
    run(spark, "", "monthly_revenue", ctx=ctx).show()

Operators live in ``finledger.operators`` and take DataFrames, so they also
apply to ledgers loaded from files (``finledger.sources.catalogue``) or streams
(``finledger.streaming.ingest``).
"""

from .params import DEFAULT, GATEWAYS, Params
from .plans.context import Context
from .plans.registry import QUERIES, run
from .sources.catalogue import Entry

__all__ = ["Context", "DEFAULT", "Entry", "GATEWAYS", "Params", "QUERIES", "run"]
