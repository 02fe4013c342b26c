"""Shared lazy stages of one run: extracts -> ledger -> V, books -> statements.

Each property is a DataFrame built once per context (Python-side memo of the
*plan*, not of data).  ``materialize_shared()`` may be called when several
queries run together so that the ledger and books are computed once (what the
dashboard's memoised reactives did); nothing is ever collected to the driver.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import books as B
from ..operators import ledger as L
from ..operators import normalize as N
from ..operators import revenue as R
from ..operators import statements as S
from ..params import DEFAULT, FAILURE_STATUSES, WALLET_A, WALLET_B, Params
from ..schema import BOOKS, FAILURES, LEDGER_BASE, STATEMENT, VENDORS, empty
from ..sources import bindings as BIND
from ..sources.catalogue import Entry, Inputs, load_inputs


class Context:
    """``inputs`` are the user's own extracts and sheets; without them the test tables are bound."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = DEFAULT, inputs: Inputs | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.p = params
        self.inputs = inputs

    @classmethod
    def from_catalogue(cls, spark: SparkSession, entries: list[Entry], params: Params = DEFAULT) -> tuple[Context, DataFrame]:
        """(context over the entries that are there, report of all entries)."""
        inputs, report = load_inputs(spark, entries)
        return cls(spark, "", params, inputs), report

    # --- raw extracts (text) --------------------------------------------
    @cached_property
    def order_facts(self) -> DataFrame:
        return BIND.order_facts(self.spark, self.sf_dir)

    @cached_property
    def card_raw(self) -> DataFrame:
        return BIND.card_extract(self.spark, self.sf_dir, self.order_facts)

    @cached_property
    def wallet_a_raw(self) -> DataFrame:
        return BIND.wallet_extract(self.spark, self.sf_dir, WALLET_A, self.order_facts)

    @cached_property
    def wallet_b_raw(self) -> DataFrame:
        return BIND.wallet_extract(self.spark, self.sf_dir, WALLET_B, self.order_facts)

    @cached_property
    def checkout_raw(self) -> DataFrame:
        return BIND.checkout_extract(self.spark, self.sf_dir, self.order_facts)

    @cached_property
    def raw(self) -> DataFrame | None:
        """Every gateway's rows as one table of text cells (``normalize.TAGGED_COLUMNS``)."""
        if self.inputs is not None:
            return self.inputs.extracts
        return BIND.tagged_extracts(self.order_facts)

    # --- normalised -----------------------------------------------------
    @cached_property
    def union(self) -> DataFrame:
        return empty(self.spark, LEDGER_BASE) if self.raw is None else N.normalize_tagged(self.raw)

    @cached_property
    def norm_parts(self) -> list[DataFrame]:
        """The union by gateway."""
        return [self.union.where(F.col("source") == g) for g in self.p.gateways]

    @cached_property
    def ledger(self) -> DataFrame:
        return L.ledger([self.union], self.p)

    @cached_property
    def revenue(self) -> DataFrame:
        return L.revenue(self.ledger, self.p.refunds_from)

    @cached_property
    def filtered(self) -> DataFrame:
        return L.by_range_and_sources(self.ledger, self.p)

    @cached_property
    def filtered_revenue(self) -> DataFrame:
        return L.revenue(self.filtered, self.p.refunds_from)

    @cached_property
    def revenue_cube(self) -> DataFrame:
        """V reduced to one row per (date, source): every revenue output reads this."""
        return R.daily_cube(self.revenue)

    @cached_property
    def filtered_cube(self) -> DataFrame:
        return L.by_range_and_sources(self.revenue_cube, self.p)

    @cached_property
    def failures(self) -> DataFrame:
        if self.raw is None:
            return empty(self.spark, FAILURES)
        cards = self.raw.where((F.col("kind") == "card") & (F.col("source") == self.p.failure_gateway))
        return N.failure_histogram(cards, FAILURE_STATUSES)

    # --- books and statements ----------------------------------------------
    @cached_property
    def books_sheet(self) -> DataFrame | None:
        if self.inputs is not None:
            return self.inputs.books
        return BIND.books_sheet(self.spark, self.sf_dir, self.p.fiscal_from, self.p.fiscal_to)

    @cached_property
    def books_export(self) -> DataFrame | None:
        """The whole sheet, entries outside the fiscal window too."""
        return self.books_sheet if self.inputs is not None else BIND.books_sheet(self.spark, self.sf_dir)

    @cached_property
    def entities(self) -> DataFrame:
        """The entities that keep books (entity)."""
        if self.inputs is not None:
            return self.books_export.select("entity").distinct()
        return BIND.entities(self.spark, self.sf_dir)

    @cached_property
    def books(self) -> DataFrame:
        if self.books_sheet is None:
            return empty(self.spark, BOOKS)
        return B.books_window(B.books_typed(self.books_sheet), self.p)

    @cached_property
    def cogs(self) -> DataFrame:
        return B.cogs_entries(self.books)

    @cached_property
    def cogs_filtered(self) -> DataFrame:
        return B.in_user_range(self.cogs, self.p)

    @cached_property
    def books_monthly(self) -> DataFrame:
        return B.books_monthly(self.books)

    @cached_property
    def monthly_pl(self) -> DataFrame:
        """Joined with the books; without any, sales and refunds alone."""
        if self.inputs is not None and self.inputs.books is None:
            return B.monthly_pl_no_books(self.revenue_cube)
        return B.monthly_pl(self.revenue_cube, self.books_monthly)

    @cached_property
    def monthly_pl_filtered(self) -> DataFrame:
        return L.month_window(self.monthly_pl, self.p)

    @cached_property
    def statements(self) -> DataFrame:
        if self.inputs is not None:
            return empty(self.spark, STATEMENT) if self.inputs.statements is None else self.inputs.statements
        return S.statements_from_books(self.books)

    @cached_property
    def statement_metrics(self) -> DataFrame:
        return S.statement_metrics(self.statements)

    @cached_property
    def vendor_sheet(self) -> DataFrame | None:
        if self.inputs is not None:
            return self.inputs.vendors
        return B.vendor_sheet(self.books)

    @cached_property
    def vendors(self) -> DataFrame:
        if self.vendor_sheet is None:
            return empty(self.spark, VENDORS)
        return B.vendor_totals(self.vendor_sheet)

    # stages that depend only on the input tables and the fiscal window
    SHARED = (
        "order_facts", "raw", "card_raw", "wallet_a_raw", "wallet_b_raw", "checkout_raw", "norm_parts", "union",
        "ledger", "revenue", "revenue_cube", "failures", "books_sheet", "books", "cogs", "books_monthly",
        "monthly_pl", "statements", "statement_metrics", "vendor_sheet", "vendors",
    )

    def derive(self, **changes) -> "Context":
        """Same inputs, other parameters; stages that do not depend on the
        changed parameters are shared, not rebuilt."""
        ctx = Context(self.spark, self.sf_dir, self.p.with_(**changes), self.inputs)
        if {"fiscal_from", "fiscal_to"} & set(changes):
            return ctx
        # the revenue subset and what is built on it depend on refunds_from
        stale = {"revenue", "revenue_cube", "monthly_pl"} if "refunds_from" in changes else set()
        for k in self.SHARED:
            if k in self.__dict__ and k not in stale:
                ctx.__dict__[k] = self.__dict__[k]
        return ctx

    def materialize_shared(self) -> "Context":
        """Compute the stages most queries share once and cut their lineage.

        Each is written as a Parquet table under the cluster's shared folder
        (``spark.checkpoint.dir``) and read back: a lost executor does not force
        a recomputation from the raw inputs, later scans get column pruning and
        filter pushdown, and every later plan starts from a short scan instead
        of the whole extract -> ledger lineage.  The normalised union (what the
        dashboard caches per extract) is partitioned by source, so each
        gateway's rows are a pruned read of it.
        """
        from ..sources.files import stage_table

        u = stage_table(self.spark, self.union, "union", partition_by="source")
        self.__dict__["union"] = u
        self.__dict__["norm_parts"] = [u.where(F.col("source") == g) for g in self.p.gateways]
        # by source and month (date-range filters prune whole months), sorted by
        # date inside each file (row groups skip within a month)
        self.__dict__["ledger"] = stage_table(
            self.spark, L.ledger([u], self.p), "ledger",
            partition_by=["source", "month"], within=["date", "transaction_id"],
        )
        # books (line-item sized) by month: date-range filters prune whole months
        self.__dict__["books"] = stage_table(
            self.spark, self.books, "books", partition_by="month", within=["date", "entity", "split", "num"]
        )
        for k in ("revenue_cube", "failures", "statements", "vendors"):
            self.__dict__[k] = stage_table(self.spark, getattr(self, k), k)
        return self
