"""Frozen query parameters: one ``Params`` per call replaces the dashboard's widgets."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date
from decimal import Decimal

# Gateway names of the four extracts and their roles.
CARD = "card"
WALLET_A = "wallet_a"
WALLET_B = "wallet_b"
CHECKOUT = "checkout"
GATEWAYS = (CARD, WALLET_A, WALLET_B, CHECKOUT)

# Transaction statuses that count as successful revenue.
SUCCESSFUL_STATUSES = ("settled", "completed", "paid")

# Card statuses counted in the failure histogram.
FAILURE_STATUSES = (
    "gateway_rejected",
    "processor_declined",
    "failed",
    "voided",
    "settlement_declined",
)


@dataclass(frozen=True)
class Params:
    """Everything a query may depend on besides its input tables.

    ``fiscal_*`` is the load-time window (hard-coded to one year in the
    dashboard); ``date_*`` and ``sources`` are the user's filter.
    """

    fiscal_from: date = date(2000, 1, 1)
    fiscal_to: date = date(2001, 12, 31)
    date_from: date = date(2000, 2, 15)
    date_to: date = date(2001, 12, 31)
    # every gateway that has extracts, and those the user selected
    gateways: tuple[str, ...] = GATEWAYS
    sources: tuple[str, ...] = GATEWAYS
    # gateway whose failures are tracked, whose refund rate is the alert KPI,
    # and whose growth is charted
    failure_gateway: str = CARD
    alert_gateway: str = WALLET_A
    growth_gateway: str = CHECKOUT
    large_refund_threshold: Decimal = Decimal("1000")
    # explorer filters (None = not set)
    amount_min: Decimal | None = None
    amount_max: Decimal | None = None
    statuses: tuple[str, ...] = ()
    # year-over-year pair
    yoy_prev_year: int = 2000
    yoy_year: int = 2001
    # statement used for fallbacks when a window holds no rows
    statement_id: int = 0
    top_vendors: int = 30
    top_vendors_table: int = 15
    # card refunds never reach V (their impact is debit); "ledger" counts them
    refunds_from: str = "revenue"
    # the outgoing table ignores the source filter unless this is set
    outgoing_uses_sources: bool = False

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
