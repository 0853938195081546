"""Tunables, prices and codes. Money is integer paise, rates are basis points."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Price:
    rate_bps: int = 0
    flat: int = 0
    cap: int | None = None


# Prices by method, taxes, settlement lag and holidays.
PRICES = {"upi": Price(), "debit_card": Price(40, cap=100_000), "credit_card": Price(200), "netbanking": Price(flat=1_800), "wallet": Price(200)}
HOLIDAYS = (date(2026, 8, 15), date(2026, 9, 17), date(2026, 10, 2))


@dataclass(frozen=True)
class FeeModel:
    prices: dict[str, Price] = field(default_factory=lambda: dict(PRICES))
    gst_bps: int = 1_800
    tds_bps: int = 10
    lag_days: int = 2
    holidays: tuple[date, ...] = HOLIDAYS


@dataclass(frozen=True)
class MatchConfig:
    """Scores are in ten-thousandths, so that they compare exactly."""

    amount_tolerance: int = 100
    amount_tolerance_bps: int = 50
    slack_days: int = 3
    max_distance: int = 2
    name_floor: int = 88
    score_gates: int = 6_500
    score_reference: int = 2_500
    score_name: int = 900
    post_score: int = 9_000
    pool_cap: int = 25
    subset_tolerance_bps: int = 0
    max_members: int = 12
    node_budget: int = 200_000
    max_candidates: int = 8
    accept_confidence: float = 0.85


@dataclass(frozen=True)
class Code:
    human: bool
    terminal: bool
    supersedable: bool
    systemic: bool
    action: str


# Reason codes and their sets (human, terminal, supersedable, systemic). The actions are this engine's words.
CODES = {
    "NO_CANDIDATE": Code(True, False, True, False, "Search outside the date window, or find another origin of the credit."),
    "AMBIGUOUS_SUBSET": Code(True, True, False, False, "Choose one of the listed explanations; each adds up."),
    "AMOUNT_BEYOND_TOLERANCE": Code(True, False, True, False, "Check the fee model of this merchant before the data."),
    "DATE_OUT_OF_WINDOW": Code(True, False, True, False, "Confirm the settlement cycle; the window may be too narrow."),
    "LOW_CONFIDENCE": Code(True, False, True, False, "Read the proposal's evidence and confirm or reject it."),
    "ORPHAN_CREDIT": Code(True, False, True, False, "Trace the credit outside the gateway; nothing settled in its window."),
    "DUPLICATE_SUSPECTED": Code(False, False, False, False, "Ask the bank whether this credit was posted twice."),
    "LLM_INVALID_OUTPUT": Code(False, False, True, True, "Nothing to do on the record; look into the model if this is frequent."),
    "POOL_TOO_LARGE": Code(False, False, True, True, "Narrow the batch by date, or resolve by hand."),
    "MODEL_UNAVAILABLE": Code(False, False, True, True, "Run again once the model can be reached."),
}
REFUSED_PROPOSAL = "The proposed settlements do not add up to the credit; find those that do."
PATTERN_AT = 3
PREFIXES = ("NEFT", "IMPS", "RTGS", "UPI", "CR", "DR")
LEAST_REFERENCE, MOST_REFERENCE = 8, 32
DEFAULT_FEES, DEFAULT_CONFIG = FeeModel(), MatchConfig()
