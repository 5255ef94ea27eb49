"""Thresholds shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Ingestion bounds.
    max_age_days: int = 5478
    max_age_years: int = 15
    future_grace_days: int = 3
    max_amount: float = 100_000_000.0
    max_file_rows: int = 20_000
    max_file_bytes: int = 5 * 1024 * 1024
    currency: str = "ZMW"
    # Salary detection.
    salary_tolerance: float = 0.15
    salary_day_window: int = 7
    # Learning phase.
    learning_days: int = 30
    learning_transactions: int = 15
    # Classification.
    min_training_rows: int = 20
    confidence_floor: float = 0.60
    correction_weight: int = 3
    target_f1: float = 0.85
    # Forecasting.
    min_months: int = 4
    max_origins: int = 3
    ar1_margin: float = 1.02
    croston_alpha: float = 0.4
    max_error_ratio: float = 0.15
    # Recurring charges.
    recurring_min_count: int = 3
    recurring_tolerance: float = 0.15
    recurring_min_gap: int = 24
    recurring_max_gap: int = 38
    # Budgets and alerts.
    essential_buffer: float = 0.05
    nudge_pct: float = 80.0
    savings_floor: float = 0.10
    surge_pct: float = 35.0
    # Suggestions.
    frequent_visits: int = 4
    concentration_share: float = 0.50
    audit_min_count: int = 2
    audit_salary_share: float = 0.05
    trip_categories: tuple[str, ...] = ("Groceries", "Shopping", "Personal Care")
    # Receipts and exchange rates.
    match_window_days: int = 3
    exact_tolerance: float = 0.01
    fx_tolerance: float = 0.05
    max_item_price: float = 100_000.0
    max_item_quantity: int = 99
    message_window_days: int = 30
    message_limit: int = 40
    candidate_messages: int = 5


DEFAULTS = Params()

CASH_WITHDRAWAL = "Cash Withdrawal"
UNCATEGORISED = "Uncategorised"
INCOME = "Income"
ESSENTIAL = "ESSENTIAL"
DISCRETIONARY = "DISCRETIONARY"
