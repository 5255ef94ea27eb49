"""Table schemas of the ledger model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

PROFILE = "user_id BIGINT, full_name STRING, salary_amount DECIMAL(18,2), salary_day INT"
CATEGORY = "category_name STRING, category_type STRING"
LEDGER = (
    "user_id BIGINT, txn_key STRING, txn_date DATE, description STRING, amount DECIMAL(18,2), "
    "txn_type STRING, is_salary BOOLEAN, is_subscription BOOLEAN, category_name STRING, "
    "category_source STRING, category_confidence DOUBLE, import_hash STRING"
)
BUDGET_LINE = (
    "user_id BIGINT, month STRING, category_name STRING, recommended DOUBLE, forecast DOUBLE, "
    "method STRING, explanation STRING"
)
GOAL = "user_id BIGINT, goal_id BIGINT, goal_name STRING, target_amount DECIMAL(18,2), target_date DATE"
RECEIPT_ITEM = "txn_key STRING, item_name STRING, amount DECIMAL(18,2), quantity INT"
FX_RATE = "as_of DATE, base STRING, code STRING, per_local DOUBLE"
METRIC = (
    "metric_id BIGINT, model_type STRING, algorithm STRING, f1 DOUBLE, mae DOUBLE, mae_ratio DOUBLE, "
    "per_category_mae_ratio DOUBLE, sample_count BIGINT, notes STRING, trained_at TIMESTAMP"
)

# The built-in spending categories.
CATEGORIES = (
    ("Groceries", "ESSENTIAL"),
    ("Transport", "ESSENTIAL"),
    ("Utilities", "ESSENTIAL"),
    ("Housing", "ESSENTIAL"),
    ("Healthcare", "ESSENTIAL"),
    ("Education", "ESSENTIAL"),
    ("Airtime & Data", "ESSENTIAL"),
    ("Loan & Debt", "ESSENTIAL"),
    ("Dining Out", "DISCRETIONARY"),
    ("Entertainment", "DISCRETIONARY"),
    ("Subscriptions", "DISCRETIONARY"),
    ("Shopping", "DISCRETIONARY"),
    ("Personal Care", "DISCRETIONARY"),
    ("Transfers", "DISCRETIONARY"),
    ("Cash Withdrawal", "DISCRETIONARY"),
    ("Income", "ESSENTIAL"),
    ("Uncategorised", "DISCRETIONARY"),
)


def category_dim(spark) -> DataFrame:
    """A literal table, so the optimizer knows its size and can broadcast it."""
    rows = ", ".join("('%s', '%s')" % row for row in CATEGORIES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(category_name, category_type)")


def rnd(c: Column | str, digits: int = 2) -> Column:
    """Output rounding, done once at the edge.

    The first step drops the float noise of differently ordered sums, so a
    value that is a tie in exact arithmetic rounds the same way every run.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.round(c.cast("double"), 8), digits)
