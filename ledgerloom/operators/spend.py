"""Spending predicates, category joins and the basic ledger aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import month_key, month_start
from ..functions.text import Col, as_col
from ..params import CASH_WITHDRAWAL, DEFAULTS, UNCATEGORISED, Params
from ..schema import rnd


# --- Predicates ---------------------------------------------------------------

def not_withdrawal(category_name: Col = "category_name") -> Column:
    """Keeps every category but cash withdrawals; a missing category is kept."""
    return F.coalesce(as_col(category_name), F.lit("")) != CASH_WITHDRAWAL


def is_debit() -> Column:
    return F.col("txn_type") == "DEBIT"


def is_credit() -> Column:
    return F.col("txn_type") == "CREDIT"


def is_spend(txn_type: Col = "txn_type", is_salary: Col = "is_salary", category_name: Col = "category_name") -> Column:
    salary = F.coalesce(as_col(is_salary), F.lit(False))
    return (as_col(txn_type) == "DEBIT") & ~salary & not_withdrawal(category_name)


# --- Category joins -----------------------------------------------------------

def with_category(ledger: DataFrame, category: DataFrame) -> DataFrame:
    return ledger.join(category, "category_name", "inner")


def with_category_left(ledger: DataFrame, category: DataFrame) -> DataFrame:
    return ledger.join(category, "category_name", "left")


def with_known_category(ledger: DataFrame, category: DataFrame) -> DataFrame:
    """Names outside the dimension fall back to the uncategorised label."""
    known = category.select(F.col("category_name").alias("known_name"))
    return (
        ledger.join(known, F.col("category_name") == F.col("known_name"), "left")
        .withColumn("category_name", F.coalesce("known_name", F.lit(UNCATEGORISED)))
        .drop("known_name")
    )


def without_withdrawals(ledger: DataFrame) -> DataFrame:
    return ledger.filter(not_withdrawal())


# --- Aggregates ---------------------------------------------------------------

def monthly_spend(ledger: DataFrame, category: DataFrame) -> DataFrame:
    """Spending per (user, month, category) as exact decimals.

    The dimension join runs after the aggregation, on one row per group.
    """
    spent = (
        ledger.filter(is_spend() & F.col("category_name").isNotNull())
        .groupBy("user_id", month_start("txn_date").alias("month"), "category_name")
        .agg(F.sum("amount").alias("amount"))
    )
    return spent.join(category.select("category_name"), "category_name", "left_semi").select(
        "user_id", "category_name", "month", "amount"
    )


def actual_spend(ledger: DataFrame, category: DataFrame) -> DataFrame:
    return monthly_spend(ledger, category).select(
        "user_id", month_key("month").alias("month"), "category_name", rnd("amount").alias("spent")
    )


def month_totals(ledger: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        without_withdrawals(ledger)
        .groupBy("user_id", month_key("txn_date").alias("month"))
        .agg(
            F.sum(F.when(is_credit(), F.col("amount")).otherwise(zero)).alias("income"),
            F.sum(F.when(is_credit(), zero).otherwise(F.col("amount"))).alias("expenditure"),
        )
        .select(
            "user_id",
            "month",
            rnd("income").alias("income"),
            rnd("expenditure").alias("expenditure"),
            rnd(F.col("income") - F.col("expenditure")).alias("net"),
        )
    )


def savings_pool(ledger: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        without_withdrawals(ledger)
        .groupBy("user_id")
        .agg(
            F.sum(F.when(is_credit(), F.col("amount")).otherwise(zero)).alias("income"),
            F.sum(F.when(is_credit(), zero).otherwise(F.col("amount"))).alias("expenses"),
        )
        .select(
            "user_id",
            rnd("income").alias("income"),
            rnd("expenses").alias("expenses"),
            rnd(F.greatest(F.lit(0), F.col("income") - F.col("expenses"))).alias("pool"),
        )
    )


def available_months(ledger: DataFrame) -> DataFrame:
    return ledger.select("user_id", month_key("txn_date").alias("month")).distinct().orderBy(
        "user_id", F.col("month").desc()
    )


def learning_status(ledger: DataFrame, as_of: dt.date, params: Params = DEFAULTS) -> DataFrame:
    span = F.col("days_observed") / F.lit(params.learning_days)
    volume = F.col("transactions") / F.lit(params.learning_transactions)
    state = (
        F.when((span >= 1) & (volume >= 1), "complete").when(span < 1, "needs_days").otherwise("needs_transactions")
    )
    return (
        ledger.groupBy("user_id")
        .agg(
            F.min("txn_date").alias("started_on"),
            F.max("txn_date").alias("last_on"),
            F.count("*").alias("transactions"),
        )
        .withColumn("days_observed", F.datediff(F.greatest("last_on", F.lit(as_of)), "started_on"))
        .select(
            "user_id",
            "started_on",
            F.date_add("started_on", params.learning_days).alias("completes_on"),
            "days_observed",
            "transactions",
            rnd(F.least(F.lit(1.0), span, volume) * 100, 1).alias("progress"),
            ((span >= 1) & (volume >= 1)).alias("complete"),
            state.alias("state"),
        )
    )


# --- Months by category -------------------------------------------------------

def month_series(spent: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """One row per (user, category) with its months and amounts, gaps as zero.

    Works on monthly sums, so a row holds at most one value per calendar month
    of the accepted history. The bounds run over all categories of the account;
    the month in progress and later ones are cut after the grid is made.
    """
    account = W.partitionBy("user_id")  # monthly sums: at most months x categories rows
    months = F.sequence("first_month", "last_month", F.expr("INTERVAL 1 MONTH"))
    if as_of is not None:
        months = F.filter(months, lambda m: m < F.trunc(F.lit(as_of), "MM"))
    return (
        spent.withColumn("first_month", F.min("month").over(account))
        .withColumn("last_month", F.max("month").over(account))
        .groupBy("user_id", "category_name", "first_month", "last_month")
        .agg(F.map_from_entries(F.collect_list(F.struct("month", "amount"))).alias("by_month"))
        .withColumn("months", months)
        .select(
            "user_id",
            "category_name",
            "months",
            F.transform(
                "months", lambda m: F.coalesce(F.try_element_at("by_month", m).cast("double"), F.lit(0.0))
            ).alias("values"),
        )
    )


def month_grid(spent: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """The same in long form: user, category, month, amount."""
    pairs = F.explode(F.arrays_zip("months", "values")).alias("cell")
    return month_series(spent, as_of).select("user_id", "category_name", pairs).select(
        "user_id", "category_name", F.col("cell.months").alias("month"), F.col("cell.values").alias("amount")
    )


def month_matrix_wide(spent: DataFrame, category: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Months by categories; the columns are the names of the (small) dimension."""
    names = [r[0] for r in category.select("category_name").orderBy("category_name").collect()]
    return (
        month_grid(spent, as_of).groupBy("user_id", "month").pivot("category_name", names).agg(F.sum("amount"))
    )


def trailing3(grid: DataFrame) -> DataFrame:
    """Mean and median of the last three months, and whether they are all zero."""
    recent = W.partitionBy("user_id", "category_name").orderBy("month").rowsBetween(-2, 0)
    window = F.col("recent")
    ordered, n = F.sort_array(window), F.size(window)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return grid.withColumn("recent", F.collect_list("amount").over(recent)).select(
        "user_id",
        "category_name",
        "month",
        "amount",
        rnd(F.aggregate(window, F.lit(0.0), lambda a, x: a + x) / n).alias("mean3"),
        rnd((low + high) / 2).alias("median3"),
        (F.aggregate(window, F.lit(0.0), lambda a, x: a + x) == 0).alias("dormant"),
    )


# --- Change detection ---------------------------------------------------------

def forecast_signature(ledger: DataFrame, as_of: dt.date) -> DataFrame:
    """Content signature per account of everything a forecast depends on.

    Row digests are summed, so the result does not depend on row order and the
    aggregation combines map-side: no account is ever collected in one place.
    """
    row = F.md5(
        F.concat_ws(
            "|",
            "txn_key",
            F.coalesce("category_name", F.lit("")),
            F.col("amount").cast("string"),
            F.date_format("txn_date", "yyyy-MM-dd"),
        )
    )

    def part(start: int) -> Column:
        return F.conv(F.substring("digest", start, 12), 16, 10).cast("decimal(20,0)")

    return (
        ledger.filter(is_debit() & ~F.coalesce(F.col("is_salary"), F.lit(False)))
        .withColumn("digest", row)
        .groupBy("user_id")
        .agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(13)).alias("b"))
        .select(
            "user_id",
            F.md5(
                F.concat_ws(
                    "|",
                    F.col("n").cast("string"),
                    F.col("a").cast("string"),
                    F.col("b").cast("string"),
                    F.lit(as_of.strftime("%Y-%m")),
                )
            ).alias("signature"),
        )
    )


def changed_accounts(before: DataFrame, now: DataFrame) -> DataFrame:
    """Accounts whose signature is new, different or gone."""
    return (
        before.withColumnRenamed("signature", "old_signature")
        .join(now, "user_id", "full_outer")
        .filter(~F.col("old_signature").eqNullSafe(F.col("signature")))
        .select("user_id")
    )
