"""Ledger lists, slices, validation and ranked rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import channel, collapse, emails_receipt, has_words, normalise
from ..params import DEFAULTS, Params
from ..schema import rnd
from ..sources.sinks import filtered
from .spend import is_debit, not_withdrawal


def rank_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key; Spark limits each task's rows before the shuffle."""
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("position", position).filter(F.col("position") <= n)


def newest_first() -> list[Column]:
    return [F.col("txn_date").desc(), F.col("txn_key").desc()]


def ledger_page(
    ledger: DataFrame,
    category: str | None = None,
    month: str | None = None,
    q: str | None = None,
    page: int = 1,
    per_page: int = 50,
) -> DataFrame:
    """One page per account, newest first, with the account's page count."""
    rows = filtered(ledger, category, month, q)
    pages = rows.groupBy("user_id").agg(F.ceil(F.count("*") / per_page).cast("bigint").alias("total_pages"))
    shown = rank_latest(rows, ["user_id"], newest_first(), page * per_page).filter(
        F.col("position") > (page - 1) * per_page
    )
    return shown.join(pages, "user_id")


def page_after(ledger: DataFrame, after: DataFrame, per_page: int = 50) -> DataFrame:
    """The next page by position key (user_id, last_date, last_key): no deep offset."""
    older = (F.col("txn_date") < F.col("last_date")) | (
        (F.col("txn_date") == F.col("last_date")) & (F.col("txn_key") < F.col("last_key"))
    )
    return rank_latest(ledger.join(after, "user_id").filter(older), ["user_id"], newest_first(), per_page)


def with_items(page: DataFrame, items: DataFrame) -> DataFrame:
    """Page rows with their receipt items nested."""
    mine = items.join(page.select("txn_key"), "txn_key", "left_semi")
    nested = mine.groupBy("txn_key").agg(
        F.sort_array(F.collect_list(F.struct("item_name", "amount", "quantity"))).alias("items")
    )
    return page.join(nested, "txn_key", "left")


def unitemised(ledger: DataFrame, items: DataFrame, newest: int = 40, keep: int = 15) -> DataFrame:
    """Newest debits without items, of which the ones whose merchant sends receipts."""
    bare = ledger.filter(is_debit() & ~F.col("is_salary")).join(items.select("txn_key"), "txn_key", "left_anti")
    recent = rank_latest(bare, ["user_id"], newest_first(), newest).drop("position")
    return rank_latest(recent.filter(emails_receipt("description")), ["user_id"], newest_first(), keep)


def period_slice(
    ledger: DataFrame,
    start: dt.date,
    end: dt.date,
    categories: Sequence[str] = (),
    channel_name: str | None = None,
    merchant: str | None = None,
) -> DataFrame:
    """Debits of an inclusive period; every condition is part of the scan's filter."""
    rows = ledger.filter(is_debit() & not_withdrawal() & F.col("txn_date").between(F.lit(start), F.lit(end)))
    if categories:
        rows = rows.filter(F.col("category_name").isin(*categories))
    if channel_name:
        rows = rows.filter(channel("import_hash", "description") == channel_name)
    if merchant:
        rows = rows.filter(has_words(normalise("description"), F.lit(merchant)))
    return rows


def has_items(ledger: DataFrame, items: DataFrame) -> DataFrame:
    marked = items.select("txn_key").distinct().withColumn("itemised", F.lit(True))
    return (
        ledger.join(marked, "txn_key", "left")
        .withColumn("has_items", F.coalesce("itemised", F.lit(False)))
        .drop("itemised")
    )


def items_with_ledger(items: DataFrame, ledger: DataFrame) -> DataFrame:
    return items.join(ledger.select("txn_key", "user_id", "txn_date", "description"), "txn_key")


# --- Validation -----------------------------------------------------------------

def _number(c: str) -> Column:
    value = F.col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def validate_goals(goals: DataFrame, as_of: dt.date, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``reason``; goal_name, target_amount and target_date are form texts."""
    name = collapse("goal_name")
    amount = F.round(_number("target_amount"), 2)
    day = F.try_to_date(F.trim("target_date"), "yyyy-MM-dd")
    return goals.withColumn(
        "reason",
        F.when(name == "", "name missing")
        .when(F.length(name) > 80, "name too long")
        .when(amount.isNull(), "target is not a number")
        .when(amount <= 0, "target must be positive")
        .when(amount > params.max_amount, "target too large")
        .when(day.isNull(), "date invalid")
        .when(day <= F.lit(as_of), "date not in the future")
        .when(F.year(day) > as_of.year + 100, "date too far"),
    )


def validate_items(items: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    name = F.left(F.trim("item_name"), F.lit(60))
    amount = F.round(_number("amount"), 2)
    quantity = F.coalesce(F.col("quantity").try_cast("int"), F.when(F.col("quantity").isNull(), F.lit(1)))
    return items.withColumn(
        "reason",
        F.when(F.coalesce(name, F.lit("")) == "", "name missing")
        .when(amount.isNull() | ~((amount > 0) & (amount <= params.max_item_price)), "amount out of range")
        .when(quantity.isNull() | ~quantity.between(1, 999), "quantity out of range"),
    )


def validate_profiles(old: DataFrame, new: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``reason`` and ``income_changed``, which drives salary and budget recomputation."""
    name = collapse("full_name")
    amount = F.round(_number("salary_amount"), 2)
    day = F.col("salary_day").try_cast("int")
    before = old.select(
        "user_id",
        F.col("salary_amount").cast("double").alias("old_amount"),
        F.col("salary_day").alias("old_day"),
    )
    changed = (F.round(F.abs(amount - F.col("old_amount")), 8) >= 0.01) | (day != F.col("old_day"))
    reason = (
        F.when((name == "") | (F.length(name) > 80), "name invalid")
        .when(amount.isNull(), "salary is not a number")
        .when(amount <= 0, "salary must be positive")
        .when(amount > params.max_amount, "salary too large")
        .when(day.isNull() | ~day.between(1, 31), "pay day out of range")
    )
    return (
        new.join(before, "user_id", "left")
        .withColumn("reason", reason)
        .withColumn("income_changed", F.col("reason").isNull() & F.coalesce(changed, F.lit(True)))
        .drop("old_amount", "old_day")
    )


def top_spending(ledger: DataFrame, by: str = "category_name", n: int = 3) -> DataFrame:
    """Largest groups per (user, month) with their share of the month."""
    label = F.coalesce(by, F.lit("Uncategorised"))
    groups = (
        ledger.filter(is_debit() & not_withdrawal())
        .groupBy("user_id", F.date_format("txn_date", "yyyy-MM").alias("month"), label.alias("name"))
        .agg(F.sum("amount").alias("total"))
    )
    months = groups.groupBy("user_id", "month").agg(F.sum("total").alias("grand"))
    top = rank_latest(groups, ["user_id", "month"], [F.col("total").desc(), F.col("name")], n)
    share = F.col("total").cast("double") / F.col("grand").cast("double") * 100
    return top.join(months, ["user_id", "month"]).select(
        "user_id", "month", "position", "name", rnd("total").alias("total"), rnd(share, 1).alias("share")
    )
