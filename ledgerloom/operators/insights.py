"""Merchant behaviour: frequent trips, concentration, subscription load, households, channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..functions.text import channel, merchant_key
from ..params import DEFAULTS, DISCRETIONARY, ESSENTIAL, UNCATEGORISED, Params
from ..schema import rnd
from .spend import is_debit, is_spend, not_withdrawal, with_category, with_category_left


def _month_debits(ledger: DataFrame) -> DataFrame:
    return ledger.filter(is_spend()).withColumn("month", month_key("txn_date"))


def high_frequency(ledger: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Merchants of trip categories visited more often than the limit in a month."""
    key = merchant_key("description")
    return (
        _month_debits(ledger)
        .filter(F.col("category_name").isin(*params.trip_categories))
        .withColumn("key", key)
        .filter(F.col("key") != "")
        .groupBy("user_id", "month", "key")
        .agg(
            F.count("*").alias("visits"),
            F.sum("amount").alias("total"),
            F.min_by("description", F.struct("txn_date", "txn_key")).alias("merchant"),
        )
        .filter(F.col("visits") > params.frequent_visits)
        .select("user_id", "month", "key", "merchant", "visits", rnd("total").alias("total"))
    )


def concentration(ledger: DataFrame, category: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The merchant holding over half of a discretionary category in a month.

    Sums run per (category, merchant); the merchant's display name and
    subscription mark come from all its discretionary rows of the month.
    """
    rows = (
        with_category_left(_month_debits(ledger), category)
        .filter((F.col("category_type") == DISCRETIONARY) & (F.col("category_name") != UNCATEGORISED))
        .withColumn("key", F.coalesce(F.nullif(merchant_key("description"), F.lit("")), F.col("description")))
    )
    per_merchant = rows.groupBy("user_id", "month", "category_name", "key").agg(
        F.sum("amount").alias("spend"),
        F.count("*").alias("n"),
        F.min_by("description", F.struct("txn_date", "txn_key")).alias("first_name"),
        F.min(F.struct("txn_date", "txn_key")).alias("first_seen"),
        F.max("is_subscription").alias("flagged"),
    )
    merchants = per_merchant.groupBy("user_id", "month", "key").agg(
        F.min_by("first_name", "first_seen").alias("merchant"), F.max("flagged").alias("flagged")
    )
    per_category = (
        per_merchant.groupBy("user_id", "month", "category_name")
        .agg(
            F.sum("spend").alias("total"),
            F.sum("n").alias("n"),
            F.max(F.struct(F.col("spend"), F.col("key"))).alias("top"),
        )
        .select("user_id", "month", "category_name", "total", "n", "top.spend", "top.key")
        .filter((F.col("total") > 0) & (F.col("n") >= 2))
        .withColumn("ratio", F.col("spend").cast("double") / F.col("total").cast("double"))
        .filter(F.round("ratio", 8) > params.concentration_share)
    )
    subscription = F.col("flagged") | (F.col("category_name") == "Subscriptions")
    return per_category.join(merchants, ["user_id", "month", "key"]).select(
        "user_id",
        "month",
        "category_name",
        "merchant",
        F.when(subscription, "subscription").otherwise("shop_around").alias("variant"),
        rnd("spend").alias("spend"),
        rnd(F.col("ratio") * 100, 1).alias("share"),
        F.when(subscription, rnd(F.col("spend") * 12)).otherwise(0.0).alias("annual"),
    )


def subscription_audit(ledger: DataFrame, profile: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Months whose recurring charges are a heavy share of the salary."""
    load = (
        ledger.filter(is_debit() & F.col("is_subscription"))
        .groupBy("user_id", month_key("txn_date").alias("month"))
        .agg(F.count("*").alias("charges"), F.sum("amount").alias("total"))
        .filter(F.col("charges") >= params.audit_min_count)
        .join(profile.select("user_id", "salary_amount"), "user_id", "left")
        .withColumn("salary", F.coalesce(F.col("salary_amount").cast("double"), F.lit(0.0)))
    )
    total = F.col("total").cast("double")
    return load.filter(
        (total > 0) & (F.round(total - F.col("salary") * params.audit_salary_share, 8) >= 0)
    ).select(
        "user_id",
        "month",
        "charges",
        rnd("total").alias("total"),
        F.when(F.col("salary") > 0, rnd(total / F.col("salary") * 100, 1)).otherwise(0.0).alias("salary_share"),
    )


SUGGESTION_COLUMNS = ("user_id", "month", "severity", "kind", "subject", "amount")


def suggestions(ledger: DataFrame, category: DataFrame, profile: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """All three rules, warnings before information."""
    concentrated = concentration(ledger, category, params).select(
        "user_id",
        "month",
        F.lit("warning").alias("severity"),
        F.concat(F.lit("concentration:"), "variant").alias("kind"),
        F.concat_ws("/", "category_name", "merchant").alias("subject"),
        F.col("spend").alias("amount"),
        F.lit(0).alias("rule"),
    )
    audited = subscription_audit(ledger, profile, params).select(
        "user_id",
        "month",
        F.lit("warning").alias("severity"),
        F.lit("subscription_audit").alias("kind"),
        F.concat(F.col("charges").cast("string"), F.lit(" charges")).alias("subject"),
        F.col("total").alias("amount"),
        F.lit(1).alias("rule"),
    )
    frequent = high_frequency(ledger, params).select(
        "user_id",
        "month",
        F.lit("info").alias("severity"),
        F.lit("high_frequency").alias("kind"),
        F.col("merchant").alias("subject"),
        F.col("total").alias("amount"),
        F.lit(2).alias("rule"),
    )
    return by_severity(concentrated.unionByName(audited).unionByName(frequent), "rule").drop("rule")


def by_severity(alerts: DataFrame, position: str) -> DataFrame:
    """Critical, warning, info; within one severity the original order."""
    order = (
        F.when(F.col("severity") == "critical", 0)
        .when(F.col("severity") == "warning", 1)
        .when(F.col("severity") == "info", 2)
        .otherwise(3)
    )
    return alerts.withColumn("priority", order).orderBy("user_id", "priority", position)


# --- Households ---------------------------------------------------------------

def essential_spend(ledger: DataFrame, category: DataFrame) -> DataFrame:
    per_name = (
        ledger.filter(is_debit() & F.col("category_name").isNotNull())
        .groupBy("user_id", month_key("txn_date").alias("month"), "category_name")
        .agg(F.sum("amount").alias("amount"))
    )
    return with_category(per_name, category).filter(F.col("category_type") == ESSENTIAL).select(
        "user_id", "month", "category_name", "amount"
    )


def _side_by_side(ledger: DataFrame, category: DataFrame, pairs: DataFrame) -> DataFrame:
    members = pairs.select(F.explode(F.array("a", "b")).alias("user_id"), "a", "b")
    return essential_spend(ledger, category).join(members, "user_id")


def household(ledger: DataFrame, category: DataFrame, pairs: DataFrame) -> DataFrame:
    """Essential spending of both accounts of a pair per month, and who owes what."""
    a_spend, b_spend = F.col("a_spend").cast("double"), F.col("b_spend").cast("double")
    fair = (a_spend + b_spend) / 2
    return (
        _side_by_side(ledger, category, pairs)
        .groupBy("a", "b", "month")
        .agg(
            F.sum(F.when(F.col("user_id") == F.col("a"), F.col("amount")).otherwise(0)).alias("a_spend"),
            F.sum(F.when(F.col("user_id") == F.col("b"), F.col("amount")).otherwise(0)).alias("b_spend"),
        )
        .select(
            "a",
            "b",
            "month",
            rnd("a_spend").alias("a_spend"),
            rnd("b_spend").alias("b_spend"),
            rnd(fair).alias("fair_share"),
            rnd(F.greatest(a_spend, b_spend) - fair).alias("owes"),
            F.when(a_spend > b_spend, F.col("b")).otherwise(F.col("a")).alias("ower"),
        )
    )


def household_split(ledger: DataFrame, category: DataFrame, pairs: DataFrame) -> DataFrame:
    return (
        _side_by_side(ledger, category, pairs)
        .groupBy("a", "b", "month", "category_name")
        .agg(
            rnd(F.sum(F.when(F.col("user_id") == F.col("a"), F.col("amount")).otherwise(0))).alias("a_spent"),
            rnd(F.sum(F.when(F.col("user_id") == F.col("b"), F.col("amount")).otherwise(0))).alias("b_spent"),
            rnd(F.sum("amount")).alias("total_spent"),
        )
        .orderBy("a", "b", "month", F.col("total_spent").desc())
    )


# --- Channels -----------------------------------------------------------------

def channel_totals(ledger: DataFrame) -> DataFrame:
    """Spending per (user, month, channel) and its share of the month."""
    per_channel = (
        ledger.filter(is_debit() & not_withdrawal())
        .groupBy("user_id", month_key("txn_date").alias("month"), channel("import_hash", "description").alias("channel"))
        .agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
        .filter(F.col("total") > 0)
    )
    grand = F.sum("total").over(W.partitionBy("user_id", "month"))
    return per_channel.withColumn("grand", grand).select(
        "user_id",
        "month",
        "channel",
        rnd("total").alias("total"),
        "n",
        rnd(F.col("total").cast("double") / F.col("grand").cast("double") * 100, 1).alias("share"),
    )
