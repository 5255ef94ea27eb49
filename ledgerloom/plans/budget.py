"""Goals, budgets, alerts and the answers computed from them, for all accounts at once.

Inputs here are already monthly or per-account aggregates: a few rows per
account, so the per-account windows and joins below stay small.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import last_payday, months_until, next_payday
from ..functions.text import normalise
from ..operators.insights import by_severity
from ..operators.spend import is_debit, not_withdrawal
from ..operators.views import rank_latest
from ..params import DEFAULTS, DISCRETIONARY, ESSENTIAL, Params
from ..schema import MONEY, rnd


def _money(c: Column | str) -> Column:
    return rnd(c).cast(MONEY)


# --- Goals ------------------------------------------------------------------------

def goal_waterfall(goals: DataFrame, pool: DataFrame, as_of: dt.date) -> DataFrame:
    """Fund goals from the pool in order of target date, then id.

    The running total is made in two steps, over the days of an account and
    then inside one day, so no single sort holds all goals of an account.
    """
    per_day = goals.groupBy("user_id", "target_date").agg(F.sum("target_amount").alias("day_total"))
    days = W.partitionBy("user_id").orderBy("target_date").rowsBetween(W.unboundedPreceding, -1)
    before_day = per_day.select(
        "user_id", "target_date", F.coalesce(F.sum("day_total").over(days), F.lit(0)).alias("before_day")
    )
    same_day = W.partitionBy("user_id", "target_date").orderBy("goal_id").rowsBetween(W.unboundedPreceding, -1)
    target = F.col("target_amount").cast("double")
    free = F.col("pool") - (F.col("before_day") + F.col("earlier")).cast("double")
    saved = F.greatest(F.lit(0.0), F.least(free, target))
    return (
        goals.withColumn("earlier", F.coalesce(F.sum("target_amount").over(same_day), F.lit(0)))
        .join(before_day, ["user_id", "target_date"])
        .join(pool.select("user_id", F.col("pool").cast("double").alias("pool")), "user_id", "left")
        .withColumn("pool", F.coalesce("pool", F.lit(0.0)))
        .withColumn("raw_saved", saved)
        .withColumn("raw_shortfall", F.greatest(F.lit(0.0), target - F.col("raw_saved")))
        .withColumn("months_remaining", months_until("target_date", F.lit(as_of)))
        .select(
            "user_id",
            "goal_id",
            "goal_name",
            target.alias("target_amount"),
            "target_date",
            "months_remaining",
            rnd("raw_saved").alias("saved"),
            rnd("raw_shortfall").alias("shortfall"),
            F.when(target > 0, rnd(F.least(F.lit(100.0), F.col("raw_saved") / target * 100), 1)).otherwise(0.0).alias("progress"),
            rnd(F.col("raw_shortfall") / F.col("months_remaining")).alias("monthly_required"),
            (F.col("target_date") < F.lit(as_of)).alias("overdue"),
        )
    )


# --- Budget -----------------------------------------------------------------------

@dataclass(frozen=True)
class Budget:
    lines: DataFrame
    summary: DataFrame


def month_debits(ledger: DataFrame, month: str) -> DataFrame:
    """All real spending of one month per account, categorised or not."""
    start = dt.date.fromisoformat(month + "-01")
    end = (start + dt.timedelta(days=32)).replace(day=1)
    in_month = (F.col("txn_date") >= F.lit(start)) & (F.col("txn_date") < F.lit(end))
    return (
        ledger.filter(is_debit() & not_withdrawal() & in_month)
        .groupBy("user_id")
        .agg(F.sum("amount").alias("spent_total"))
    )


def build_budget(
    profile: DataFrame,
    forecasts: DataFrame,
    spent: DataFrame,
    debits: DataFrame,
    goals: DataFrame,
    category: DataFrame,
    month: str,
    params: Params = DEFAULTS,
) -> Budget:
    """Essentials first with headroom, then savings, the rest to discretionary.

    ``spent`` is the monthly spending per category, ``debits`` the account
    total of the month, ``goals`` the funded goals.
    """
    zero = F.lit(0).cast(MONEY)
    essential = F.col("category_type") == ESSENTIAL
    buffered = _money(F.col("forecast") * (1 + params.essential_buffer))
    wanted = (
        forecasts.join(category, "category_name")
        .join(
            spent.filter(F.col("month") == month).select("user_id", "category_name", "spent"),
            ["user_id", "category_name"],
            "left",
        )
        .select(
            "user_id",
            "category_name",
            "category_type",
            F.col("amount").cast(MONEY).alias("forecast"),
            "method",
            "basis",
            F.coalesce(F.col("spent").cast(MONEY), zero).alias("spent"),
        )
    )
    totals = wanted.groupBy("user_id").agg(
        F.sum(F.when(essential, buffered).otherwise(zero)).alias("essential_total"),
        F.sum(F.when(essential, zero).otherwise(F.col("forecast"))).alias("discretionary_forecast"),
    )
    reserved = goals.groupBy("user_id").agg(
        F.sum(F.col("monthly_required").cast(MONEY)).alias("goal_total"), F.count("*").alias("n_goals")
    )

    def known(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("double")

    frame = (
        profile.select("user_id", F.col("salary_amount").cast("double").alias("salary"))
        .join(totals, "user_id", "left")
        .join(reserved, "user_id", "left")
        .join(debits, "user_id", "left")
        .select(
            "user_id",
            "salary",
            known("essential_total").alias("essential_total"),
            known("discretionary_forecast").alias("discretionary_forecast"),
            known("goal_total").alias("goal_total"),
            known("spent_total").alias("spent_total"),
        )
        .withColumn("available", F.col("salary") - F.col("essential_total") - F.col("goal_total"))
        .withColumn(
            "overcommitted",
            (F.col("discretionary_forecast") > 0)
            & (F.round(F.col("available") - F.col("discretionary_forecast"), 8) < 0),
        )
        .withColumn(
            "scale",
            F.when(
                F.col("overcommitted"),
                F.greatest(F.lit(0.0), F.col("available") / F.col("discretionary_forecast")),
            ).otherwise(1.0),
        )
    )

    allocation, used = F.col("recommended").cast("double"), F.col("spent").cast("double")
    has_allocation = F.col("recommended") != 0
    used_pct = F.when(has_allocation, rnd(used / allocation * 100, 1)).otherwise(0.0)
    explanation = (
        F.when(essential, F.concat("basis", F.lit(f"; {params.essential_buffer * 100:.0f}% headroom added")))
        .when(
            F.col("overcommitted"),
            F.concat("basis", F.format_string("; trimmed to %.0f%% of forecast", F.col("scale") * 100)),
        )
        .otherwise(F.concat("basis", F.lit("; covered in full")))
    )
    lines = (
        wanted.join(frame.select("user_id", "salary", "overcommitted", "scale"), "user_id")
        .withColumn(
            "recommended",
            F.when(essential, buffered).otherwise(_money(F.col("forecast").cast("double") * F.col("scale"))),
        )
        .withColumn("used_pct", used_pct)
        .select(
            "user_id",
            F.lit(month).alias("month"),
            "category_name",
            "category_type",
            F.col("forecast").cast("double").alias("forecast"),
            "method",
            explanation.alias("explanation"),
            allocation.alias("recommended"),
            used.alias("spent"),
            rnd(F.col("recommended") - F.col("spent")).alias("remaining"),
            "used_pct",
            F.when(F.col("salary") > 0, rnd(allocation / F.col("salary") * 100, 1)).otherwise(0.0).alias("pct_of_salary"),
            (~essential & F.col("overcommitted")).alias("scaled"),
            F.when(has_allocation & (F.col("spent") >= F.col("recommended")), "over")
            .when(has_allocation & (F.col("used_pct") >= params.nudge_pct), "warning")
            .otherwise("ok")
            .alias("status"),
        )
    )

    line_totals = lines.groupBy("user_id").agg(
        F.sum(F.when(essential, zero).otherwise(F.col("recommended").cast(MONEY))).alias("discretionary_total"),
        F.sum(F.greatest(F.lit(0.0), F.col("remaining")).cast(MONEY)).alias("open_budget"),
    )
    projected = F.col("salary") - F.col("spent_total") - F.col("open_budget")
    allocated = F.col("essential_total") + F.col("discretionary_total")
    summary = (
        frame.join(line_totals, "user_id", "left")
        .withColumn("discretionary_total", known("discretionary_total"))
        .withColumn("open_budget", known("open_budget"))
        .withColumn("recommended_savings", rnd(F.greatest(F.lit(0.0), projected)))
        .select(
            "user_id",
            F.lit(month).alias("month"),
            rnd("salary").alias("salary"),
            rnd("essential_total").alias("essential_total"),
            rnd("discretionary_total").alias("discretionary_total"),
            rnd(allocated).alias("allocated_total"),
            rnd(F.col("salary") - allocated - F.col("goal_total")).alias("surplus"),
            "recommended_savings",
            F.when(F.col("salary") > 0, rnd(F.col("recommended_savings") / F.col("salary") * 100, 1)).otherwise(0.0).alias("savings_rate"),
            rnd("goal_total").alias("goal_total"),
            "overcommitted",
            (F.round(F.col("essential_total") - F.col("salary"), 8) > 0).alias("essentials_exceed_income"),
            rnd(F.greatest(F.lit(0.0), allocated + F.col("goal_total") - F.col("salary"))).alias("deficit"),
            rnd("scale", 3).alias("scale"),
            rnd("spent_total").alias("spent_total"),
        )
    )
    return Budget(lines, summary)


def chart_lines(lines: DataFrame, n: int = 8) -> DataFrame:
    """The largest budget lines of each account, in chart order."""
    return rank_latest(lines, ["user_id"], [F.col("recommended").desc(), F.col("category_name")], n)


# --- Alerts -----------------------------------------------------------------------

def alerts(budget: Budget, recurring_summary: DataFrame, cycle: DataFrame) -> DataFrame:
    """Everything worth raising, most severe first; one row per alert."""
    def row(df: DataFrame, severity: Column | str, kind: Column | str, subject: Column, amount: Column, position: Column) -> DataFrame:
        as_lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(
            "user_id",
            as_lit(severity).alias("severity"),
            as_lit(kind).alias("kind"),
            subject.alias("subject"),
            amount.cast("double").alias("amount"),
            position.alias("position"),
        )

    by_size = W.partitionBy("user_id").orderBy(F.col("recommended").desc(), F.col("category_name"))
    flagged = budget.lines.withColumn("rank", F.row_number().over(by_size)).filter(
        (F.col("recommended") > 0) & F.col("status").isin("over", "warning")
    )
    over = F.col("status") == "over"
    line_alerts = row(
        flagged,
        F.when(over, "critical").otherwise("warning"),
        F.when(over, "over_budget").otherwise("near_budget"),
        F.col("category_name"),
        F.when(over, F.col("spent") - F.col("recommended")).otherwise(F.col("remaining")),
        F.col("rank"),
    )
    s = budget.summary
    income = row(
        s.filter("essentials_exceed_income OR overcommitted"),
        "critical",
        F.when(F.col("essentials_exceed_income"), "essentials_exceed_income").otherwise("overcommitted"),
        F.lit("Budget"),
        F.when(F.col("essentials_exceed_income"), F.col("deficit")).otherwise(F.col("essential_total") + F.col("goal_total")),
        F.lit(1_000),
    )
    slipping = row(
        s.filter("recommended_savings < goal_total"),
        "critical",
        "goals_slipping",
        F.lit("Savings"),
        F.col("goal_total") - F.col("recommended_savings"),
        F.lit(1_001),
    )
    charges = row(
        recurring_summary.filter("count > 0 AND monthly_total > 0"),
        "info",
        "recurring_charges",
        F.format_string("%d recurring charges", "count"),
        F.col("monthly_total"),
        F.lit(1_002),
    )
    surge = row(
        cycle.filter("has_surge"), "info", "payday_surge", F.lit("Spending pattern"), F.col("surge_share"), F.lit(1_003)
    )
    out = line_alerts
    for part in (income, slipping, charges, surge):
        out = out.unionByName(part)
    return by_severity(out.withColumn("amount", rnd("amount")), "position")


def alert_message(currency: str = DEFAULTS.currency) -> Column:
    """Text of an alert row, as a last projection."""
    k = F.col("kind")
    amount = F.format_number("amount", 2)
    return (
        F.when(k == "over_budget", F.format_string("%s is %s " + currency + " over budget", "subject", amount))
        .when(k == "near_budget", F.format_string("%s has %s " + currency + " left this month", "subject", amount))
        .when(k == "essentials_exceed_income", F.format_string("Essentials exceed the salary by %s " + currency, amount))
        .when(k == "overcommitted", F.format_string("Essentials and savings already take %s " + currency, amount))
        .when(k == "goals_slipping", F.format_string("Savings fall %s " + currency + " short of the goals", amount))
        .when(k == "recurring_charges", F.format_string("%s cost %s " + currency + " a month", "subject", amount))
        .otherwise(F.format_string("%s%% of spending lands in week 1", amount))
    )


# --- Savings and reports ------------------------------------------------------------

def savings_position(goals: DataFrame, pool: DataFrame, summary: DataFrame) -> DataFrame:
    """Goals with their pool and whether the monthly need fits the budgeted savings."""
    funded = goals.groupBy("user_id").agg(F.sum(F.col("saved").cast(MONEY)).alias("allocated"))
    accounts = (
        pool.join(funded, "user_id", "left")
        .join(summary.select("user_id", "recommended_savings"), "user_id", "left")
        .select(
            "user_id",
            "income",
            "expenses",
            "pool",
            rnd(F.greatest(F.lit(0.0), F.col("pool") - F.coalesce(F.col("allocated").cast("double"), F.lit(0.0)))).alias("unallocated"),
            F.coalesce("recommended_savings", F.lit(0.0)).alias("recommended_monthly"),
            F.col("recommended_savings").isNotNull().alias("has_budget"),
        )
    )
    on_track = F.col("has_budget") & (F.col("monthly_required") <= F.col("recommended_monthly"))
    return goals.join(accounts, "user_id").withColumn("on_track", on_track).drop("has_budget")


def report_lines(spent: DataFrame, budget_lines: DataFrame, category: DataFrame) -> DataFrame:
    """Actual against recommended per (user, month, category); either side may be missing."""
    keys = ["user_id", "month", "category_name"]
    variance = F.col("recommended") - F.col("actual")
    return (
        spent.select(*keys, F.col("spent").alias("actual"))
        .join(budget_lines.select(*keys, rnd("recommended").alias("recommended")), keys, "full_outer")
        .join(category, "category_name", "left")
        .withColumn("actual", rnd(F.coalesce("actual", F.lit(0.0))))
        .withColumn("variance", rnd(variance))
        .select(
            *keys,
            F.coalesce("category_type", F.lit("")).alias("category_type"),
            "actual",
            "recommended",
            "variance",
            F.when(F.col("variance") < 0, "over").when(F.col("variance").isNotNull(), "under").otherwise("no-budget").alias("status"),
        )
    )


def month_report(lines: DataFrame, totals: DataFrame, month: str) -> DataFrame:
    """One month: the report lines with the account's income, expenditure and net."""
    head = totals.filter(F.col("month") == month)
    return head.join(lines.filter(F.col("month") == month).drop("month"), "user_id", "left").orderBy(
        "user_id", "category_name"
    )


# --- Answers from the budget ----------------------------------------------------------

def cycle_spend(ledger: DataFrame, profile: DataFrame, as_of: dt.date) -> DataFrame:
    """Spending since the last pay day, per account, with the free part of the salary."""
    recent = ledger.filter(
        is_debit()
        & not_withdrawal()
        & F.col("txn_date").between(F.lit(as_of - dt.timedelta(days=62)), F.lit(as_of))
    )
    daily = recent.groupBy("user_id", "txn_date").agg(F.sum("amount").alias("amount"))
    start = last_payday(F.lit(as_of), "salary_day")
    spent = (
        daily.join(profile.select("user_id", "salary_day"), "user_id")
        .filter(F.col("txn_date") >= start)
        .groupBy("user_id")
        .agg(F.sum("amount").alias("cycle_spent"))
    )
    return profile.join(spent, "user_id", "left").select(
        "user_id",
        "salary_day",
        F.col("salary_amount").cast("double").alias("salary"),
        F.coalesce(F.col("cycle_spent").cast("double"), F.lit(0.0)).alias("cycle_spent"),
    )


def safe_to_spend(budget: Budget, learning: DataFrame, cycle: DataFrame, as_of: dt.date) -> DataFrame:
    """What is left and per day until pay day; before learning completes, of the salary."""
    left = budget.lines.groupBy("user_id").agg(
        F.sum(F.col("remaining").cast(MONEY)).alias("budget_left"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "over", F.col("category_name")))).alias("over"),
    )
    payday = next_payday(F.lit(as_of), "salary_day")
    ready = F.coalesce("complete", F.lit(False))
    remaining = F.when(ready, F.coalesce(F.col("budget_left").cast("double"), F.lit(0.0))).otherwise(
        F.col("salary") - F.col("cycle_spent")
    )
    return (
        cycle.join(learning.select("user_id", "complete"), "user_id", "left")
        .join(left, "user_id", "left")
        .withColumn("payday", payday)
        .withColumn("days", F.greatest(F.lit(1), F.datediff("payday", F.lit(as_of))))
        .withColumn("left", remaining)
        .select(
            "user_id",
            F.when(ready, "budget").otherwise("salary").alias("basis"),
            rnd("left").alias("left"),
            "payday",
            "days",
            rnd(F.greatest(F.lit(0.0), F.col("left")) / F.col("days")).alias("per_day"),
            F.when(ready, F.array_join(F.coalesce("over", F.array()), ", ")).otherwise("").alias("over"),
        )
    )


def afford(asks: DataFrame, budget: Budget, learning: DataFrame, cycle: DataFrame) -> DataFrame:
    """Whether an amount fits: asks are (ask_id, user_id, amount, categories)."""
    room = F.greatest(F.lit(0.0), F.col("remaining")).cast(MONEY)
    free = budget.lines.groupBy("user_id").agg(
        F.sum(F.when(F.col("category_type") == DISCRETIONARY, room).otherwise(0)).alias("discretionary_room")
    )
    named = (
        asks.select("ask_id", "user_id", F.explode("categories").alias("category_name"))
        .join(budget.lines, ["user_id", "category_name"])
        .groupBy("ask_id")
        .agg(F.sum(room).alias("category_room"))
    )
    ready = F.coalesce("complete", F.lit(False))

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    pool = (
        F.when(~ready, F.col("salary") - F.col("cycle_spent"))
        .when(F.size("categories") > 0, known("category_room"))
        .otherwise(known("discretionary_room"))
    )
    savings = F.when(ready, known("recommended_savings")).otherwise(0.0)
    return (
        asks.join(cycle, "user_id", "left")
        .join(learning.select("user_id", "complete"), "user_id", "left")
        .join(budget.summary.select("user_id", "recommended_savings"), "user_id", "left")
        .join(free, "user_id", "left")
        .join(named, "ask_id", "left")
        .withColumn("pool", pool)
        .withColumn("savings", savings)
        .select(
            "ask_id",
            "user_id",
            "amount",
            rnd("pool").alias("pool"),
            F.when(F.col("amount").isNull(), "ask_price")
            .when(F.round(F.col("amount") - F.col("pool"), 8) <= 0, "yes")
            .when(ready & (F.round(F.col("amount") - F.col("pool") - F.col("savings"), 8) <= 0), "from_savings")
            .otherwise("not_now")
            .alias("verdict"),
        )
    )


# Words of a what-if question that never name a charge.
WHATIF_WORDS = (
    "what", "cancel", "cancelling", "cut", "trim", "reduce", "drop", "stop", "save", "month", "monthly",
    "year", "subscription",
)


def whatif(
    asks: DataFrame, recurring: DataFrame, budget: Budget, goals: DataFrame, stopwords: list[str]
) -> DataFrame:
    """Saving of a scenario and its effect on the nearest unfunded goal.

    asks are (ask_id, user_id, text, amount, categories). A recurring charge
    named by a word of the question wins, then an explicit amount, then a fifth
    of the named categories' budget.
    """
    def words(text: Column) -> Column:
        return F.array_distinct(F.split(normalise(text), " "))

    ignored = F.array(*[F.lit(w) for w in (*stopwords, *WHATIF_WORDS)])
    asked = F.filter(words(F.col("text")), lambda w: F.length(w) >= 3)
    asked_words = asks.select("ask_id", "user_id", F.explode(F.array_except(asked, ignored)).alias("word"))
    order = F.struct(-F.col("monthly_amount"), F.col("key"))
    charge_words = recurring.select(
        "user_id",
        F.explode(words(F.concat_ws(" ", "label", "key"))).alias("word"),
        order.alias("order"),
        "label",
        "monthly_amount",
    )
    # One charge per (account, word), so a question meets at most one row per word.
    best_word = charge_words.groupBy("user_id", "word").agg(
        F.min(F.struct("order", "label", "monthly_amount")).alias("charge")
    )
    cancelled = (
        asked_words.join(best_word, ["user_id", "word"])
        .groupBy("ask_id")
        .agg(F.min("charge").alias("charge"))
        .select("ask_id", F.col("charge.label").alias("label"), F.col("charge.monthly_amount").alias("charge_saving"))
    )
    trimmed = (
        asks.select("ask_id", "user_id", F.explode("categories").alias("category_name"))
        .join(budget.lines, ["user_id", "category_name"])
        .groupBy("ask_id")
        .agg(F.sum(F.col("recommended").cast(MONEY)).alias("category_budget"))
    )
    nearest = (
        goals.filter("shortfall > 0")
        .groupBy("user_id")
        .agg(F.min_by(F.struct("goal_name", "shortfall"), F.struct("target_date", "goal_id")).alias("goal"))
    )
    cancelling = F.regexp_extract(F.lower("text"), r"\bcancel(?:ling)?\s+(?:my\s+|the\s+)?([a-z0-9])", 1) != ""
    trim = rnd(F.col("category_budget").cast("double") * 0.20)
    unknown = (
        F.col("charge_saving").isNull() & cancelling & F.col("amount").isNull() & (F.size("categories") == 0)
    )
    saving = F.coalesce(
        F.col("charge_saving"), F.nullif(F.col("amount"), F.lit(0.0)), F.when(trim > 0, trim)
    )
    source = (
        F.when(unknown, "unknown_charge")
        .when(F.col("charge_saving").isNotNull(), "cancel")
        .when(F.col("amount") > 0, "amount")
        .when(trim > 0, "trim")
        .otherwise("none")
    )
    rate = F.coalesce("recommended_savings", F.lit(0.0))
    new_months = F.greatest(F.lit(1), F.ceil(F.col("goal.shortfall") / (rate + F.col("saving"))))
    old_months = F.when(rate > 0, F.greatest(F.lit(1), F.ceil(F.col("goal.shortfall") / rate)))
    has_saving = F.col("saving") > 0
    return (
        asks.join(cancelled, "ask_id", "left")
        .join(trimmed, "ask_id", "left")
        .join(nearest, "user_id", "left")
        .join(budget.summary.select("user_id", "recommended_savings"), "user_id", "left")
        .withColumn("source", source)
        .withColumn("saving", F.when(F.col("source") != "unknown_charge", saving))
        .select(
            "ask_id",
            "user_id",
            "source",
            F.when(F.col("source") == "cancel", F.col("label")).alias("label"),
            rnd("saving").alias("monthly_saving"),
            rnd(F.col("saving") * 12).alias("annual_saving"),
            F.when(has_saving, F.col("goal.goal_name")).alias("goal_name"),
            F.when(has_saving, old_months).cast("bigint").alias("months_before"),
            F.when(has_saving, new_months).cast("bigint").alias("months_after"),
        )
    )


def cutback(lines: DataFrame) -> DataFrame:
    """Over budget and near the limit (three each), and a fifth of the largest want."""
    size = [F.col("recommended").desc(), F.col("category_name")]
    over = rank_latest(lines.filter("status = 'over'"), ["user_id"], size, 3).select(
        "user_id", F.lit("over").alias("kind"), "category_name", rnd(F.col("spent") - F.col("recommended")).alias("amount")
    )
    near = rank_latest(lines.filter("status = 'warning'"), ["user_id"], size, 3).select(
        "user_id", F.lit("near").alias("kind"), "category_name", rnd(F.col("spent") / F.col("recommended") * 100, 1).alias("amount")
    )
    wants = lines.filter((F.col("category_type") == DISCRETIONARY) & (F.col("spent") > 0))
    trim = rank_latest(wants, ["user_id"], [F.col("spent").desc(), *size], 1).select(
        "user_id", F.lit("trim").alias("kind"), "category_name", rnd(F.col("spent") * 0.20).alias("amount")
    )
    return over.unionByName(near).unionByName(trim)


def forecast_summary(forecasts: DataFrame, n: int = 3) -> DataFrame:
    """Next month's total and its largest categories."""
    total = forecasts.groupBy("user_id").agg(F.sum(F.col("amount").cast(MONEY)).alias("total"))
    top = rank_latest(forecasts, ["user_id"], [F.col("amount").desc(), F.col("category_name")], n)
    return top.join(total, "user_id").select(
        "user_id", "position", "category_name", "amount", "method", F.col("total").cast("double").alias("total")
    )


def usage_band(pct: Column) -> Column:
    return F.when(pct < 75, "green").when(pct < 95, "yellow").otherwise("red")


def goal_band(pct: Column) -> Column:
    return F.when(pct < 40, "red").when(pct < 80, "yellow").otherwise("green")


def kpis(budget: Budget) -> DataFrame:
    """Shares of salary per account and the usage band of each line."""
    def share(c: str) -> Column:
        return F.when(F.col("salary") > 0, rnd(F.col(c) / F.col("salary") * 100, 1)).otherwise(0.0)

    heads = budget.summary.select(
        "user_id",
        share("essential_total").alias("essential_share"),
        share("discretionary_total").alias("discretionary_share"),
        share("allocated_total").alias("allocated_share"),
    )
    return budget.lines.join(heads, "user_id").select(
        "user_id", "category_name", "essential_share", "discretionary_share", "allocated_share",
        usage_band(F.col("used_pct")).alias("band"),
    )


def month_of(day: dt.date) -> str:
    return day.strftime("%Y-%m")


