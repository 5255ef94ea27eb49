"""Routes tagged questions to the operators that answer them: one job per intent."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import next_payday
from ..functions.text import normalise
from ..operators import blocks, ranges, recurring
from ..operators.views import rank_latest
from ..schema import MONEY, rnd
from ..session import checkpointed
from . import budget as bd
from .questions import PLACES, stopwords

# Every answer has the same columns; ``detail`` is short text, the rest numbers.
COLUMNS = ("conv_id", "turn", "intent", "value", "other", "n", "detail")
CHANNEL_NAMES = ("mtn", "airtel", "bank", "cash")


@dataclass(frozen=True)
class Desk:
    """What answers are made from; items carry user_id, txn_date and description."""

    ledger: DataFrame
    profile: DataFrame
    items: DataFrame
    budget: bd.Budget
    forecasts: DataFrame
    goals: DataFrame
    learning: DataFrame
    as_of: dt.date
    charges: DataFrame | None = None


def _shape(df: DataFrame, value: Column, other: Column | None = None, n: Column | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "conv_id",
        "turn",
        "intent",
        value.cast("double").alias("value"),
        (none if other is None else other).cast("double").alias("other"),
        (none if n is None else n).cast("bigint").alias("n"),
        (none if detail is None else detail).cast("string").alias("detail"),
    )


def _asks(questions: DataFrame) -> DataFrame:
    """Questions as range asks; the id is the question's place."""
    return questions.withColumns(
        {
            "ask_id": F.struct("conv_id", "turn"),
            "start": F.col("period.start"),
            "end": F.col("period.end"),
            "kind": F.col("period.kind"),
            "channel": F.when(F.col("channel") != "all", F.col("channel")),
        }
    )


def _since_ever(asks: DataFrame, as_of: dt.date) -> DataFrame:
    """Questions that name no period look at everything so far."""
    named = F.col("period.explicit")
    return asks.withColumns(
        {
            "start": F.when(named, F.col("start")).otherwise(F.lit(dt.date(1900, 1, 1))),
            "end": F.when(named, F.col("end")).otherwise(F.lit(as_of)),
        }
    )


def _spend(q: DataFrame, d: Desk) -> DataFrame:
    asks = _asks(q)
    got = asks.join(ranges.period_spend(d.ledger, asks), "ask_id", "left").join(
        d.profile.select("user_id", F.col("salary_amount").cast("double").alias("salary")), "user_id", "left"
    )
    total = F.coalesce("total", F.lit(0.0))
    return _shape(got, total, rnd(total / F.col("salary") * 100, 1), F.coalesce("n", F.lit(0)), F.col("period.label"))


def _compare(q: DataFrame, d: Desk) -> DataFrame:
    asks = _asks(q)
    got = asks.join(ranges.compare_periods(d.ledger, asks), "ask_id")
    return _shape(got, F.col("now"), F.col("before"), None, F.col("direction"))


def _income(q: DataFrame, d: Desk) -> DataFrame:
    asks = _asks(q)
    got = asks.join(ranges.period_income(d.ledger, asks), "ask_id", "left")
    return _shape(got, F.coalesce("total", F.lit(0.0)), F.coalesce("salary", F.lit(0.0)), F.coalesce("n", F.lit(0)), F.col("period.label"))


def _count(q: DataFrame, d: Desk) -> DataFrame:
    asks = _asks(q)
    got = asks.select("ask_id", "conv_id", "turn", "intent").join(
        ranges.averages(d.ledger, asks, F.lit(d.as_of)), "ask_id"
    )
    return _shape(got, F.col("total"), F.col("mean"), F.col("n"))


def _average(q: DataFrame, d: Desk) -> DataFrame:
    asks = _asks(q)
    got = asks.select("ask_id", "conv_id", "turn", "intent").join(
        ranges.averages(d.ledger, asks, F.lit(d.as_of)), "ask_id"
    )
    return _shape(got, F.col("per_day"), F.col("total"), F.col("days"))


def _channels(q: DataFrame, d: Desk) -> DataFrame:
    each = _asks(q).withColumn("channel", F.explode(F.array(*map(F.lit, CHANNEL_NAMES)))).withColumns(
        {
            "ask_id": F.struct("conv_id", "turn", "channel"),
            "categories": F.array().cast("array<string>"),
            "merchant": F.lit(None).cast("string"),
        }
    )
    got = each.join(ranges.period_spend(d.ledger, each), "ask_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    parts = F.sort_array(F.collect_list(F.when(F.col("total") > 0, F.struct((-F.col("total")).alias("size"), F.col("channel").alias("name")))))
    whole = got.groupBy("conv_id", "turn", "intent").agg(
        F.sum(F.col("total").cast(MONEY)).alias("total"), F.sum("n").alias("n"), parts.alias("parts")
    )
    listed = F.array_join(F.transform("parts", lambda p: F.concat_ws(" ", p["name"], F.format_number(-p["size"], 2))), "; ")
    return _shape(whole, F.col("total"), None, F.coalesce("n", F.lit(0)), listed)


def _top(q: DataFrame, d: Desk) -> DataFrame:
    """The three largest categories, or places, of each distinct (account, period) asked."""
    asks = _asks(q).withColumn("by_place", F.col("text").rlike(PLACES) | (F.size("categories") > 0))
    span = list(blocks.SPAN)
    listed = blocks.top_names(d.ledger, asks, 3).groupBy(*span).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", "name", "total"))),
                lambda t: F.concat_ws(" ", t["name"], F.format_number(t["total"].cast("double"), 2)),
            ),
            "; ",
        ).alias("listed"),
        F.max("grand").alias("grand"),
        F.count("*").alias("n"),
    )
    got = asks.join(listed, span, "left")
    return _shape(got, rnd(F.coalesce(F.col("grand").cast("double"), F.lit(0.0))), None, F.coalesce("n", F.lit(0)), F.col("listed"))


def _left(q: DataFrame, d: Desk) -> DataFrame:
    cycle = bd.cycle_spend(d.ledger, d.profile, d.as_of)
    whole = bd.safe_to_spend(d.budget, d.learning, cycle, d.as_of).select("user_id", "left", "per_day", "days", "over")
    named = (
        q.select("conv_id", "turn", "user_id", F.explode("categories").alias("category_name"))
        .join(d.budget.lines, ["user_id", "category_name"])
        .groupBy("conv_id", "turn")
        .agg(F.sum(F.col("remaining").cast(MONEY)).alias("category_left"))
    )
    got = q.join(whole, "user_id", "left").join(named, ["conv_id", "turn"], "left")
    left = F.when(F.size("categories") > 0, F.col("category_left").cast("double")).otherwise(F.col("left"))
    per_day = F.when(F.size("categories") == 0, F.col("per_day"))
    return _shape(got, left, per_day, F.col("days"), F.col("over"))


def _afford(q: DataFrame, d: Desk) -> DataFrame:
    asks = q.withColumn("ask_id", F.struct("conv_id", "turn")).select("ask_id", "user_id", "amount", "categories")
    cycle = bd.cycle_spend(d.ledger, d.profile, d.as_of)
    said = bd.afford(asks, d.budget, d.learning, cycle)
    got = q.withColumn("ask_id", F.struct("conv_id", "turn")).join(said.select("ask_id", "pool", "verdict"), "ask_id")
    return _shape(got, F.col("pool"), F.col("amount"), None, F.col("verdict"))


def _payday(q: DataFrame, d: Desk) -> DataFrame:
    day = next_payday(F.lit(d.as_of), "salary_day")
    got = q.join(d.profile.select("user_id", day.alias("payday")), "user_id", "left")
    return _shape(got, F.lit(None), None, F.datediff("payday", F.lit(d.as_of)), F.date_format("payday", "yyyy-MM-dd"))


def _forecast(q: DataFrame, d: Desk) -> DataFrame:
    total = d.forecasts.groupBy("user_id").agg(F.sum(F.col("amount").cast(MONEY)).alias("total"), F.count("*").alias("n"))
    named = (
        q.select("conv_id", "turn", "user_id", F.explode("categories").alias("category_name"))
        .join(d.forecasts, ["user_id", "category_name"])
        .groupBy("conv_id", "turn")
        .agg(F.sum(F.col("amount").cast(MONEY)).alias("named_total"), F.max("method").alias("method"))
    )
    got = q.join(total, "user_id", "left").join(named, ["conv_id", "turn"], "left")
    asked = F.size("categories") > 0
    return _shape(got, F.when(asked, F.col("named_total")).otherwise(F.col("total")), None, F.col("n"), F.when(asked, F.col("method")))


def _goals(q: DataFrame, d: Desk) -> DataFrame:
    first = rank_latest(d.goals, ["user_id"], [F.col("target_date"), F.col("goal_id")], 3)
    listed = first.groupBy("user_id").agg(
        F.sum(F.col("monthly_required").cast(MONEY)).alias("monthly"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", "goal_name", "progress"))),
                lambda g: F.format_string("%s %.0f%%", g["goal_name"], g["progress"]),
            ),
            "; ",
        ).alias("listed"),
        F.count("*").alias("n"),
    )
    got = q.join(listed, "user_id", "left")
    return _shape(got, F.col("monthly"), None, F.coalesce("n", F.lit(0)), F.col("listed"))


def _subscriptions(q: DataFrame, d: Desk) -> DataFrame:
    got = q.join(recurring.recurring_summary(d.charges), "user_id", "left")
    return _shape(got, F.coalesce("monthly_total", F.lit(0.0)), F.coalesce("annual_total", F.lit(0.0)), F.coalesce("count", F.lit(0)))


def _recent(q: DataFrame, d: Desk) -> DataFrame:
    """The five newest matching rows of each question."""
    asks = _since_ever(_asks(q), d.as_of)
    five = blocks.newest(d.ledger, asks, 5)
    listed = five.groupBy("ask_id").agg(
        F.count("*").alias("n"),
        F.sum("amount").alias("total"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "description"))), lambda x: x["description"]), "; ").alias("listed"),
    )
    got = asks.join(listed, "ask_id", "left")
    return _shape(got, F.coalesce(F.col("total").cast("double"), F.lit(0.0)), None, F.coalesce("n", F.lit(0)), F.col("listed"))


def _receipt(q: DataFrame, d: Desk) -> DataFrame:
    """Item lines of a merchant, of an item word, or of everything."""
    asks = _since_ever(_asks(q), d.as_of)
    subject = (
        F.when(F.col("merchant").isNotNull(), F.concat(F.lit("m="), "merchant"))
        .when(F.col("receipt_item").isNotNull(), F.concat(F.lit("i="), "receipt_item"))
        .otherwise("*")
    )
    keyed = asks.withColumn("subject", subject).select("ask_id", "user_id", "subject", "start", "end")

    def spoken(c: str, mark: str) -> Column:
        return F.transform(F.array_distinct(ranges.phrases(normalise(c))), lambda p: F.concat(F.lit(mark), p))

    facts = (
        d.items.select(
            "user_id", F.col("txn_date").alias("day"), "amount",
            F.explode(F.concat(F.array(F.lit("*")), spoken("description", "m="), spoken("item_name", "i="))).alias("subject"),
        )
        .join(keyed.select("user_id", "subject").distinct(), ["user_id", "subject"], "left_semi")
        .groupBy("user_id", "subject", "day")
        .agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    )
    got = asks.join(ranges.range_totals(facts, keyed), "ask_id", "left")
    return _shape(got, F.coalesce("total", F.lit(0.0)), None, F.coalesce("n", F.lit(0)), F.coalesce("merchant", "receipt_item"))


def _whatif(q: DataFrame, d: Desk) -> DataFrame:
    asks = q.withColumn("ask_id", F.struct("conv_id", "turn"))
    said = bd.whatif(
        asks.select("ask_id", "user_id", "text", "amount", "categories"),
        d.charges, d.budget, d.goals, stopwords(),
    )
    got = asks.join(said.select("ask_id", "source", "monthly_saving", "annual_saving", "months_after"), "ask_id")
    return _shape(got, F.col("monthly_saving"), F.col("annual_saving"), F.col("months_after"), F.col("source"))


def _cutback(q: DataFrame, d: Desk) -> DataFrame:
    listed = (
        bd.cutback(d.budget.lines)
        .groupBy("user_id")
        .agg(
            F.max(F.when(F.col("kind") == "trim", F.col("amount"))).alias("trim"),
            F.count("*").alias("n"),
            F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "kind", "category_name"))), "; ").alias("listed"),
        )
    )
    got = q.join(listed, "user_id", "left")
    return _shape(got, F.col("trim"), None, F.coalesce("n", F.lit(0)), F.col("listed"))


HANDLERS = {
    "spend": _spend, "compare": _compare, "left": _left, "afford": _afford, "top": _top, "forecast": _forecast,
    "goals": _goals, "subscriptions": _subscriptions, "income": _income, "payday": _payday, "recent": _recent,
    "count": _count, "average": _average, "whatif": _whatif, "cutback": _cutback, "receipt": _receipt,
    "channels": _channels,
}


def answer(questions: DataFrame, desk: Desk) -> DataFrame:
    """One row per question. Help and unknown questions have no numbers.

    The tagged questions and the budget tables are written once and read by
    every intent's part.
    """
    q = checkpointed(questions)
    kept = Desk(
        desk.ledger,
        desk.profile,
        desk.items,
        bd.Budget(checkpointed(desk.budget.lines), checkpointed(desk.budget.summary)),
        checkpointed(desk.forecasts),
        checkpointed(desk.goals),
        checkpointed(desk.learning),
        desk.as_of,
        checkpointed(recurring.recurring(desk.ledger)),
    )
    known = F.coalesce(F.col("intent").isin(*HANDLERS), F.lit(False))
    out = _shape(q.filter(~known), F.lit(None), detail=F.when(F.col("intent") == "help", "help").otherwise("unknown"))
    for intent, handler in HANDLERS.items():
        out = out.unionByName(handler(q.filter(F.col("intent") == intent), kept))
    return out
