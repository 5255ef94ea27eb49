"""Totals over many date ranges at once, by running sums instead of range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import channel, normalise
from ..schema import MONEY, rnd
from .spend import is_credit, is_debit, not_withdrawal

ANY = "*"


def subject_key(category: Column, channel_name: Column) -> Column:
    return F.concat(F.lit("c="), category, F.lit("|ch="), channel_name)


def merchant_subject(phrase: Column) -> Column:
    return F.concat(F.lit("m="), phrase)


def phrases(text: Column, sizes: tuple[int, ...] = (3, 2, 1)) -> Column:
    """Word n-grams of a normalised text, longer ones first.

    Runs of words are found by a pattern at each word's start, in one pass a size: a lambda over the
    words would split the text again for each of them.
    """

    def runs(size: int) -> Column:
        if size == 1:
            return F.array_remove(F.split(text, " "), "")
        pattern = rf"(?:^|(?<= ))(?=([^ ]++(?: [^ ]++){{{size - 1}}}))"
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    return F.concat(*map(runs, sizes))


def daily_spending(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """user, subject, day, amount, n of the asked subjects: everything, a category,
    a channel, both, or a merchant phrase.

    Spending is summed before it is multiplied by subjects: by day, category,
    channel and text first. Categories and channels need no text; phrases are
    taken from the distinct texts of an account and only asked ones go on.
    """
    asked = wanted.select("user_id", "subject").distinct()
    sums = [F.sum("amount").cast("decimal(28,2)").alias("amount"), F.sum("n").alias("n")]
    rows = ledger.filter(is_debit() & not_withdrawal()).select(
        "user_id",
        F.col("txn_date").alias("day"),
        F.coalesce("category_name", F.lit("")).alias("name"),
        channel("import_hash", "description").alias("wallet"),
        normalise("description").alias("text"),
        "amount",
        F.lit(1).cast("bigint").alias("n"),
    )
    spent = rows.groupBy("user_id", "day", "name", "wallet", "text").agg(*sums)
    any_, name, wallet = F.lit(ANY), F.col("name"), F.col("wallet")
    fixed = F.array(subject_key(any_, any_), subject_key(any_, wallet), subject_key(name, any_), subject_key(name, wallet))
    by_kind = (
        spent.groupBy("user_id", "day", "name", "wallet")
        .agg(*sums)
        .select("user_id", "day", "amount", "n", F.explode(fixed).alias("subject"))
        .join(asked, ["user_id", "subject"], "left_semi")
    )
    spoken = F.transform(F.array_distinct(phrases(F.col("text"))), merchant_subject)
    named = (
        spent.select("user_id", "text")
        .distinct()
        .select("user_id", "text", F.explode(spoken).alias("subject"))
        .join(asked.filter(F.col("subject").startswith("m=")), ["user_id", "subject"], "left_semi")
    )
    by_phrase = spent.join(named, ["user_id", "text"]).select("user_id", "day", "amount", "n", "subject")
    return by_kind.unionByName(by_phrase).groupBy("user_id", "subject", "day").agg(*sums)


def daily_income(ledger: DataFrame) -> DataFrame:
    """user, subject ('income' or 'salary'), day, amount, n of the credits."""
    kinds = F.when(F.col("is_salary"), F.array(F.lit("income"), F.lit("salary"))).otherwise(F.array(F.lit("income")))
    return (
        ledger.filter(is_credit())
        .select("user_id", F.col("txn_date").alias("day"), "amount", F.explode(kinds).alias("subject"))
        .groupBy("user_id", "subject", "day")
        .agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    )


def range_totals(daily: DataFrame, asks: DataFrame) -> DataFrame:
    """ask_id, total, n, first_on of asks (ask_id, user_id, subject, start, end).

    The running sum of a subject is read at the last day of a range and at the
    day before its first. Days and asked boundaries are distinct per subject, so
    the ordering never grows with the number of asks or of ledger rows.
    """
    key = ["user_id", "subject"]
    edges = asks.select(*key, F.explode(F.array("end", F.date_sub("start", 1))).alias("day")).distinct()
    marks = daily.select(*key, "day", "amount", "n", F.col("day").alias("seen")).unionByName(
        edges.withColumns({"amount": F.lit(0).cast(MONEY), "n": F.lit(0).cast("bigint")}), allowMissingColumns=True
    )
    running = W.partitionBy(*key).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    sums = (
        marks.groupBy(*key, "day")
        .agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"), F.min("seen").alias("seen"))
        .select(
            *key,
            "day",
            F.sum("amount").over(running).alias("amount"),
            F.sum("n").over(running).alias("n"),
            F.min("seen").over(running).alias("first_day"),
        )
        .join(edges, [*key, "day"], "left_semi")
    )
    upto = sums.select(*key, F.col("day").alias("end"), F.struct("amount", "n", "first_day").alias("hi"))
    before = sums.select(*key, F.date_add("day", 1).alias("start"), F.struct("amount", "n").alias("lo"))
    return (
        asks.join(upto, [*key, "end"])
        .join(before, [*key, "start"])
        .groupBy("ask_id")
        .agg(
            rnd(F.sum(F.col("hi.amount") - F.col("lo.amount"))).alias("total"),
            F.sum(F.col("hi.n") - F.col("lo.n")).alias("n"),
            F.min("hi.first_day").alias("first_on"),
        )
    )


def ask_subjects(asks: DataFrame) -> DataFrame:
    """One row per subject of each ask (categories, channel, merchant; any may be empty)."""
    wallet = F.coalesce("channel", F.lit(ANY))
    subjects = (
        F.when(F.size("categories") > 0, F.transform("categories", lambda c: subject_key(c, wallet)))
        .when(F.col("merchant").isNotNull(), F.array(merchant_subject(F.col("merchant"))))
        .otherwise(F.array(subject_key(F.lit(ANY), wallet)))
    )
    return asks.select("ask_id", "user_id", "start", "end", F.explode(subjects).alias("subject"))


def period_spend(ledger: DataFrame, asks: DataFrame) -> DataFrame:
    """Total and count of the spending each ask names."""
    subjects = ask_subjects(asks)
    return range_totals(daily_spending(ledger, subjects), subjects)


def period_income(ledger: DataFrame, asks: DataFrame) -> DataFrame:
    """ask_id, total, salary, n over each ask's period."""
    kinds = F.explode(F.array(F.lit("income"), F.lit("salary")))
    parts = asks.select("ask_id", "user_id", "start", "end", kinds.alias("subject"))
    keyed = parts.withColumn("ask_id", F.struct("ask_id", "subject"))
    sums = range_totals(daily_income(ledger), keyed)
    salary = F.col("ask_id.subject") == "salary"
    return sums.groupBy(F.col("ask_id.ask_id").alias("ask_id")).agg(
        F.max(F.when(~salary, F.col("total"))).alias("total"),
        F.coalesce(F.max(F.when(salary, F.col("total"))), F.lit(0.0)).alias("salary"),
        F.max(F.when(~salary, F.col("n"))).alias("n"),
    )


def previous_period(start: Column, end: Column, kind: Column) -> tuple[Column, Column]:
    """The equivalent period just before: the month before, or as many days."""
    last = F.date_sub(start, 1)
    month = kind == "month"
    length = F.datediff(end, start)
    return F.when(month, F.trunc(last, "MM")).otherwise(F.date_sub(last, length)), last


def compare_periods(ledger: DataFrame, asks: DataFrame) -> DataFrame:
    """ask_id, now, before, change (percent) and direction; asks carry ``kind``."""
    start, end = previous_period(F.col("start"), F.col("end"), F.col("kind"))
    both = asks.withColumn("ask_id", F.struct("ask_id", F.lit("now").alias("side"))).unionByName(
        asks.withColumns({"start": start, "end": end}).withColumn(
            "ask_id", F.struct("ask_id", F.lit("before").alias("side"))
        )
    )
    sums = period_spend(ledger, both)

    def side(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("ask_id.side") == name, F.col("total"))), F.lit(0.0))

    paired = sums.groupBy(F.col("ask_id.ask_id").alias("ask_id")).agg(side("now").alias("now"), side("before").alias("before"))
    change = F.when(F.col("before") != 0, (F.col("now") - F.col("before")) / F.col("before") * 100)
    return (
        asks.select("ask_id")
        .join(paired, "ask_id", "left")
        .fillna(0.0, ["now", "before"])
        .withColumn("change", change)
        .select(
            "ask_id",
            "now",
            "before",
            rnd("change", 1).alias("change"),
            F.when(F.col("change").isNull(), "none")
            .when(F.round(F.abs("change"), 8) < 1, "same")
            .when(F.col("change") > 0, "more")
            .otherwise("less")
            .alias("direction"),
        )
    )


def averages(ledger: DataFrame, asks: DataFrame, as_of: Column) -> DataFrame:
    """Purchases, mean purchase, days and mean per day of each ask; ``kind`` 'all'
    counts the days from the first matching row."""
    sums = period_spend(ledger, asks)
    today = as_of
    first = F.when(F.col("kind") == "all", F.coalesce("first_on", today)).otherwise(F.col("start"))
    last = F.when(F.col("kind") == "all", today).otherwise(F.least("end", today))
    days = F.greatest(F.lit(1), F.datediff(last, first) + 1)
    return (
        asks.join(sums, "ask_id", "left")
        .withColumn("total", F.coalesce("total", F.lit(0.0)))
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select(
            "ask_id",
            "total",
            "n",
            F.when(F.col("n") > 0, rnd(F.col("total") / F.col("n"))).alias("mean"),
            days.cast("bigint").alias("days"),
            rnd(F.col("total") / days).alias("per_day"),
        )
    )
