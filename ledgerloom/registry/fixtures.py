"""The given tables seen as ledgers, statements, messages and questions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import category_dim  # noqa: F401  (re-exported for the query modules)

AS_OF = dt.date(2001, 8, 20)
EVENT_DAY = dt.date(2024, 1, 20)
MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input is one small file; a large input has
    more splits than that and is read as it is, without a shuffle."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def by_number(c: Column, values: dict, default=None) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def ledger(spark: SparkSession, sf: str, flat: bool = False, named: bool = False, both: bool = False) -> DataFrame:
    """Line items as ledger rows; accounts are the customers' nations. ``both``: with flat_amount, the amount of ``flat``."""
    nation = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", F.col("c_nationkey").cast("bigint").alias("user_id"))
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    rows = spread(table(spark, sf, "lineitem")).join(nation, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    number = F.col("l_linenumber")
    types = {
        "ECONOMY": "Groceries", "STANDARD": "Transport", "SMALL": "Housing", "MEDIUM": "Shopping",
        "LARGE": "Dining Out",
    }
    category = F.when(number == 7, F.lit(None).cast("string")).when(number == 6, "Uncategorised")
    for kind, name in types.items():
        category = category.when(F.col("p_type") == kind, name)
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    origin = by_number(
        number,
        {
            1: F.concat(F.lit("manual-"), F.md5(key)),
            2: F.concat(F.lit("sync-momo-mtn-"), F.md5(key)),
            3: F.concat(F.lit("sync-momo-airtel-"), F.md5(key)),
            4: F.concat(F.lit("sync-bank-"), F.md5(key)),
            5: F.concat(F.lit("email-"), F.md5(key)),
            6: F.concat(F.lit("sync-momo-"), F.md5(key)),
        },
    )
    if named:
        merchants = {
            "widget": "Shoprite Manda Hill", "bolt": "ZESCO Prepaid Units", "gear": "Engen Great East Rd",
            "ring": "NETFLIX.COM", "plate": "KFC Cairo Road", "anvil": "ATM WITHDRAWAL CAIRO RD",
            "gizmo": "Airtel Money Transfer",
        }
        noun = F.split_part("p_name", F.lit(" "), F.lit(2))
        named_by = F.create_map(*[F.lit(x) for pair in merchants.items() for x in pair])  # splits a name once
        shown = F.concat(
            F.coalesce(F.try_element_at(named_by, noun), F.lit("Zzz Unknown Merchant")), F.lit(" #"), F.col("l_orderkey").cast("string")
        )
    else:
        shown = F.concat("p_name", F.lit(" "), F.col("l_orderkey").cast("string"))
    return rows.select(
        "user_id",
        key.alias("txn_key"),
        F.to_date("l_shipdate").alias("txn_date"),
        shown.alias("description"),
        F.col("p_retailprice" if flat else "l_extendedprice").cast(MONEY).alias("amount"),
        F.when(F.col("l_returnflag") == "R", "CREDIT").otherwise("DEBIT").alias("txn_type"),
        F.lit(False).alias("is_salary"),
        F.lit(False).alias("is_subscription"),
        category.otherwise("Cash Withdrawal").alias("category_name"),
        by_number(number, {1: "user", 2: "model", 3: "rule"}, "default").alias("category_source"),
        F.lit(None).cast("double").alias("category_confidence"),
        origin.alias("import_hash"),
        *([F.col("p_retailprice").cast(MONEY).alias("flat_amount")] if both else []),
    )


def profile(spark: SparkSession, sf: str, salary: str = "900000") -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        key.cast("bigint").alias("user_id"),
        F.col("n_name").alias("full_name"),
        F.lit(salary).cast(MONEY).alias("salary_amount"),
        (1 + (key * 5) % 31).cast("int").alias("salary_day"),
    )


def goals(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("user_id"),
        key.alias("goal_id"),
        F.concat(F.lit("goal "), key.cast("string")).alias("goal_name"),
        (F.lit(15000) + F.col("c_acctbal")).cast(MONEY).alias("target_amount"),
        F.make_date((2001 + key % 6).cast("int"), (1 + key % 12).cast("int"), F.lit(15)).alias("target_date"),
    )


def rates(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """SELECT * FROM VALUES (DATE '2024-01-01', 'ZMW', 'USD', 0.04D), (DATE '2024-01-08', 'ZMW', 'USD', 0.05D),
        (DATE '2024-01-20', 'ZMW', 'USD', 0.04D), (DATE '2024-01-05', 'ZMW', 'EUR', 0.032D)
        AS t(as_of, base, code, per_local)"""
    )


def events_ledger(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "user_id",
        F.col("event_id").cast("string").alias("txn_key"),
        F.to_date("ts").alias("txn_date"),
        kind.alias("description"),
        F.col("value").cast(MONEY).alias("amount"),
        F.when(kind == "signup", "CREDIT").otherwise("DEBIT").alias("txn_type"),
        F.lit(False).alias("is_salary"),
        F.lit(False).alias("is_subscription"),
        kind.alias("category_name"),
        F.lit("default").alias("category_source"),
        F.lit(None).cast("double").alias("category_confidence"),
        F.concat(F.lit("bank-"), F.col("event_id").cast("string")).alias("import_hash"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as receipt messages."""
    n = F.col("event_id")
    return table(spark, sf, "events").select(
        "user_id",
        F.concat(F.lit("<evt-"), n.cast("string"), F.lit("@example.com>")).alias("message_key"),
        F.to_date("ts").alias("sent_on"),
        by_number(n % 3, {0: "Uber Receipts", 1: "Netflix"}, "Weekly Deals").alias("sender_name"),
        by_number(n % 3, {0: "no-reply@uber.com", 1: "info@netflix.com"}, "news@deals.example").alias("sender_addr"),
        by_number(n % 4, {0: "Your trip receipt", 1: "Invoice", 2: "News"}, "Your free trial").alias("subject"),
        F.when(n % 7 == 0, "USD").when(n % 11 == 0, "GBP").alias("currency"),
        F.when(n % 5 != 0, F.col("value")).cast(MONEY).alias("amount"),
        F.lit("").alias("body_text"),
        n.alias("event_id"),
    )


def bank_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The bank's view of the same purchases, up to four days later."""
    n = F.col("event_id")
    value = F.col("value").cast(MONEY)
    return table(spark, sf, "events").select(
        "user_id",
        F.concat(F.lit("bank-"), n.cast("string")).alias("txn_key"),
        F.date_add(F.to_date("ts"), (n % 5).cast("int")).alias("txn_date"),
        by_number(n % 3, {0: "UBER *TRIP", 1: "NETFLIX.COM"}, "ATM").alias("description"),
        F.when(n % 7 == 0, value * F.lit("25.75").cast("decimal(4,2)")).otherwise(value).cast(MONEY).alias("amount"),
        F.lit("DEBIT").alias("txn_type"),
        n.alias("bank_order"),
        F.sha2(F.concat(F.lit("bank-"), n.cast("string")), 256).alias("import_hash"),
    )


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Raw statement rows in three layouts and many spellings, one file per order."""
    supp, pk = F.col("l_suppkey"), F.col("l_partkey")
    day = F.to_date("l_shipdate")
    money_in = F.col("l_returnflag") == "R"
    value = (F.ceil(F.col("l_quantity") / 10) * 1000 + F.lit(0.5)).cast("double")
    plain = value.cast(MONEY).cast("string")
    iso = F.date_format(day, "yyyy-MM-dd")
    odd = F.when(supp % 10 == 0, "not-a-date").when(supp % 10 == 1, "2062-01-01").when(supp % 10 == 2, "1985-01-05")
    date = by_number(
        pk % 8,
        {
            1: F.date_format(day, "yyyy/MM/dd"),
            2: F.date_format(day, "dd/MM/yyyy"),
            3: F.date_format(day, "dd MMM yyyy"),
            4: F.concat(iso, F.lit(" 10:15:00")),
            5: F.date_format(day, "dd-MM-yyyy"),
            7: F.coalesce(odd, iso),
        },
    )
    amount = by_number(
        supp % 10,
        {
            0: F.lit("-"),
            1: F.concat(F.lit("K"), F.format_number(value, 2)),
            2: F.concat(F.lit("("), plain, F.lit(")")),
            3: F.concat(F.lit(" ZMW "), plain),
            4: F.when(pk % 3 == 0, "abc").otherwise(plain),
            5: F.when(pk % 3 == 0, "0").otherwise(plain),
            6: F.when(F.col("l_linenumber") == 7, "260977123456").otherwise(plain),
        },
    )
    amount = F.coalesce(amount, F.when(F.col("l_returnflag") == "A", F.concat(F.lit("-"), plain)).otherwise(plain))
    words = by_number(
        pk % 5,
        {
            1: F.when(money_in, "Credit").otherwise("Debit"),
            2: F.when(money_in, "CR").otherwise(" dr "),
            3: F.when(supp % 10 == 9, "Transfer?").when(money_in, "in").otherwise("OUT"),
            4: F.when(money_in, "income").otherwise("Payment"),
        },
    )
    layout = F.col("l_orderkey") % 3
    present = (
        F.when(layout == 0, F.array(*map(F.lit, ("date", "description", "amount", "type"))))
        .when(layout == 1, F.array(*map(F.lit, ("date", "description", "debit", "credit"))))
        .otherwise(F.array(*map(F.lit, ("date", "description", "amount"))))
    )
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return spread(table(spark, sf, "lineitem")).join(part, pk == F.col("p_partkey")).select(
        (F.col("l_orderkey") % 25).alias("user_id"),
        F.concat(F.lit("stmt-"), F.col("l_orderkey").cast("string")).alias("file"),
        (F.col("l_linenumber") * F.lit(10_000_000_000) + pk * 1000 + supp % 1000).alias("pos"),
        F.coalesce(date, iso).alias("date"),
        F.when((supp % 10 == 8) & (pk % 8 == 0), "  ").otherwise(F.col("p_name")).alias("description"),
        F.when(layout != 1, amount).alias("amount"),
        F.when(layout == 0, F.coalesce(words, F.lit(""))).alias("type"),
        F.when((layout == 1) & ~money_in, amount).when(layout == 1, "").alias("debit"),
        F.when((layout == 1) & money_in, amount).when(layout == 1, "").alias("credit"),
        present.alias("present"),
    )


def receipts(spark: SparkSession, sf: str, numbered: bool = False) -> DataFrame:
    """One printed receipt per line item; ``numbered``: equal keys are told apart by a number."""
    quantity = F.col("l_quantity").cast("int")
    unit = F.col("p_retailprice").cast(MONEY)
    total = (unit * quantity).cast(MONEY)
    grand = (total + F.lit("1.50").cast(MONEY)).cast(MONEY)
    line = F.when(quantity == 1, F.concat_ws(" ", "p_name", unit.cast("string"))).otherwise(
        F.concat_ws(" ", "p_name", quantity.cast("string"), F.lit("x"), unit.cast("string"), total.cast("string"))
    )
    number = F.col("l_linenumber")
    last = (
        F.when(number == 7, "CASH 100000.00")
        .when(number == 6, F.concat(F.lit("GRAND TOTAL "), F.format_number(grand, 2)))
        .when(number == 5, F.concat(F.lit("Amount Due K"), grand.cast("string")))
        .otherwise(F.concat(F.lit("TOTAL "), grand.cast("string")))
    )
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    keys = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    if numbered:
        place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("l_quantity", "l_extendedprice"))
        keys.append(place.cast("string"))
    return spread(table(spark, sf, "lineitem")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", *keys).alias("txn_key"),
        F.concat_ws(
            "\n",
            F.lit("WELCOME"),
            line,
            F.lit("  Carrier Bag   K 1.50"),
            F.concat(F.lit("SUBTOTAL "), total.cast("string")),
            F.lit("VAT 16.00"),
            last,
        ).alias("text"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
    )


def receipt_items(spark: SparkSession, sf: str) -> DataFrame:
    """Item rows behind the ledger: finished lines are itemised, open ones are not."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    keys = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    itemised = F.col("l_linestatus") == "F"
    return (
        spread(table(spark, sf, "lineitem"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .filter(itemised)
        .select(
            F.concat_ws("-", *keys).alias("txn_key"),
            F.col("p_name").alias("item_name"),
            F.col("p_retailprice").cast(MONEY).alias("amount"),
            F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("int")).alias("quantity"),
        )
    )


# Questions of every kind, one for each turn of the given conversations.
QUESTIONS = (
    "What have I spent on transport?",
    "and for last month?",
    "How much is remaining in my budget?",
    "Could I afford something for K800?",
    "compare my groceries to last month",
    "largest expenses of this cycle",
    "what do you predict for next month",
    "are my goals on track?",
    "list my subscriptions",
    "when do I get paid?",
    "latest transactions please",
    "How often did I go to blue anvil this year?",
    "what is my daily average in this cycle",
    "what income came in last month",
    "help",
    "sing me a song",
    "what if I stop going to red bolt?",
    "if I reduce dining out by K300",
    "am I overspending anywhere?",
    "what can I spend a day until payday?",
    "airtel money and mtn this month",
    "how much cash went out this week?",
    "what did I buy from green gear?",
    "how about groceries?",
    "what if I get a phone for K2500?",
    "spent over the past 3 months",
    "what I paid in october 2000",
    "can I afford rent of 2.5k",
    "is 1,200.50 something I can afford",
    "what did yesterday cost?",
    "dining out versus last cycle",
    "compare against last month",
    "paid in may",
    "may I know how much I spent last week",
    "how much did groceries paid in cash come to",
    "highest shops this year",
    "food so far",
    "what was spent via airtel money",
    "daily average since payday",
    "what if I put aside K500 a month",
)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations' own texts, and next to each conversation one of as many turns with known questions.

    The given conversations have negative numbers here, so that the two don't mix.
    """
    known = F.array(*[F.lit(q) for q in QUESTIONS])
    index = ((F.col("conv_id") * 7 + F.col("turn") * 3) % len(QUESTIONS)).cast("int")
    rows = table(spark, sf, "conversations")
    user = (F.col("conv_id") % 25).alias("user_id")
    asked = rows.select("conv_id", "turn", user, F.get(known, index).alias("text"))
    return asked.unionByName(rows.select((-1 - F.col("conv_id")).alias("conv_id"), "turn", user, "text"))
