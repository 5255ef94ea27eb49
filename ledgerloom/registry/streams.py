"""Checks of the streaming jobs: the events replayed in slices equal the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import rnd
from ..session import scratch_path
from ..streaming import jobs
from . import fixtures as fx
from . import register
from .sqltext import E, month, r


def _stream(spark, sf):
    """The events as ledger rows, written in slices and read as a stream.

    Each slice holds days of the whole time range, so most rows come later than newer ones.
    """
    path = scratch_path(spark, "slices")
    rows = fx.events_ledger(spark, sf).join(
        fx.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("txn_key"), "ts"), "txn_key"
    )
    rows.repartition(4, F.dayofyear("ts")).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@register(
    "st_ingest",
    f"""WITH {E} SELECT user_id, count(*) AS n, {r('sum(amount)')} AS total FROM E WHERE txn_date <= DATE '2024-01-20' + 3 GROUP BY ALL""",
)
def _(spark, sf):
    """Ingest the slices twice, as two streams into one ledger; the second adds nothing."""
    rows = _stream(spark, sf)
    doubled = rows.drop("ts").unionByName(rows.drop("ts"))
    ledger = scratch_path(spark, "ledger")
    jobs.ingest(doubled, ledger, scratch_path(spark, "state"), fx.EVENT_DAY).awaitTermination()
    stored = spark.read.schema(jobs._with_batch(doubled)).parquet(ledger)
    return stored.groupBy("user_id").agg(F.count("*").alias("n"), rnd(F.sum("amount")).alias("total"))


@register(
    "st_ingest_recent",
    f"""WITH {E} SELECT user_id, count(*) AS n, {r('sum(amount)')} AS total FROM E GROUP BY ALL""",
)
def _(spark, sf):
    """The bounded variant: the slices reach back less than the delay, so nothing is left out."""
    rows = _stream(spark, sf).drop("ts")
    doubled = rows.unionByName(rows)
    ledger = scratch_path(spark, "ledger")
    jobs.ingest_recent(doubled, ledger, scratch_path(spark, "state"), "400 days").awaitTermination()
    stored = spark.read.schema(jobs._with_batch(doubled)).parquet(ledger)
    return stored.groupBy("user_id").agg(F.count("*").alias("n"), rnd(F.sum("amount")).alias("total"))


_TOTALS = f"""MT AS (SELECT user_id, {month('txn_date')} AS month, category_name, sum(amount) AS spent FROM E
  WHERE txn_type = 'DEBIT' GROUP BY ALL)"""


@register("st_month_totals", f"WITH {E}, {_TOTALS} SELECT user_id, month, category_name, {r('spent')} AS spent FROM MT")
def _(spark, sf):
    path = scratch_path(spark, "totals")
    jobs.write_totals(_stream(spark, sf), path, scratch_path(spark, "state")).awaitTermination()
    return jobs.month_totals(spark, path)


@register(
    "st_alerts",
    f"""WITH {E}, {_TOTALS}, BG AS (SELECT user_id, month, category_name, 100.0 + 10 * (user_id % 40) AS rec, spent FROM MT)
    SELECT user_id, month, category_name, 'warning' AS level FROM BG WHERE {r('spent / rec * 100', 1)} >= 80
    UNION ALL SELECT user_id, month, category_name, 'critical' FROM BG WHERE spent >= rec""",
)
def _(spark, sf):
    """Budgets of 100 to 490 per account, by its number."""
    budget = (
        fx.events_ledger(spark, sf)
        .filter("txn_type = 'DEBIT'")
        .select("user_id", F.date_format("txn_date", "yyyy-MM").alias("month"), "category_name")
        .distinct()
        .withColumn("recommended", (100.0 + 10 * (F.col("user_id") % 40)).cast("double"))
    )
    alerts = scratch_path(spark, "alerts")
    jobs.write_alerts(
        _stream(spark, sf), budget, scratch_path(spark, "totals"), alerts, scratch_path(spark, "state")
    ).awaitTermination()
    return spark.read.schema(jobs.ALERT).parquet(alerts).select("user_id", "month", "category_name", "level")
