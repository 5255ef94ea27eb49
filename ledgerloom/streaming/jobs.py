"""Streaming versions of the import, the monthly totals and the budget alerts.

Each job is exactly repeatable: results are keyed, so a micro-batch replayed
after a failure changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import date_reject
from ..operators.spend import is_spend
from ..params import DEFAULTS, Params
from ..schema import rnd
from ..session import checkpointed
from ..sources import sinks


#: Parts of a month's keys in the index of imported rows.
KEY_PARTS = 8


def ingest(
    rows: DataFrame, ledger_path: str, checkpoint: str, as_of: dt.date, params: Params = DEFAULTS, dated: bool = True
) -> StreamingQuery:
    """Append new ledger rows of a stream (user_id, txn_date, description, amount,
    txn_type, category_name, import_hash, txn_key).

    History is longer than any watermark, so duplicates are looked up in an index of the keys next
    to the ledger, dealt by month and part of the key's hash. A batch reads the months and parts
    that its own rows fall into and nothing else. With ``dated``, equal keys have equal dates, as
    those of statements and messages do; without it the month is left out of the index, and a batch
    reads its parts of the whole history. Each batch replaces its own directories, so a replayed
    batch writes the same files again.
    """
    out_of_range = date_reject("txn_date", as_of, params)
    index = f"{ledger_path}-keys"
    parts = KEY_PARTS if dated else KEY_PARTS * 128
    key_month = F.date_format("txn_date", "yyyy-MM") if dated else F.lit("all")
    key_part = F.pmod(F.xxhash64(*sinks.HASH_KEY), F.lit(parts)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = sinks.first_of_batch(batch.filter(out_of_range.isNull()), "txn_key")
        fresh = fresh.withColumns({"key_month": key_month, "key_part": key_part})
        known = _known_keys(spark, index, fresh, batch_id)
        new = fresh.join(known, sinks.HASH_KEY, "left_anti")
        new.drop("key_month", "key_part").write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}")
        # From the rows just written, so that ledger and index agree; rows without a key have none to look up.
        written = spark.read.schema(batch.schema).parquet(f"{ledger_path}/batch={batch_id}").filter("import_hash IS NOT NULL")
        keys = written.select(*sinks.HASH_KEY, key_month.alias("key_month"), key_part.alias("key_part"), F.lit(batch_id).alias("version"))
        _overwrite(keys.repartition("key_month", "key_part"), index, ["key_month", "key_part", "version"])

    _prepare(rows.sparkSession, rows, ledger_path)
    return _start(rows, write, "append", checkpoint)


KEYS = "user_id BIGINT, import_hash STRING"


def _known_keys(spark: SparkSession, index: str, rows: DataFrame, batch_id: int) -> DataFrame:
    """Keys of earlier batches in the index folders that ``rows`` touch."""
    # At most a row for each month of the accepted history and part.
    touched = rows.filter("import_hash IS NOT NULL").select("key_month", "key_part").distinct().collect()
    folders = [f"{index}/key_month={t['key_month']}/key_part={t['key_part']}" for t in touched]
    found = [f"{f}/version={v}" for f in folders for v in sinks.versions(spark, f) if v < batch_id]
    return spark.read.schema(KEYS).parquet(*found) if found else spark.createDataFrame([], KEYS)


def ingest_recent(rows: DataFrame, ledger_path: str, checkpoint: str, delay: str = "30 days") -> StreamingQuery:
    """The bounded variant: duplicates are known for ``delay`` of event time, in Spark's own state; no index.

    A row that comes more than ``delay`` behind the newest one is left out, and a duplicate that
    comes later than that is taken for new. Null keys are no duplicates of each other.
    """
    timed = rows.withColumns(
        {"event_time": F.col("txn_date").cast("timestamp"), "event_key": F.coalesce("import_hash", F.concat(F.lit("none-"), "txn_key"))}
    )
    once = timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["user_id", "event_key"])
    return _start(once.drop("event_time", "event_key"), _append(ledger_path), "append", checkpoint)


def _append(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _overwrite(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write ``rows`` over the folders of ``by`` they fall into; other folders stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _with_batch(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])


def _prepare(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Make the table exist, empty, before the first batch reads it."""
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{path}/batch=-1")


def _start(stream: DataFrame, write, mode: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- Totals and alerts: one keyed state, a folder for each month ----------------------

STATE = "user_id BIGINT, category_name STRING, spent DECIMAL(28,2), warned_at BIGINT, critical_at BIGINT, month STRING, version BIGINT"
KEY = ["user_id", "month", "category_name"]


def batch_totals(rows: DataFrame) -> DataFrame:
    """Spending per (account, month, category) of ledger rows."""
    return (
        rows.filter(is_spend() & F.col("category_name").isNotNull())
        .groupBy("user_id", F.date_format("txn_date", "yyyy-MM").alias("month"), "category_name")
        .agg(F.sum("amount").cast("decimal(28,2)").alias("added"))
    )


def read_state(spark: SparkSession, path: str, months: list[str] | None = None, before: int | None = None) -> DataFrame:
    """The newest version of each month (of ``months`` only, if given), of batches before ``before``."""
    if months is None:
        months = sinks.names(spark, path, "month=")
    found = []
    for m in months:
        held = [v for v in sinks.versions(spark, f"{path}/month={m}") if before is None or v < before]
        found += [f"{path}/month={m}/version={held[-1]}"] if held else []
    if not found:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).option("basePath", path).parquet(*found)


def _advance(batch: DataFrame, batch_id: int, path: str, budget: DataFrame | None, params: Params) -> list[str]:
    """Add a batch to the state of the months it touches; return these.

    A month's state is one row for each (account, category): the running sum, and the batch that
    raised each level. A batch reads the newest earlier version of its months and writes its own, so
    the work follows the months it touches, not the history, however late its rows come. A replay
    starts from the same versions. Versions older than those are deleted.
    """
    spark = batch.sparkSession
    # The batch runs once: what it adds is stored and read back.
    delta = checkpointed(batch_totals(batch))
    months = [r["month"] for r in delta.select("month").distinct().collect()]  # at most the months of the accepted history
    if not months:
        return []
    old = read_state(spark, path, months, batch_id).drop("version")
    both = old.withColumn("added", F.lit(None).cast("decimal(28,2)")).unionByName(
        delta.withColumns({"spent": F.lit(None).cast("decimal(28,2)"), "warned_at": F.lit(None).cast("long"), "critical_at": F.lit(None).cast("long")})
    )
    state = both.groupBy(*KEY).agg(
        (F.coalesce(F.sum("spent"), F.lit(0)) + F.coalesce(F.sum("added"), F.lit(0))).cast("decimal(28,2)").alias("spent"),
        F.max("warned_at").alias("warned_at"), F.max("critical_at").alias("critical_at"), (F.count("added") > 0).alias("touched"),
    )
    if budget is not None:
        lines = budget.filter("recommended > 0").select(*KEY, "recommended")
        state = state.join(lines, KEY, "left")
        spent = rnd("spent")
        used = rnd(spent / F.col("recommended") * 100, 1)
        now = F.lit(batch_id).cast("long")
        state = state.withColumns(
            {
                "warned_at": F.coalesce("warned_at", F.when(F.col("touched") & (used >= params.nudge_pct), now)),
                "critical_at": F.coalesce("critical_at", F.when(F.col("touched") & (spent >= F.col("recommended")), now)),
            }
        ).drop("recommended")
    _overwrite(state.drop("touched").withColumn("version", F.lit(batch_id).cast("long")).hint("rebalance", "month"), path, ["month", "version"])
    for m in months:
        folder = f"{path}/month={m}"
        needed = max([v for v in sinks.versions(spark, folder) if v < batch_id], default=batch_id)
        for v in sinks.versions(spark, folder):
            if v < needed:
                sinks.remove(spark, f"{folder}/version={v}")
    return months


def write_totals(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the running sum of every (account, month, category); at most two versions a month are stored."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _advance(batch, batch_id, path, None, DEFAULTS)

    return _start(rows, write, "append", checkpoint)


def month_totals(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """user, month, category, spent from the state; of ``months`` only, if given."""
    return read_state(spark, path, months).select(*KEY, rnd("spent").alias("spent"))


def write_alerts(
    rows: DataFrame, budget: DataFrame, state_path: str, path: str, checkpoint: str, params: Params = DEFAULTS
) -> StreamingQuery:
    """Raise each budget threshold once per (account, month, category) of the budget lines
    (user_id, month, category_name, recommended).

    The level that a key has reached is part of its state, so what earlier batches raised is never
    read again. The alerts of a batch are the levels that its version of the state says it raised.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        months = _advance(batch, batch_id, state_path, budget, params)
        state = read_state(spark, state_path, months) if months else spark.createDataFrame([], STATE)
        level = F.array(
            F.when(F.col("warned_at") == batch_id, F.lit("warning")), F.when(F.col("critical_at") == batch_id, F.lit("critical"))
        )
        new = state.select(*KEY, F.explode(F.filter(level, lambda x: x.isNotNull())).alias("level"))
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    empty = rows.sparkSession.createDataFrame([], ALERT).drop("batch")
    empty.write.mode("ignore").parquet(f"{path}/batch=-1")
    return _start(rows, write, "append", checkpoint)


ALERT = "user_id BIGINT, month STRING, category_name STRING, level STRING, batch BIGINT"
