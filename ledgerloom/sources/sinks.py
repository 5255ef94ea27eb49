"""Ledger writes: append-if-new, upserts, deletes by provenance, export."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..functions.text import search
from ..schema import LEDGER, rnd
from ..session import checkpointed

HASH_KEY = ["user_id", "import_hash"]


# --- Insert or ignore ---------------------------------------------------------

def first_of_batch(batch: DataFrame, order: str) -> DataFrame:
    """One row per (user, import_hash): the earliest; rows without a hash all stay.

    Spark cuts each key to its first row before the shuffle as well, so many copies of one row
    don't travel.
    """
    place = F.row_number().over(W.partitionBy(*HASH_KEY).orderBy(order))
    keyed = batch.filter(F.col("import_hash").isNotNull()).withColumn("_place", place).filter("_place = 1").drop("_place")
    return keyed.unionByName(batch.filter(F.col("import_hash").isNull()))


def new_rows(batch: DataFrame, ledger: DataFrame, order: str = "txn_key") -> DataFrame:
    """The batch rows an insert-or-ignore would add."""
    return first_of_batch(batch, order).join(ledger.select(*HASH_KEY), HASH_KEY, "left_anti")


def append_counts(batch: DataFrame, ledger: DataFrame, order: str = "txn_key") -> DataFrame:
    added = new_rows(batch, ledger, order).groupBy("user_id").agg(F.count("*").alias("added"))
    return (
        batch.groupBy("user_id")
        .agg(F.count("*").alias("rows"))
        .join(added, "user_id", "left")
        .select(
            "user_id",
            "rows",
            F.coalesce("added", F.lit(0)).alias("imported"),
            (F.col("rows") - F.coalesce("added", F.lit(0))).alias("duplicates"),
        )
    )


def write_ledger(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write by month. Rebalancing splits a hot month over several tasks.

    Files appear one by one while the job commits; ``publish`` is for readers that must not see a part.
    """
    (
        rows.withColumn("month", month_key("txn_date"))
        .hint("rebalance", "month")
        .write.mode(mode)
        .partitionBy("month")
        .parquet(path)
    )


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers that name the files of a folder, in order; none where it doesn't exist."""
    fs, where = _files(spark, path)
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []


def names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of a folder's folders; none where it doesn't exist."""
    fs, where = _files(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n[len(prefix) :] for n in found if n.startswith(prefix))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a folder's versions, in order."""
    return sorted(int(v) for v in names(spark, path, "version="))


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


class Overtaken(RuntimeError):
    """Another writer published the version that this one was to be."""


def newest(spark: SparkSession, path: str) -> int:
    """The number of the newest commit of a ledger, -1 without one."""
    return max(_numbers(spark, f"{path}/commits"), default=-1)


def _read_parts(spark: SparkSession, parts: dict[str, str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(*sorted(parts.values()))


def _source(spark: SparkSession, path: str, number: int) -> str:
    """The attempt whose list of parts a commit made current."""
    fs, where = _files(spark, f"{path}/commits/{number:08d}")
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_published(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The newest published version of a ledger (or an older one), which may be empty."""
    return _read_parts(spark, parts(spark, path, number))


def parts(spark: SparkSession, path: str, number: int | None = None) -> dict[str, str]:
    """Month and folder of each part of a version, the newest by default."""
    number = newest(spark, path) if number is None else number
    if number < 0:
        return {}
    listed = spark.read.schema("month STRING, folder STRING").json(f"{path}/lists/{_source(spark, path, number)}")
    return {r["month"]: r["folder"] for r in listed.collect()}  # a row for each month of the accepted history


def publish(ledger: DataFrame, path: str, based_on: int | None = None, months: list[str] | None = None) -> DataFrame:
    """Write a new version of a ledger aside, then publish it by one step; return it.

    A version is a list of month folders. With ``months``, ``ledger`` holds the rows of these months
    only, and the new version shares the other folders with version ``based_on`` (the newest by
    default). The step is to create the file ``commits/<based_on + 1>``, which holds the name of the
    list: it exists or it doesn't, so a reader finds a whole version or the one before, and of two
    writers that start from one version the second fails with ``Overtaken`` and has changed nothing.
    The file system must create a file only if there is none in one step, as HDFS, local and most
    cloud stores' connectors with conditional writes do.
    """
    spark = ledger.sparkSession
    based_on = newest(spark, path) if based_on is None else based_on
    attempt = uuid.uuid4().hex
    folder = f"{path}/data/{attempt}"
    write_ledger(ledger, folder, "error")
    written = {m: f"{folder}/month={m}" for m in names(spark, folder, "month=")}
    kept = {} if months is None else {m: f for m, f in parts(spark, path, based_on).items() if m not in months}
    listed = spark.createDataFrame(sorted({**kept, **written}.items()), "month STRING, folder STRING")
    listed.coalesce(1).write.json(f"{path}/lists/{attempt}")
    fs, where = _files(spark, f"{path}/commits/{based_on + 1:08d}")
    try:
        stream = fs.create(where, False)
    except Exception as error:  # the file system's own "already exists", wrapped by the gateway
        if fs.exists(where):
            raise Overtaken(f"version {based_on + 1} of {path} was published meanwhile") from error
        raise
    try:
        stream.write(bytearray(attempt, "ascii"))
    finally:
        stream.close()
    return read_published(spark, path, based_on + 1)


def publish_rows(batch: DataFrame, path: str, order: str = "txn_key", tries: int = 5) -> DataFrame:
    """Insert-or-ignore a batch into the published ledger, all or nothing; return the new version.

    Only the months the new rows fall into are written. A writer that was overtaken works out its
    new rows again from the newer version.
    """
    spark = batch.sparkSession
    for left in reversed(range(tries)):
        base = newest(spark, path)
        held = parts(spark, path, base)
        before = _read_parts(spark, held)
        added = checkpointed(new_rows(batch, before, order).select(*before.columns))
        months = [r[0] for r in added.select(month_key("txn_date")).distinct().collect()]  # a row a month
        touched = _read_parts(spark, {m: f for m, f in held.items() if m in months})
        try:
            return publish(touched.unionByName(added), path, base, months)
        except Overtaken:
            if not left:
                raise


def append_ledger(spark: SparkSession, path: str, batch: DataFrame, order: str = "txn_key") -> None:
    existing = spark.read.parquet(path)
    write_ledger(new_rows(batch, existing.select(*batch.columns), order), path)


# --- Budgets and metrics --------------------------------------------------------

BUDGET_KEY = ["user_id", "month", "category_name"]


def upsert_budget(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.join(new.select(*BUDGET_KEY), BUDGET_KEY, "left_anti").unionByName(new)


def write_budget(spark: SparkSession, path: str, existing: DataFrame, new: DataFrame) -> None:
    """Replace only the months the new lines touch."""
    months = new.select("month").distinct()
    touched = existing.join(months, "month", "left_semi")
    (
        upsert_budget(touched, new)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def latest_metric(metrics: DataFrame) -> DataFrame:
    return (
        metrics.groupBy("model_type")
        .agg(F.max_by(F.struct(*metrics.columns), F.struct("trained_at", "metric_id")).alias("row"))
        .select("row.*")
    )


def metric_ratio(metrics: DataFrame) -> DataFrame:
    """Per-category error ratio, from its column or else from the notes text."""
    noted = F.regexp_extract(F.coalesce("notes", F.lit("")), r"per-category MAE ratio ([0-9.]+)", 1)
    return metrics.withColumn(
        "ratio",
        F.coalesce("per_category_mae_ratio", F.when(noted.rlike(r"^(\d+\.?\d*|\.\d+)$"), noted.try_cast("double"))),
    )


# --- Deletes ---------------------------------------------------------------------

def drop_source(ledger: DataFrame, items: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Remove the rows of one provenance together with their receipt items."""
    gone = F.coalesce(F.col("import_hash").startswith(prefix), F.lit(False))
    removed = ledger.filter(gone).select("txn_key")
    return ledger.filter(~gone), items.join(removed, "txn_key", "left_anti")


def deletable(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("import_hash").startswith("manual-"))


def imported() -> Column:
    """Rows that did not predate the import keys."""
    return ~F.coalesce(F.col("import_hash"), F.lit("")).startswith("legacy-") & F.col("import_hash").isNotNull()


def reset_summary(ledger: DataFrame, predicate: Column) -> DataFrame:
    """Dry run: what a reset would remove and keep."""
    return (
        ledger.groupBy(F.when(predicate, "remove").otherwise("keep").alias("action"))
        .agg(
            F.count("*").alias("n"),
            F.min("txn_date").alias("first"),
            F.max("txn_date").alias("last"),
            rnd(F.sum("amount")).alias("total"),
        )
    )


def reset_imports(ledger: DataFrame, items: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows kept, with subscription flags cleared, and their items without orphans."""
    kept = ledger.filter(~predicate).withColumn("is_subscription", F.lit(False))
    return kept, items.join(kept.select("txn_key"), "txn_key", "left_semi")


def purge_accounts(tables: dict[str, DataFrame], accounts: DataFrame) -> dict[str, DataFrame]:
    """Remove accounts from every table; items follow their transactions."""
    keys = accounts.select("user_id")
    removed = tables["ledger"].join(keys, "user_id", "left_semi").select("txn_key")
    out = {}
    for name, df in tables.items():
        if "user_id" in df.columns:
            out[name] = df.join(keys, "user_id", "left_anti")
        else:
            out[name] = df.join(removed, "txn_key", "left_anti")
    return out


# --- Export and categories ---------------------------------------------------------

def filtered(
    ledger: DataFrame, category: str | None = None, month: str | None = None, q: str | None = None
) -> DataFrame:
    if category:
        ledger = ledger.filter(F.col("category_name") == category)
    if month:
        start = dt.date.fromisoformat(month + "-01")
        end = (start + dt.timedelta(days=32)).replace(day=1)
        ledger = ledger.filter((F.col("txn_date") >= F.lit(start)) & (F.col("txn_date") < F.lit(end)))
    if q and q.strip():
        ledger = ledger.filter(search("description", F.lit(q.strip())))
    return ledger


def export_rows(
    ledger: DataFrame, category: str | None = None, month: str | None = None, q: str | None = None
) -> DataFrame:
    return (
        filtered(ledger, category, month, q)
        .orderBy(F.col("txn_date").desc(), F.col("txn_key").desc())
        .select(
            "user_id",
            F.date_format("txn_date", "yyyy-MM-dd").alias("Date"),
            F.col("description").alias("Description"),
            F.col("amount").cast("decimal(18,2)").cast("string").alias("Amount"),
            F.col("txn_type").alias("Type"),
            F.col("category_name").alias("Category"),
            F.when(F.col("is_subscription"), "Yes").otherwise("No").alias("Is Subscription"),
        )
    )


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def add_categories(category: DataFrame, new: DataFrame, types: Iterable[str] = ("ESSENTIAL", "DISCRETIONARY")) -> DataFrame:
    """Valid new names joined to the dimension; an existing name is left alone."""
    name = F.initcap(F.trim("category_name"))
    valid = (
        new.withColumn("category_name", name)
        .filter((F.length("category_name").between(1, 40)) & F.col("category_type").isin(*types))
        .groupBy("category_name")
        .agg(F.max("category_type").alias("category_type"))
    )
    fresh = valid.join(category.select("category_name"), "category_name", "left_anti")
    return category.unionByName(fresh)


def migrate_labels(ledger: DataFrame, wallet: str = "mtn") -> DataFrame:
    """Bring older rows to the current labels and keys.

    Transfers that read like withdrawals move to the withdrawal category unless
    the user chose the label; rows without a key get one from their own key;
    keys of the single-wallet days get their wallet's name.
    """
    text = F.lower("description")
    withdrawal = (
        F.concat(F.lit(" "), text, F.lit(" ")).contains(" atm ")
        | text.startswith("atm")
        | text.contains("cash withdrawal")
        | text.contains("cash out")
    )
    move = (
        (F.col("txn_type") == "DEBIT")
        & (F.coalesce("category_source", F.lit("")) != "user")
        & (F.col("category_name") == "Transfers")
        & withdrawal
    )
    key = F.col("import_hash")
    old_wallet = (
        key.startswith("sync-momo-") & ~key.startswith("sync-momo-mtn-") & ~key.startswith("sync-momo-airtel-")
    )
    return ledger.withColumn(
        "category_name", F.when(move, "Cash Withdrawal").otherwise(F.col("category_name"))
    ).withColumn(
        "import_hash",
        F.when(key.isNull(), F.concat(F.lit("legacy-"), "txn_key"))
        .when(old_wallet, F.concat(F.lit(f"sync-momo-{wallet}-"), F.substr(key, F.lit(11))))
        .otherwise(key),
    )
