"""Stored forecasts: only the accounts whose ledger has changed are forecast again.

The store has a folder for each bucket of accounts and a version for each refresh that touched it.
Next to an account's forecasts stands the signature of the rows they came from. A refresh compares
signatures, which are sums over the ledger, forecasts the accounts that differ, and writes new
versions of their buckets; the others keep theirs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forecast, spend
from ..params import DEFAULTS, Params
from ..session import stored
from ..sources import sinks

BUCKETS = 64
SIGNATURES = "user_id BIGINT, signature STRING"
FORECASTS = (
    "user_id BIGINT, category_name STRING, amount DOUBLE, method STRING, cv_error DOUBLE, basis STRING, "
    "history ARRAY<DOUBLE>, months ARRAY<STRING>"
)


def _bucket():
    return F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _read(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The newest version of each bucket (of ``buckets`` only, if given)."""
    known = [int(b) for b in sinks.names(spark, path, "bucket=")]
    folders = [f"{path}/bucket={b}" for b in known if buckets is None or b in buckets]
    found = [f"{f}/version={sinks.versions(spark, f)[-1]}" for f in folders]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str, buckets: list[int], version: int) -> None:
    """New versions of ``buckets``, one file each at least, so that an emptied one is empty; older ones than the last two go."""
    spark = rows.sparkSession
    dealt = rows.withColumn("version", F.lit(version)).repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
    for b in buckets:
        folder = f"{path}/bucket={b}"
        if version not in sinks.versions(spark, folder):
            rows.drop("bucket").filter("false").write.parquet(f"{folder}/version={version}")
        for old in sinks.versions(spark, folder)[:-2]:
            sinks.remove(spark, f"{folder}/version={old}")


def stored_forecasts(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/forecasts", FORECASTS)


def refresh_forecasts(ledger: DataFrame, category: DataFrame, path: str, as_of: dt.date, params: Params = DEFAULTS) -> DataFrame:
    """Bring the store at ``path`` up to the ledger; return the accounts that were forecast again or removed.

    Signatures are written last: a refresh that failed in between is done again by the next one.
    """
    spark = ledger.sparkSession
    now = stored(spend.forecast_signature(ledger, as_of), "signatures")
    before = _read(spark, f"{path}/signatures", SIGNATURES)
    touched = stored(spend.changed_accounts(before, now).select("user_id"), "changed")
    buckets = sorted(r["bucket"] for r in touched.select(_bucket()).distinct().collect())  # at most BUCKETS
    if not buckets:
        return touched
    numbers = [v for b in buckets for v in sinks.versions(spark, f"{path}/signatures/bucket={b}")]
    version = max(numbers, default=-1) + 1
    series = spend.monthly_spend(ledger.join(touched, "user_id", "left_semi"), category)
    made = forecast.forecast(series, as_of, params)
    kept = _read(spark, f"{path}/forecasts", FORECASTS, buckets).join(touched, "user_id", "left_anti")
    _write(made.select(*kept.columns).unionByName(kept).select("*", _bucket()), f"{path}/forecasts", buckets, version)
    same = _read(spark, f"{path}/signatures", SIGNATURES, buckets).join(touched, "user_id", "left_anti")
    new = now.join(touched, "user_id", "left_semi").select("user_id", "signature")
    _write(new.unionByName(same).select("*", _bucket()), f"{path}/signatures", buckets, version)
    return touched
