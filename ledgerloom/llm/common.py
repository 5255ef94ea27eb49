"""Helpers of the operators: tables, the shared folder, running sums in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.session import checkpointed, scratch_path, shared_folder

__all__ = ["bounded_batches", "checkpointed", "fresh", "ordered", "scratch_path", "shared_folder", "stored", "table"]

#: Rows of an Arrow batch. Texts are long; the default of 10,000 rows holds too many of them.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Keep the rows handed to a Python worker at once small (a session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(df: DataFrame, keys: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums in the order of ``keys`` and no task that sees all rows.

    ``sums`` maps a new column to a numeric one; it gets the sum over all earlier rows. Rows are
    dealt into ranges of ``keys``; the sums of the ranges (one row each, as many as shuffle
    partitions) give what precedes a range, and a window within the range does the rest. The
    range of a row is stored, so a task run again sees the same. Null sums count as 0.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "ordered")
    totals = dealt.groupBy("_range").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"_{k}") for k, c in sums.items()])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_range", *[F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(
        "*", *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(inside), F.lit(0)).alias(f"__{k}") for k, c in sums.items()]
    )
    # One row for each range at most: a bounded side.
    joined = local.join(F.broadcast(base), "_range")
    for k in sums:
        joined = joined.withColumn(k, F.col(f"_{k}") + F.col(f"__{k}"))
    return joined.drop("_range", *[p + k for k in sums for p in ("_", "__")])
