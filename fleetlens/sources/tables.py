"""Stored telemetry tables: Parquet folders partitioned by day, so a time range reads only its days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.schemas import NATURAL_KEYS
from fleetlens.sources.ingest import insert_if_absent

DAY = "day"


def _time_column(df: DataFrame) -> str | None:
    for c in ("collected_at", "bucket"):
        if c in df.columns:
            return c
    return None


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write a table; time-series rows are laid out by day. Rows are rebalanced by day first: small days share a task,
    a day too large for one is split, so there are neither many small files nor one slow writer."""
    ts = _time_column(df)
    if ts is None or name == "inventory":
        df.write.mode(mode).parquet(f"{root}/{name}")
        return
    df.withColumn(DAY, F.to_date(ts)).hint("rebalance", DAY).write.mode(mode).partitionBy(DAY).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Read a table; a range becomes a filter on the day folders and on the time column."""
    df = spark.read.parquet(f"{root}/{name}")
    ts = _time_column(df)
    if DAY not in df.columns or ts is None:
        return df
    if start is not None:
        df = df.filter((F.col(DAY) >= F.to_date(start)) & (F.col(ts) >= start))
    if end is not None:
        df = df.filter((F.col(DAY) <= F.to_date(end)) & (F.col(ts) <= end))
    return df.drop(DAY)


def append_new(df: DataFrame, root: str, name: str) -> None:
    """Append the samples whose natural key is not stored yet; only the days of the batch are compared."""
    spark = df.sparkSession
    keys = NATURAL_KEYS[name]
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):  # nothing stored yet
        write_table(df.dropDuplicates(keys), root, name)
        return
    stored = spark.read.parquet(f"{root}/{name}")
    days = df.select(F.to_date("collected_at").alias(DAY)).distinct()
    known = stored.join(days, DAY, "left_semi").select(*keys)
    write_table(insert_if_absent(df, known, keys), root, name)


def replace_days(df: DataFrame, root: str, name: str) -> None:
    """Rewrite the day folders that ``df`` covers and leave the others: the repair job for late data in a rollup."""
    ts = _time_column(df)
    df.withColumn(DAY, F.to_date(ts)).hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{root}/{name}")
