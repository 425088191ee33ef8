"""Month-partitioned logs and due-source scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PARTITION = "default"


def month_of(ts: str, first: str, last: str) -> Column:
    """Partition label of a row; rows outside the declared months go to the default partition."""
    month = F.date_format(F.col(ts), "yyyy_MM")
    return F.when(month.between(first, last), month).otherwise(F.lit(DEFAULT_PARTITION))


def write_month_partitioned(df: DataFrame, ts: str, path: str, first: str, last: str) -> None:
    """Write by month; ``rebalance`` lets AQE split a heavy month over several files."""
    (df.withColumn("month", month_of(ts, first, last)).hint("rebalance", "month")
     .write.mode("overwrite").partitionBy("month").parquet(path))


def read_months(spark, path: str, ts: str, first: str, last: str) -> DataFrame:
    """Rows of the asked months; only their folders and the default one are listed."""
    month = F.date_format(F.col(ts), "yyyy_MM")
    return (spark.read.parquet(path)
            .where(F.col("month").between(first, last) | (F.col("month") == DEFAULT_PARTITION))
            .where(month.between(first, last)))


def partition_gaps(df: DataFrame, ts: str, today: str, months_ahead: int = 2) -> DataFrame:
    """Months from this one to ``months_ahead`` later that hold no partition yet, with their bounds."""
    spark = df.sparkSession
    start = F.trunc(F.lit(today).cast("date"), "month")
    wanted = spark.range(1).select(
        F.explode(F.sequence(start, F.add_months(start, months_ahead), F.expr("interval 1 month"))).alias("_m"))
    have = df.select(F.trunc(F.col(ts), "month").alias("_m")).distinct()
    return (wanted.join(have, "_m", "left_anti")
            .select(F.date_format("_m", "yyyy_MM").alias("month"),
                    F.date_format("_m", "yyyy-MM-dd").alias("from_date"),
                    F.date_format(F.add_months("_m", 1), "yyyy-MM-dd").alias("to_date")))


def due_sources(df: DataFrame, now: str, last: str = "last_synced_at", hours: str = "interval_hours") -> DataFrame:
    """Sources never synced, or whose last sync plus interval has passed."""
    due = F.col(last) + F.make_interval(hours=F.col(hours).cast("int")) <= F.lit(now).cast("timestamp")
    return df.where(F.col(last).isNull() | due)
