"""Tables kept by a stream: written once per micro-batch id, so a replayed batch changes nothing."""

from __future__ import annotations

from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.writes import keyed_upsert


def _begun(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table under a path, None before its first write; any other trouble with it fails."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as trouble:
        if trouble.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class VersionedTable:
    """Parquet table under ``bucket=…/version=…``; a batch rewrites the buckets it touches only."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path, list(keys), schema, buckets

    def _all(self) -> DataFrame | None:
        return _begun(self.spark, self.path, f"{self.schema}, bucket int, version long")

    def current(self, before: int | None = None) -> DataFrame:
        """Newest version of every bucket (of those below ``before``)."""
        rows = self._all()
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        if before is not None:
            rows = rows.where(F.col("version") < before)
        newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
        return rows.join(newest, ["bucket", "version"], "left_semi").drop("bucket", "version")

    def upsert(self, batch: DataFrame, batch_id: int, order: Sequence[Column]) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        delta = cut_lineage(batch.withColumn("bucket", bucket))  # read several times below
        base = self.current(batch_id).withColumn("bucket", bucket).join(delta.select("bucket").distinct(), "bucket", "left_semi")
        merged = keyed_upsert(base, delta.select(base.columns), self.keys, order)
        (merged.withColumn("version", F.lit(batch_id).cast("long")).hint("rebalance", "bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.path))


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch id; a replay overwrites its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = _begun(spark, path, f"{schema}, batch long")
    return spark.createDataFrame([], f"{schema}, batch long") if rows is None else rows


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read the result back.

    ``append`` goes through the file sink; other modes keep each batch by its id, with column ``batch``.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    out = f"{path}/out"
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    writer.foreachBatch(lambda df, batch_id: write_batch(df, out, batch_id)).start().awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return read_batches(spark, out, schema)


def last_state(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final row per key of an update-mode result."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")
