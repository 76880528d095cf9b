"""Landed flyers as a file stream that keeps the flyer table up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LANDED = ("fuente string, tienda string, folleto_id string, titulo string, fecha_inicio string, fecha_fin string, "
          "total_paginas int, url_folleto string, landed_at timestamp")


def landed_flyers(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of every landed version of every flyer; the upsert chooses the newest."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).json(path)


def newest(rows: DataFrame, keys: list[str], at: str = "landed_at") -> DataFrame:
    """One row per key: the version that landed last, by its other columns on a tie."""
    rest = [c for c in rows.columns if c not in (*keys, at)]
    last = F.max(F.struct(at, *rest))
    return rows.groupBy(*keys).agg(last.alias("_v")).select(*keys, "_v.*").select(*rows.columns)


def load_available(flyers: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs everything that has landed through ``upsert`` in micro-batches, then stops.

    ``upsert`` may see a batch again after a failure and must give the same table.
    """
    return (
        flyers.writeStream.foreachBatch(upsert).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def parquet_upsert(table: str, merge: Callable[[DataFrame, DataFrame], DataFrame], empty: Callable[[SparkSession], DataFrame],
                   keys: tuple[str, ...] = ("fuente", "folleto_id"), buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """Upsert into a Parquet table whose partitions are buckets of the key.

    A batch reads and swaps only the buckets of its keys; the others are not touched.  Of
    several versions the newest is merged, and one older than the table's own is left out where
    the table keeps ``landed_at``; of equal times the other columns that both have decide, as in
    :func:`newest`.  So a batch that comes again, a new stream checkpoint and
    files in any order give the same table.  ``buckets`` is fixed when the table is made; a
    large bucket is written by many tasks.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = newest(batch, list(keys))
        touched = [r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        try:
            old = spark.read.parquet(table).filter(F.col("cubeta").isin(touched)).drop("cubeta")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            old = empty(spark)
        if "landed_at" in old.columns:
            place = ["landed_at", *[c for c in rows.columns if c in old.columns and c not in (*keys, "landed_at")]]
            kept = old.select(*keys, F.struct(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in place]).alias("_at"))
            later = F.col("_at.landed_at").isNull() | (F.struct(*place) >= F.col("_at"))
            rows = rows.join(kept, list(keys), "left").filter(later).drop("_at")
        merged = merge(old, rows).withColumn("cubeta", bucket)
        merged.hint("rebalance", "cubeta").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("cubeta").parquet(table)

    return run


def latest_version(spark: SparkSession, table: str) -> DataFrame:
    """The table written by :func:`parquet_upsert`."""
    return spark.read.parquet(table).drop("cubeta")
