"""Cutting the lineage of a DataFrame that is read many times or grows by rounds."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the checkpoint folder and returns them as a fresh scan.

    They are written as compressed Parquet, of which a reader takes the columns it needs: wide
    rows with many equal values are some hundredths of the plain rows that ``checkpoint`` writes.
    What Parquet cannot hold, untyped nulls and columns of one name, is checkpointed.
    """
    spark, names = df.sparkSession, [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or "void" in df.schema.simpleString():
        _checkpoint_folder(spark)
        return df.checkpoint(eager=True)
    path = shared_folder(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder, for files that are written and read again."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``: shared storage, so what is
    written there survives the loss of executors.

    Where none is named, a local master, whose driver and tasks share one machine, gets a new
    local folder; any other is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.mkdtemp(prefix="octavilla-"), "cp"))
    return context.getCheckpointDir()
