"""What the operators share: tables, written intermediate results, labelled samples, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that go to Python at once: they hold whole texts, so fewer than Spark's usual 10,000.
ROWS_AT_ONCE = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; a session that has not chosen the size of Arrow batches gets smaller ones."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, ROWS_AT_ONCE)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the store that ``spark.checkpoint.dir`` names.

    Only a local master, where driver and tasks share one machine, may go without the setting.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="octavilla-")
    return f"{named.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes the rows as Parquet to the shared store and reads them back: no lineage, no lost part."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def held_by_worker(key, make: Callable, of: str | None = None):
    """What ``make`` gives, kept by a Python worker for its later tasks of the same operator.

    ``of`` names the operator (by default the key does).  What another operator held is let go
    first: a worker that serves several operators in turn keeps the memory of one.
    """
    claim_worker(of or str(key))
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def claim_worker(of: str) -> None:
    """Lets go of what another operator than ``of`` has left in this worker."""
    if _HELD.get("of") != of:
        _HELD.clear()
        _HELD["of"] = of
        release_memory()


def release_memory() -> None:
    """Gives freed memory back to the system; the allocators would keep it for this worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column) -> Iterator[str]:
    """The texts of an Arrow column, a few at a time, so that a batch is not held twice."""
    for k in range(0, len(column), 64):
        yield from column.slice(k, 64).to_pylist()


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bounded_sample(labelled: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows, chosen by a hash of the key, so any part is as likely as any other.

    The count comes first; the share kept follows from it, and no sort or single task is needed.
    """
    rows = labelled.count()
    if rows <= most:
        return labelled
    limit = int(most / rows * 2**31)
    return labelled.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(2**31)) < limit)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of ``edges``; the component is the smallest node reachable.

    Each round every node takes the smallest label among its own and its neighbours', then the
    label of that label (pointer jumping), so long chains shorten by powers of two.  Minima are
    combined on the map side, so a node with very many edges costs its task one row per map task.
    Each round is written to the shared store; only two numbers reach the driver.
    """
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v"))
                    .select("node", F.least("node", "v").alias("component")), "labels")
    before = None
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(
            F.min("component").alias("near"))
        lowered = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = lowered.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = stored(lowered.join(jump, "component", "left").select(
            "node", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == before:
            return labels
        before = now
