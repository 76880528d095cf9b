import os
import re

from pyspark.sql import functions as F

from octavilla.operators.cut import cut_lineage, shared_folder
from octavilla.sources import tpch_blocks

SF = "/root/testdata/sf0.001"


def test_block_methods_are_compiled(spark):
    # the JVM interprets methods of more than 8000 bytes
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = tpch_blocks.blocks(spark, SF)._jdf.queryExecution()
        text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def _bytes(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path.removeprefix("file:")) for f in files)


def test_cut_rows_are_compressed(spark):
    wide = spark.range(20_000).select("id", *[F.lit(f"a text that repeats {i}").alias(f"c{i}") for i in range(20)])
    root = os.path.dirname(shared_folder(spark, "x"))
    before = _bytes(root)
    cut = cut_lineage(wide)
    assert _bytes(root) - before < 1_000_000
    assert cut.count() == 20_000 and cut.schema.names == wide.schema.names


def test_cut_keeps_what_parquet_cannot_hold(spark):
    odd = spark.range(3).select("id", F.lit(None).alias("nothing"), F.col("id").alias("ID"))
    assert sorted(map(tuple, cut_lineage(odd).collect())) == [(k, None, k) for k in range(3)]
