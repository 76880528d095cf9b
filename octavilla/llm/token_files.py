"""Token ids in Parquet: one list per document, dictionary and delta encoded, with page indexes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, table, whole_text
from .tokens import encoder
from .words import text_parts

#: Bytes of text encoded at once.
BYTES_AT_ONCE = 4 << 20
_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, tokens array<int>"


def write_token_files(docs: DataFrame, path: str, file: str, end: int, row_group: int = 16 << 20, page: int = 64 << 10) -> None:
    """Encodes every text and writes files in ascending ``doc_id`` order.

    A range partition gives each file a span of ids of its own; inside it rows are sorted, and
    ``start_in_part`` counts the ids before a document, so a reader needs only one sum per file.
    Ids are dictionary encoded, ``doc_id`` and ``start_in_part`` delta encoded; ``row_group`` and
    ``page`` give the bytes of row groups and pages, and the page index lets a filter on
    ``doc_id`` skip pages of ids.

    A null text is the empty text and gives the end id alone; a null ``doc_id`` sorts first;
    repeated ids are ordered by text; other columns are not read.  An empty table writes no rows.
    """
    def encode(batches):
        own, part, before = encoder(file, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("doc_id")
            for at, after, data, ends in text_parts(batch.column("text"), BYTES_AT_ONCE):
                tokens, offsets = own.encode_texts(data, ends)
                n = after - at
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), pa.array(np.full(n, part, np.int32)), pa.array(before + offsets[:-1]),
                     pa.array(np.diff(offsets).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens))],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "tokens"])
                before += int(offsets[-1])

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    (ordered.mapInArrow(encode, _SCHEMA).write
     .option("compression", "zstd").option("parquet.writer.version", "v2")
     .option("parquet.block.size", row_group).option("parquet.page.size", page)
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#start_in_part", "false")
     .parquet(path))


def token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, start_in_part, start, n_tokens): no id is read.  ``start`` counts over all files."""
    rows = spark.read.schema(_SCHEMA).parquet(path).drop("tokens")
    return _with_start(rows, _before(spark, path))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents with their ids; a span of ``doc_id`` reaches the scan and skips row groups and pages."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    return rows if last is None else rows.filter(F.col("doc_id") <= last)


def _before(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids in all earlier files; one row per file."""
    sums = spark.read.schema(_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def _with_start(rows: DataFrame, before: DataFrame) -> DataFrame:
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what the files hold."""
    def digest(batches):
        for batch in batches:
            lists = batch.column("tokens")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_pylist()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"),
                 pa.array([b - a for a, b in zip(offsets, offsets[1:])], pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    read = read_tokens(spark, path).select("doc_id", "part", "start_in_part", "tokens")
    digests = read.mapInArrow(digest, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return _with_start(digests, _before(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = shared_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return token_digests(spark, path)
