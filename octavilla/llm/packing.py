"""Best-fit packing of token pieces into sequences of a fixed length, in bulk supersteps."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, texts_of, whole_text
from .tokens import encoder, in_portions

#: Rows of one length that one task ranks.
RANKED_AT_ONCE = 1_000_000


def token_pieces(docs: DataFrame, file: str, end: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents longer than ``capacity`` are cut, no other."""
    def cut(batches):
        own = encoder(file, end)
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in in_portions(texts_of(batch.column("text"))):
                tokens, offsets = own.encode(texts)
                tokens, rows = tokens.astype("<u4"), []
                for doc_id, a, b in zip(ids[at:], offsets.tolist(), offsets[1:].tolist()):
                    for piece, start in enumerate(range(a, b, capacity)):
                        stop = min(start + capacity, b)
                        rows.append((doc_id, piece, start - a, stop - start, zlib.crc32(tokens[start:stop].tobytes())))
                at += len(texts)
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def supersteps(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go: rows (length, rank, rows, sequence, offset).

    Pieces of one length are alike, and so are sequences with one gap; so both enter a
    superstep as (size, count), at most ``capacity`` of each whatever the corpus holds.  A
    superstep takes the longest length left and sweeps the gaps upward from it: the pieces
    of ranks ``rank .. rank + rows`` take the sequences ``sequence ..`` of the smallest gap
    that holds them, one each; the rest go on to the next gap, and what no gap holds opens
    new sequences.  A gap that still holds the length is the smallest one that does, so it is
    filled again before the next.  This is the result of placing the pieces one by one.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
    sizes: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                gap = sizes[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(k)
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            fits = gap // length
            full = min(n, left // fits)
            for turn in range(fits if full else 0):
                slots.append((length, rank, full, first, capacity - gap + turn * length))
                rank += full
            left -= full * fits
            put(gap - fits * length, first, full)
            first, n = first + full, n - full
            if n and left < fits:  # the last sequence takes what is left
                for turn in range(left):
                    slots.append((length, rank + turn, 1, first, capacity - gap + turn * length))
                if left:
                    put(gap - left * length, first, 1)
                    first, n = first + 1, n - 1
                left = 0
                put(gap, first, n)
    return pd.DataFrame(slots, columns=["length", "rank", "rows", "sequence", "offset"])


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each length; a very common length is ranked by many tasks."""
    parts = max(1, -(-pieces.count() // RANKED_AT_ONCE))
    salted = pieces.withColumn("_s", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    here = Window.partitionBy("length", "_s").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "_s").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return (salted.withColumn("_r", F.row_number().over(here) - 1).join(sums, ["length", "_s"])
            .withColumn("rank", F.col("_r") + F.col("_b")).drop("_s", "_r", "_b"))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; sequences are filled from 0 without gaps.

    Only the count of each length, ``capacity`` numbers at most, reaches the driver.  Rows are
    ranked once and find their slot by a search in the list of slots, whose size is bounded by
    the capacity and not by the rows.  No row, no result; rows that repeat are packed each;
    lengths must lie in 1..``capacity``.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = supersteps(counts, capacity).sort_values(["length", "rank"], ignore_index=True)
    key = (plan["length"].to_numpy(np.int64) << 44) + plan["rank"].to_numpy(np.int64)
    sequence, offset, rank = (plan[c].to_numpy(np.int64) for c in ("sequence", "offset", "rank"))
    sent = pieces.sparkSession.sparkContext.broadcast((key, sequence, offset, rank))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, sequence, offset, first = sent.value
        k = np.searchsorted(key, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[k] + rank.to_numpy(np.int64) - first[k], "offset": offset[k]})

    placed = ranked(pieces).withColumn("_p", place("length", "rank"))
    return placed.select(*pieces.columns, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, file: str, end: int, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone.  Null and repeated ids are kept,
    each row a document of its own; other columns are not read; an empty table gives no rows.
    """
    return pack(stored(token_pieces(docs, file, end, capacity), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1, capacity=4096)
