"""Periodic runs of words: a sparse diagonal scan over earlier occurrences.

A run of period q is a diagonal: words q apart are equal over a stretch.  A word's earlier
occurrences are as many as it is frequent, so they are told apart by context: for each power of
two m, a word with the m - 1 words before it looks only to its *nearest* earlier occurrence, and
that lag's match goes on or ends.  Inside a run of smallest period q no two of q successive
contexts of m >= q words are equal, so there the nearest occurrence is exactly q back, and the
diagonal of lags q in (m / 2, m] that ends with enough matches is a run.  A context is looked
up at 2 m only where its halves occur more than once, so most words leave after one or two
looks, and no word has more than log n of them, whatever the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, whole_text
from .words import Words, byte_table, split_words, text_parts

#: A run has LEAST words at least and repeats its period TIMES at least.
LEAST, TIMES = 6, 4
#: Words end at the blank and at the bytes 9 to 13.
_INSIDE = byte_table(bytes(b for b in range(256) if b != 0x20 and not 9 <= b <= 13))

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_NEW = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]


def runs_of(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in that order; ``start`` counts within the text.

    ``ids`` are equal where words are; ``bounds`` holds where texts begin and the end.  A run is
    a stretch with smallest period q and max(least, times * q) words or more that its neighbours
    do not extend.  ``times`` must be 3 or more: then a context of m < 2 q words fits in a run twice.
    """
    if times < 3:
        raise ValueError("a run must repeat its period three times at least")
    n = len(ids)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begin = bounds[:-1][text] if n else np.zeros(0, np.int64)
    longest = int(np.diff(bounds).max(initial=0))
    at, key = np.arange(n), text * (int(ids.max(initial=0)) + 1) + ids.astype(np.int64)
    found, m = [], 1
    number = np.full(n, -1, np.int64)
    while len(at) and m // 2 < longest / times:
        order = np.argsort(key, kind="stable")
        sorted_key, sorted_at = key[order], at[order]
        same = sorted_key[1:] == sorted_key[:-1]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][same]] = (sorted_at[1:] - sorted_at[:-1])[same]
        live = np.flatnonzero((lag > m // 2) & (lag <= m))
        if len(live):
            p, q = at[live], lag[live]
            new = np.ones(len(live), bool)
            new[1:] = (np.diff(p) != 1) | (np.diff(q) != 0) | (np.diff(text[p]) != 0)
            first = np.flatnonzero(new)
            a, b, q = p[first], p[np.append(first[1:], len(p)) - 1], q[first]
            length = b - a + q + m
            ok = length >= np.maximum(least, times * q)
            a, q, length = a[ok], q[ok], length[ok]
            start = a - q - m + 1
            found.append(np.stack([text[a], start - begin[a], length, q], axis=1))
        again = np.append(same, False) | np.append(False, same)
        group = np.cumsum(np.append(True, ~same)) - 1
        number[:] = -1
        number[sorted_at[again]] = group[again]
        at = at[number[at] >= 0]
        at = at[at - m >= begin[at]]
        at = at[number[at - m] >= 0]
        key = number[at - m] * (n + 1) + number[at]
        m *= 2
    if not found:
        return np.zeros((0, 4), np.int64)
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _kept(words: Words, runs: np.ndarray) -> np.ndarray:
    """Words that no run contains after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    begin = words.bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(change, begin + runs[:, 3], 1)
    np.add.at(change, begin + runs[:, 2], -1)
    return np.cumsum(change)[:-1] == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``, the words left when each run keeps one period.

    ``runs`` holds (start, length, period) by start, then period; words are counted from 0.  A
    null text has no words, no runs and an empty ``collapsed``.  Each row is taken by itself,
    repeated ones and those without id too.  Columns of the same names are replaced, all others
    (or those of ``carry``) kept; an empty table gives no rows.  A text is held whole by its task,
    with some hundred bytes for each of its words.
    """
    new = [f.name for f in _NEW]
    others = [c for c in (docs.columns if carry is None else carry) if c not in new]
    rows = docs.select(F.struct(*others).alias("row"), whole_text().alias("_text"))

    def scan(batches):
        for batch in batches:
            row = batch.column("row")
            for lo, hi, data, ends in text_parts(batch.column("_text")):
                words = split_words(data, ends, _INSIDE)
                ids = words.array().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                runs = runs_of(ids, words.bounds, least, times)
                offsets = np.searchsorted(runs[:, 0], np.arange(hi - lo + 1)).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=_RUN.names)
                yield pa.RecordBatch.from_arrays(
                    [row.slice(lo, hi - lo), pa.array(np.diff(words.bounds)), pa.ListArray.from_arrays(pa.array(offsets), each),
                     words.joined(_kept(words, runs)).cast(pa.string())], names=["row", *new])

    schema = T.StructType([rows.schema["row"], *_NEW])
    return rows.mapInArrow(scan, schema).select(*[F.col(f"row.{c}").alias(c) for c in others], *new)


def planted_text(key: Column, text: Column) -> Column:
    """The text with a period planted where the key's crc32 h ends in 0; a null key plants none.

    With n words, g = h / 10, a = g % n and p = 1 + (n - a) / (3 + g % 8), words from a on repeat
    the p words from a on.
    """
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    times = F.ceil((n - a) / p).cast("int")
    a_int, p_int, rest = a.cast("int"), p.cast("int"), (n - a).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a_int + 1, p_int), times)), F.lit(1), rest)
    planted = F.concat_ws(" ", F.concat(F.slice(words, F.lit(1), a_int), tail))
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.exists(words, lambda w: w != ""), planted).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_text(F.col("doc_id"), whole_text()).alias("text"))
    done = periodic_runs(docs, carry=["doc_id"])
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
