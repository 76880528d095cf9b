"""Benchmark decontamination: every test suffix is searched in suffix arrays of the training texts.

A shard is a few megabytes of training texts in one task.  Their words become numbers of the
tests' vocabulary; stretches without other words, as long as the shortest passage sought, are
all that can match, and their suffixes are sorted.  Each suffix of each test text then narrows
its interval of the array by binary search, word by word, until no training suffix is left: the
depth it reached is its longest verbatim match, the interval says where.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table, whole_text
from .words import Words, byte_table, split_words, text_parts

#: Words of a window: a shorter test text is a window by itself.
WINDOW = 10
#: Words of test texts that are searched in one pass over the documents; the next ones take another.
BLOCK = 1 << 17
#: Words that a test text is cut into pieces of; they overlap by what a window and half a piece need.
PIECE = 4096

_INSIDE = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_UPPER_LETTERS, _LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_LONGEST = T.StructType([T.StructField("length", T.LongType()), T.StructField("start", T.LongType()),
                         T.StructField("item", T.StringType()), T.StructField("item_start", T.LongType())])


def words_of(text: Column) -> Column:
    """Digits, letters and all that is not ASCII, with A to Z made small."""
    return F.regexp_extract_all(F.translate(text, _UPPER_LETTERS, _LOWER_LETTERS), F.lit("([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+)"), F.lit(1))


# --- suffix arrays -----------------------------------------------------------------------------

def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in the order of their first ``depth`` words or more, by doubling."""
    n = len(words)
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    h = 1
    while h < depth:
        key = rank * (n + 2)
        key[:n - h] += rank[h:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        rank[order] = np.cumsum(new)
        if new.all():
            break
        h *= 2
    return order


def _bound(column: np.ndarray, order: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """Per interval the first rank whose word at ``depth`` is not below ``want`` (or above it, with ``after``)."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        middle = (lo[open_] + hi[open_]) // 2
        word = column[order[middle] + depth]
        right = word <= want[open_] if after else word < want[open_]
        lo[open_[right]] = middle[right] + 1
        hi[open_[~right]] = middle[~right]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def _each(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, rank) of every rank of some intervals."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of]


@dataclass
class Block:
    """Some test texts: words as numbers, -1 between pieces, and what each word's place stands for."""

    vocabulary: pa.Array
    words: np.ndarray
    window: np.ndarray  # words of the window that starts here, or 0
    kind: np.ndarray  # its number in ``kinds``
    item: np.ndarray  # its number in ``items``
    place: np.ndarray  # its word number in the item
    kinds: list[str]
    items: list[str]

    @property
    def least(self) -> int:
        return int(self.window[self.window > 0].min(initial=1 << 30))

    @property
    def longest(self) -> int:
        ends = np.flatnonzero(self.words < 0)
        return int(np.diff(np.append(-1, ends)).max(initial=1))


@dataclass
class Found:
    """Occurrences of windows in a shard and, per word, the longest match that starts there."""

    at: np.ndarray  # word numbers where windows occur
    size: np.ndarray
    kind: np.ndarray
    longest: np.ndarray  # per word of the shard: words matched, 0 for none
    source: np.ndarray  # and the place in the block it matches


def search(ids: np.ndarray, bounds: np.ndarray, block: Block) -> Found:
    """All test suffixes in the suffix array of a shard's texts.

    Each window is followed once however many tests share it, and each rank is written once per
    depth, so the work follows the matched words and not the pairs of tests and texts.
    """
    n = len(ids)
    known = ids >= 0
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    first = bounds[:-1][bounds[:-1] < n]
    opens[first] = known[first]
    run = np.cumsum(opens) - 1
    sizes = np.bincount(run[known], minlength=int(opens.sum()))
    use = known.copy()
    use[known] = sizes[run[known]] >= block.least
    origin = np.flatnonzero(use)
    longest, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    none = np.zeros(0, np.int64)
    if not len(origin):
        return Found(none, none, none, longest, source)
    # a separator after each stretch; texts that touch are different stretches
    last = np.append((np.diff(origin) != 1) | opens[origin[1:]], True)
    column = np.full(len(origin) + int(last.sum()), -1, np.int64)
    place = np.arange(len(origin)) + np.cumsum(last) - last
    column[place] = ids[origin]
    back = np.full(len(column), -1, np.int64)
    back[place] = origin
    order = suffix_array(column, block.longest)
    suffix = np.flatnonzero(block.window > 0)  # later ones are shorter than a window, or begin in the next piece
    lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(order), np.int64)
    at, size, kind = [none], [none], [none]
    depth = 0
    while len(suffix):
        want = block.words[suffix + depth]
        on = want >= 0
        suffix, lo, hi, want = suffix[on], lo[on], hi[on], want[on]
        lo, hi = (_bound(column, order, depth, lo, hi, want, after) for after in (False, True))
        on = lo < hi
        suffix, lo, hi = suffix[on], lo[on], hi[on]
        depth += 1
        whole = np.flatnonzero(block.window[suffix] == depth)
        whole = whole[np.unique(lo[whole], return_index=True)[1]]
        of, rank = _each(lo[whole], hi[whole])
        at.append(back[order[rank]])
        size.append(np.full(len(rank), depth))
        kind.append(block.kind[suffix[whole]][of])
        far = np.flatnonzero(block.window[suffix] <= depth)
        far = far[np.unique(lo[far], return_index=True)[1]]
        of, rank = _each(lo[far], hi[far])
        longest[back[order[rank]]], source[back[order[rank]]] = depth, suffix[far][of]
    return Found(np.concatenate(at), np.concatenate(size), np.concatenate(kind), longest, source)


# --- test texts --------------------------------------------------------------------------------

def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(row, item, words, windows): words of each test text and the key of the window at each place."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(whole_text()).alias("words"))
    words = words.filter(F.size("words") > 0).distinct().withColumn("row", F.md5(F.to_json(F.struct("item", "words"))))
    key = F.expr(f"""CASE WHEN size(words) < {window} THEN array(md5(array_join(words, ' ')))
                     ELSE transform(sequence(0, size(words) - {window}), i -> md5(array_join(slice(words, i + 1, {window}), ' '))) END""")
    return words.withColumn("windows", key)


def item_kinds(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(win, kind) of each different window, and (kind, items): windows of the same tests are of one kind."""
    own = windows.select("item", F.explode("windows").alias("win")).groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    own = own.withColumn("kind", F.md5(F.to_json("items")))
    return own.select("win", "kind"), own.select("kind", "items").dropDuplicates(["kind"])


def _pieces(windows: DataFrame, kinds: DataFrame) -> DataFrame:
    """(item, first, words, kinds): pieces of PIECE words, each window and its kind in one piece."""
    placed = windows.select("row", F.posexplode("windows").alias("pos", "win")).join(kinds, "win")
    step = PIECE // 2
    each = placed.withColumn("part", F.floor(F.col("pos") / step)).groupBy("row", "part").agg(
        F.sort_array(F.collect_list(F.struct("pos", "kind"))).alias("at"))
    return windows.join(each, "row").select(
        "item", "part", (F.col("part") * step).alias("first"), F.col("at.kind").alias("kinds"),
        F.expr(f"slice(words, CAST(part * {step} + 1 AS INT), {PIECE})").alias("words"))


def _blocks(pieces: DataFrame, window: int) -> Iterator[tuple[Block, bool]]:
    """The pieces in blocks of about BLOCK words, and whether more come; one at a time is on the driver."""
    sized = stored(pieces.withColumn("size", F.size("words")), "tests")
    total = sized.agg(F.sum("size")).first()[0] or 0
    parts = max(-(-total // BLOCK), 1)
    for k in range(parts):
        rows = sized.filter(F.pmod(F.xxhash64("item", "part"), F.lit(parts)) == k).select("item", "first", "words", "kinds").toArrow()
        yield _block(rows.to_pylist(), window), k + 1 < parts


def _block(rows: list[dict], window: int) -> Block:
    spoken = sorted({w for r in rows for w in r["words"]})
    number = {w: i for i, w in enumerate(spoken)}
    kinds, items = sorted({k for r in rows for k in r["kinds"]}), sorted({r["item"] for r in rows})
    kind_no, item_no = {k: i for i, k in enumerate(kinds)}, {v: i for i, v in enumerate(items)}
    columns: list[list[int]] = [[], [], [], [], []]
    for r in sorted(rows, key=lambda r: (r["item"], r["first"])):
        size = len(r["words"])
        some = len(r["kinds"])
        for column, values in zip(columns, (
                [number[w] for w in r["words"]], [min(window, size)] * some + [0] * (size - some), [kind_no[k] for k in r["kinds"]] + [0] * (size - some),
                [item_no[r["item"]]] * size, range(r["first"], r["first"] + size))):
            column.extend(values)
            column.append(-1 if column is columns[0] else 0)
    vocabulary = pa.array([w.encode("utf-8", "surrogatepass") for w in spoken], pa.binary())
    return Block(vocabulary, *[np.array(c, np.int64) for c in columns], kinds, items)


# --- documents ---------------------------------------------------------------------------------

_STATE = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)),
          T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("longest", _LONGEST)]


def _marked(rows: DataFrame, block: Block, more: bool) -> DataFrame:
    """One pass: adds what the block's tests hit to ``spans``, ``kinds`` and ``longest`` of former passes.

    Texts are handed on only if ``more`` passes come.
    """
    sent = rows.sparkSession.sparkContext.broadcast(block)
    names = [f.name for f in _STATE]
    texts = ["_text"] if more else []

    def scan(batches):
        tests = sent.value
        for batch in batches:
            for lo, hi, data, ends in text_parts(batch.column("_text")):
                words = split_words(data, ends, _INSIDE, _LOWER)
                old = [batch.column(c).slice(lo, hi - lo) for c in names[1:]]
                state = _state(words, old, tests)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("row", *texts)), pa.array(np.diff(words.bounds)), *state],
                    names=["row", *texts, *names])

    schema = T.StructType([*(rows.schema[c] for c in ("row", *texts)), *_STATE])
    return rows.select("row", "_text", *names[1:]).mapInArrow(scan, schema)


def _state(words: Words, old: list[pa.Array], tests: Block) -> list[pa.Array]:
    """``spans``, ``kinds`` and ``longest`` of some texts, the old ones included."""
    ids = pc.fill_null(pc.index_in(words.array(), value_set=tests.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds, n, texts = words.bounds, len(words), len(words.bounds) - 1
    found = search(ids, bounds, tests)
    # words inside any window, of this block or a former one
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found.at, 1)
    np.add.at(change, found.at + found.size, -1)
    of = np.repeat(np.arange(texts), pc.fill_null(pc.list_value_length(old[0]), 0).to_numpy(zero_copy_only=False))
    former = old[0].flatten()
    if len(former):
        a, b = (former.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        np.add.at(change, bounds[of] + a, 1)
        np.add.at(change, bounds[of] + b, -1)
    hit = np.cumsum(change)[:-1] > 0
    text = words.of_text()
    edge = hit.copy()
    edge[1:] &= ~hit[:-1] | (np.diff(text) != 0)
    start = np.flatnonzero(edge)
    close = hit.copy()
    close[:-1] &= ~hit[1:] | (np.diff(text) != 0)
    end = np.flatnonzero(close) + 1
    base = bounds[text[start]]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(text[start], np.arange(texts + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], names=["start", "end"]))
    # kinds of windows per text
    met = {(t, tests.kinds[k]) for t, k in np.unique(np.stack([text[found.at], found.kind], axis=1), axis=0).tolist()}
    kinds: list[list[str]] = [sorted({*(seen or ())}) for seen in old[1].to_pylist()]
    for t, k in sorted(met):
        if k not in kinds[t]:
            kinds[t].append(k)
    # the longest match of each text; of equal ones the first
    best = old[2].to_pylist()
    at = np.flatnonzero(found.longest)
    order = at[np.lexsort((at, -found.longest[at], text[at]))]
    for i in order[np.append(True, np.diff(text[order]) != 0)] if len(order) else ():
        t, s = int(text[i]), int(found.source[i])
        if best[t] is None or best[t]["length"] < found.longest[i]:
            best[t] = {"length": int(found.longest[i]), "start": int(i - bounds[t]), "item": tests.items[tests.item[s]], "item_start": int(tests.place[s])}
    kind = pa.struct([("length", pa.int64()), ("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])
    return [spans, pa.array([sorted(k) for k in kinds], pa.list_(pa.string())), pa.array(best, kind)]


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the test passages that they hold.

    Adds ``n_words``, ``n_hit``, ``spans`` (start, end: words inside any occurrence of a window
    of ``window`` successive words of a test text), ``items`` (ids of the tests with occurring
    windows, as sorted strings), ``n_items``, ``longest`` (the longest verbatim match: words,
    first word, item and its first word; null if none; a match past a piece of PIECE words is
    given as far as its piece goes) and ``contaminated``.

    A test text of fewer words is one window; one without words is none.  Null texts have no
    words.  A null ``item_id`` is the empty string; ids that repeat are one item.  Rows of
    ``docs`` stand by themselves, repeated ones and those without id too.  Columns of the new
    names are replaced, all others (or those of ``carry``) kept; an empty table gives no rows,
    and without tests no document is hit.

    Test texts are broadcast in blocks of BLOCK words.  Documents that hold the same set of
    window kinds share one list of items, which is made once.
    """
    new = ["n_words", "n_hit", "n_items", "items", "spans", "longest", "contaminated"]
    others = [c for c in (docs.columns if carry is None else carry) if c not in new]
    windows = stored(item_windows(items, window), "windows")
    kinds, members = item_kinds(windows)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in _STATE[1:]]
    state = docs.select(F.struct(*others).alias("row"), whole_text().alias("_text"), F.lit(0).cast("long").alias("n_words"), *empty)
    for block, more in _blocks(_pieces(windows, kinds), window):
        state = _marked(state, block, more)
    state = stored(state, "hits")
    some = F.size("kinds") > 0
    hit, clean = state.filter(some), state.filter(~F.coalesce(some, F.lit(False)))
    sets = hit.select("kinds").distinct().withColumn("kind", F.explode("kinds")).join(members.withColumnRenamed("items", "of"), "kind")
    sets = sets.select("kinds", F.explode("of").alias("item")).groupBy("kinds").agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = hit.join(sets, "kinds").select("row", "n_words", "spans", "longest", "items").unionByName(
        clean.select("row", "n_words", F.array().cast(_STATE[1].dataType).alias("spans"), "longest", F.array().cast("array<string>").alias("items")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return both.select(
        *[F.col(f"row.{c}").alias(c) for c in others], "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "items", "spans", "longest", (F.size("spans") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no test passage, with their columns."""
    marked = overlaps(docs.select("text", F.struct(*docs.columns).alias("doc")), items, window, carry=["doc"])
    return marked.filter(~F.col("contaminated")).select("doc.*")


def op11_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest")
