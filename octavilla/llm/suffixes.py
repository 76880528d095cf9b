"""Removal of byte strings that occur more than once: sampled suffixes are sorted, the others induced.

Every string of LENGTH bytes has a sample position: the leftmost smallest hash of its GRAM-byte
strings.  Equal strings have it at the same place, so a string is compared only with those whose
sample position starts the same GRAM bytes.  A sample position and the strings that chose it make
a suffix tuple; tuples of one gram meet in one shard.  There the suffixes at the sample positions
are sorted, and those before them, one byte further left at a time, are induced from that order.

Passages of WORDS words are found in the same way, in strings of words: a word is its 64-bit hash,
so the shards see eight bytes a word.  The last bit of a gram tells words (1) from bytes (0).
"""

from __future__ import annotations

import heapq
import re
import tempfile
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_by_worker, stored, table, texts_of

LENGTH, GRAM = 400, 128
#: Words of a passage, and of the grams that give its sample position.
WORDS, WORD_GRAM = 51, 12
#: Bytes of text scanned at once; a longer document is scanned in overlapping parts.
SCAN = 512 << 10
#: Suffixes sorted at once, tuples processed at once, and tuples a queue holds before it goes to disk.
RUN, CHUNK, HELD = 1 << 15, 1 << 17, 1 << 20
#: Kinds of spans with more copies than this are broadcast: they are few, and their rows stay where they are.
MANY = 10_000

_FACTOR = 0x9E3779B97F4A7C15
_TUPLE = np.dtype([("i", "<i4"), ("lcp", "<i4")])
_WORD = 8  # bytes of a word's hash
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_NAME = re.compile(rb"[^\x20\x09-\x0D]+")
_ANCHORS = "k1 long, k2 long, gram long, text_hash long, lo long, windows int, ahead int"


def _powers():
    return held_by_worker(("powers", SCAN), _make_powers, "suffixes")


def _make_powers():
    n = SCAN + LENGTH
    up = np.multiply.accumulate(np.full(n, _FACTOR, np.uint64))
    down = np.multiply.accumulate(np.full(n, pow(_FACTOR, -1, 2**64), np.uint64))
    return up, down, np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64)


def _smallest_ahead(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` successive keys: of a block's rest and the next block's beginning."""
    blocks = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(key)] = key
    blocks = blocks.reshape(-1, width)
    begun = np.minimum.accumulate(blocks, axis=1).ravel()
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - width + 1
    return np.minimum(rest[:n], begun[width - 1:width - 1 + n])


def _sampled(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = 0, gram_size: int = 0):
    """(part, gram, hash, first window, windows, distance from there to the sample position) per tuple.

    ``data`` has bytes, or hashes of words (64 bits); lengths and places count its entries.
    """
    up, down, letters = _powers()
    words = data.dtype == np.uint64
    length, size = length or LENGTH, gram_size or GRAM
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data if words else letters[data]) * up[:len(data)], out=sums[1:])
    gram = (sums[size:] - sums[:-size]) * down[:len(data) - size + 1]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    at = np.uint64(0xFFFFFF)
    owner = (_smallest_ahead((gram & ~at) | np.arange(len(gram), dtype=np.uint64), length - size + 1) & at).astype(np.int64)
    whole = np.zeros(len(data) - length + 2, np.int64)
    long = sizes >= length
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, starts[long] + sizes[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(whole)[:-1])
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(owner[window]) != 0) | (np.diff(window) != 1)
    part = np.searchsorted(starts, window, side="right") - 1
    new[1:] |= np.diff(part) != 0
    first = np.flatnonzero(new)
    lo, n = window[first], np.diff(np.append(first, len(window)))
    view, width = memoryview(data).cast("B"), data.itemsize
    hashes = [xxhash.xxh3_64_intdigest(view[a * width:(a + k + length - 1) * width]) for a, k in zip(lo.tolist(), n.tolist())]
    gram = gram & ~np.uint64(1) | np.uint64(words)
    return part[first], gram[owner[lo]].view(np.int64), np.array(hashes, np.uint64).view(np.int64), lo, n, owner[lo] - lo


def _word_hashes(data: bytes) -> Iterator[np.ndarray]:
    """Hashes of the words in order, a part of the text at a time."""
    at = 0
    while at < len(data):
        blank = _BLANK.search(data, at + SCAN // 2)
        end = blank.start() if blank else len(data)
        yield np.fromiter(map(xxhash.xxh3_64_intdigest, data[at:end].split()), np.uint64)
        at = end


def _byte_parts(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    for base in range(0, max(len(data) - LENGTH + 1, 0), SCAN // 2):
        yield base, np.frombuffer(data, np.uint8, min(SCAN // 2 + LENGTH - 1, len(data) - base), base)


def _word_parts(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Parts that overlap by a passage less one word, and the words before each."""
    base, tail = 0, np.zeros(0, np.uint64)
    for new in _word_hashes(data):
        part = np.concatenate([tail, new])
        yield base, part
        tail = part[-(WORDS - 1):]
        base += len(part) - len(tail)


def suffix_tuples(rows: DataFrame, passages: bool = False) -> DataFrame:
    """Tuples of all documents: document key, gram, hash of what its windows span, place.

    With ``passages`` there are tuples of words, too; their places and distances count words.
    """
    def scan(batches):
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")]
            kinds = [(_byte_parts, LENGTH, GRAM, SCAN // 2)] + [(_word_parts, WORDS, WORD_GRAM, SCAN // 8)] * passages
            held: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in kinds]
            size = [0] * len(kinds)
            for row, text in enumerate(texts_of(batch.column("text"))):
                data = text.encode("utf-8", "surrogatepass")
                for k, (parts, length, gram, most) in enumerate(kinds):
                    for base, part in parts(data):
                        if len(part) < length:
                            continue
                        if size[k] + len(part) > most and held[k]:
                            yield emit(held[k], keys, length, gram)
                            held[k], size[k] = [], 0
                        held[k].append((row, base, part))
                        size[k] += len(part)
            for some, (_, length, gram, _) in zip(held, kinds):
                if some:
                    yield emit(some, keys, length, gram)

    def emit(held, keys, length, gram):
        sizes = np.array([len(p) for _, _, p in held])
        starts = np.cumsum(sizes) - sizes
        part, grams, hashes, lo, n, ahead = _sampled(np.concatenate([p for _, _, p in held]), starts, sizes, length, gram)
        row, base = np.array([h[0] for h in held])[part], np.array([h[1] for h in held])[part]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[0][row]), pa.array(keys[1][row]), pa.array(grams), pa.array(hashes), pa.array(lo - starts[part] + base),
             pa.array(n.astype(np.int32)), pa.array(ahead.astype(np.int32))], names=[f.split()[0] for f in _ANCHORS.split(", ")])

    return rows.select("k1", "k2", "text").mapInArrow(scan, _ANCHORS)


class _Queue:
    """Tuples ordered by a byte and, of equal bytes, by their entry; past ``HELD`` of them on disk."""

    def __init__(self):
        self.parts: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, object] = {}
        self.held = 0

    def push(self, byte: int, tuples: np.ndarray) -> None:
        self.parts.setdefault(byte, []).append(tuples)
        self.held += len(tuples)
        if self.held > HELD:
            for b, parts in self.parts.items():
                if b not in self.files:
                    self.files[b] = tempfile.TemporaryFile()
                for p in parts:
                    self.files[b].write(p.tobytes())
            self.parts, self.held = {}, 0

    def _in_order(self) -> Iterator[np.ndarray]:
        for byte in sorted({*self.parts, *self.files}):
            if byte in self.files:
                self.files[byte].seek(0)
                while data := self.files[byte].read(CHUNK * _TUPLE.itemsize):
                    yield np.frombuffer(data, _TUPLE)
                self.files[byte].close()
            yield from self.parts.get(byte, ())

    def __iter__(self) -> Iterator[np.ndarray]:
        """Chunks in order."""
        held, n = [], 0
        for part in self._in_order():
            held.append(part)
            n += len(part)
            if n >= CHUNK:
                yield np.concatenate(held)
                held, n = [], 0
        if held:
            yield np.concatenate(held)


def _range_minimum(values: np.ndarray):
    levels = [values]
    while (step := 1 << (len(levels) - 1)) * 2 <= len(values):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    sizes = np.array([len(v) for v in levels])
    flat, base = np.concatenate(levels), np.cumsum(sizes) - sizes

    def smallest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of values[a..b], both included."""
        k = np.frexp((b - a + 1).astype(float))[1] - 1
        return np.minimum(flat[base[k] + a], flat[base[k] + b - (1 << k) + 1])

    return smallest


class Shard:
    """Suffix tuples of a shard; their bytes go to a file of the task, numbers per tuple stay in memory."""

    def __init__(self, length: int = 0):
        self.length = length or LENGTH
        self.file = tempfile.TemporaryFile()
        self.sizes: list[int] = []
        self.ahead: list[int] = []
        self.windows: list[int] = []

    def add(self, data: bytes, ahead: int, windows: int) -> None:
        self.file.write(data)
        self.sizes.append(len(data))
        self.ahead.append(ahead)
        self.windows.append(windows)

    def _right(self, i: int) -> bytes:
        """The bytes from the sample position on."""
        return self.data[self.start[i] + self.far[i]:self.start[i] + self.sizes[i]].tobytes()

    def _sorted(self) -> Iterator[np.ndarray]:
        """Tuples by the suffixes at their sample positions, with common prefixes: runs, then their merge."""
        runs = [sorted(range(a, min(a + RUN, len(self.sizes))), key=self._right) for a in range(0, len(self.sizes), RUN)]
        merged = iter(runs[0]) if len(runs) == 1 else heapq.merge(*runs, key=self._right)
        last = b""
        while part := list(islice(merged, RUN)):
            rights = [last, *map(self._right, part)]
            size = np.array([len(r) for r in rights])
            grid = np.frombuffer(b"".join(r.ljust(self.length, b"\0") for r in rights), np.uint8).reshape(len(rights), -1)
            differ = grid[1:] != grid[:-1]
            common = np.where(differ.any(axis=1), differ.argmax(axis=1), self.length)
            out = np.zeros(len(part), _TUPLE)
            out["i"], out["lcp"] = part, np.minimum(common, np.minimum(size[1:], size[:-1]))
            last = rights[-1]
            yield out

    def repeated(self) -> Iterator[tuple[int, np.ndarray]]:
        """(tuple, its windows whose bytes start anywhere else in the shard)."""
        if not self.sizes:
            return
        self.file.flush()
        self.data = np.memmap(self.file, np.uint8, "r")
        size = np.array(self.sizes, np.int64)
        self.start, self.far = np.cumsum(size) - size, np.array(self.ahead, np.int64)
        windows = np.array(self.windows, np.int64)
        place = np.cumsum(windows) - windows
        self.found = np.memmap(tempfile.TemporaryFile(), bool, "w+", shape=(max(int(windows.sum()), 1),))
        near = self.far - windows + 1  # fewest bytes between a window's start and the sample position
        queue = list(self._sorted()) if len(size) <= RUN else self._first()
        for d in range(int(self.far.max()) + 1):
            if d:
                queue = self._induced(queue, d)
                if not queue.held and not queue.files:
                    break
            queue = self._marked(queue, d, near, place)
        for i in range(len(size)):
            mine = np.flatnonzero(self.found[place[i]:place[i] + windows[i]])
            if len(mine):
                yield i, mine

    def _first(self) -> _Queue:
        queue = _Queue()
        for part in self._sorted():
            queue.push(0, part)
        return queue

    def _marked(self, queue, d: int, near: np.ndarray, place: np.ndarray) -> _Queue:
        """Marks the windows at distance ``d`` that share ``length`` bytes with a neighbour in the order."""
        again, before = _Queue(), None
        for part in queue:
            like = part["lcp"] >= self.length
            mine = like.copy()
            mine[:-1] |= like[1:]
            for tuples, marks in ((part, mine), (before, like[:1] if before is not None else None)):
                if tuples is not None:
                    i = tuples["i"][marks]
                    i = i[near[i] <= d]
                    self.found[place[i] + self.far[i] - d] = True
            before = part[-1:]
            again.push(0, part)
        return again

    def _induced(self, queue, d: int) -> _Queue:
        """The order one byte further left: by that byte, then by the order so far.

        Neighbours with one byte share it and the least common prefix of all that stood from
        the one to the other.  Tuples whose windows do not reach so far leave.
        """
        out = _Queue()
        seen, since = np.zeros(256, bool), np.zeros(256, np.int64)
        for part in queue:
            lcp = part["lcp"].astype(np.int64)
            smallest = _range_minimum(lcp)
            at = np.flatnonzero(self.far[part["i"]] >= d)
            i = part["i"][at]
            byte = self.data[self.start[i] + self.far[i] - d]
            order = np.argsort(byte, kind="stable")
            at, i, byte = at[order], i[order], byte[order]
            new = np.zeros(len(at), _TUPLE)
            new["i"] = i
            ends = np.flatnonzero(np.append(byte[1:] != byte[:-1], True)) if len(byte) else np.zeros(0, int)
            begins = np.append(0, ends[:-1] + 1) if len(ends) else ends
            if len(at):
                inner = np.ones(len(at), bool)
                inner[begins] = False
                j = np.flatnonzero(inner)
                new["lcp"][j] = 1 + smallest(at[j - 1] + 1, at[j])
                b = byte[begins]
                up_to = np.minimum(since[b], smallest(np.zeros(len(b), int), at[begins]))
                new["lcp"][begins] = np.where(seen[b], 1 + up_to, 0)
            since = np.minimum(since, lcp.min())
            if len(at):
                open_end = at[ends] + 1
                far = np.full(len(ends), 1 << 30)
                more = open_end < len(lcp)
                far[more] = smallest(open_end[more], np.full(more.sum(), len(lcp) - 1))
                since[b], seen[b] = far, True
                for x, y, z in zip(b.tolist(), begins, ends):
                    out.push(x, new[y:z + 1])
        return out


_SPAN = "k1 long, k2 long, lo long, hi long, words boolean"


def _sort_shards(strings: DataFrame) -> DataFrame:
    """Spans of windows that another tuple of the same gram has too; a task's grams are one shard of each kind."""
    def sort(batches):
        shards = [(Shard(LENGTH), [], 1, LENGTH), (Shard(WORDS * _WORD), [], _WORD, WORDS)]
        for batch in batches:
            for k1, k2, lo, windows, ahead, n, gram, data in zip(
                    *(batch.column(c).to_pylist() for c in ("k1", "k2", "lo", "windows", "ahead", "n", "gram", "data"))):
                shard, places, step, _ = shards[gram & 1]
                places.append((k1, k2, lo, n == 1))
                shard.add(data, ahead * step, (windows - 1) * step + 1)
        out: list[tuple[int, int, int, int, bool]] = []
        for words, (shard, places, step, length) in enumerate(shards):
            for i, windows in shard.repeated():
                k1, k2, lo, single = places[i]
                windows = windows[windows % step == 0] // step
                if single and len(windows):  # what occurs as a whole more than once is removed as a whole
                    breaks = np.flatnonzero(np.diff(windows) > length)
                    for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(windows) - 1)):
                        out.append((k1, k2, lo + int(windows[a]), lo + int(windows[b]) + length, bool(words)))
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    def batch_of(out):
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.bool_())],
                                          names=[f.split()[0] for f in _SPAN.split(", ")])

    return strings.repartition("gram").mapInArrow(sort, _SPAN)


def repeated_spans(rows: DataFrame, passages: bool = False) -> DataFrame:
    """(k1, k2, lo, hi, words): byte ranges whose every byte lies in a repeated string of LENGTH bytes.

    With ``passages`` also ranges of words, every one of which lies in a repeated run of WORDS words.
    Tuples whose gram occurs once are done.  Equal spans, such as those of whole copies, are
    found by their hash and counted, however many there are, and one of them stands for all
    in its shard; a shard sees only grams with more than one kind of span.
    """
    tuples = stored(suffix_tuples(rows, passages), "tuples")
    grams = tuples.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"), F.min("text_hash").alias("_a"), F.max("text_hash").alias("_b"))
    grams = stored(grams.filter("_n > 1").select("gram", (F.col("_a") < F.col("_b")).alias("several")), "grams")
    shared = stored(tuples.join(grams, "gram"), "shared")
    kinds = stored(shared.filter("several").groupBy("gram", "text_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "lo", "windows", "ahead")).alias("r")), "kinds")
    words = F.col("gram").bitwiseAND(F.lit(1)) == 1
    span = ["k1", "k2", "lo", (F.col("lo") + F.col("windows") - 1 + F.when(words, WORDS).otherwise(LENGTH)).alias("hi"), words.alias("words")]
    alike = shared.filter("not several").select(span)  # a gram's only kind: all its tuples are copies
    several, key = shared.filter("several"), ["gram", "text_hash"]
    many = several.join(F.broadcast(kinds.filter(F.col("n") > MANY).select(key)), key, "left_semi").select(span)
    some = several.join(kinds.filter((F.col("n") > 1) & (F.col("n") <= MANY)).select(key), key, "left_semi").select(span)
    asked = kinds.select("r.k1", "r.k2", F.struct("gram", "n", "r.lo", "r.windows", "r.ahead").alias("ask"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list("ask").alias("asks"))  # at most one per byte of the document

    def cut(batches):
        for batch in batches:
            for k1, k2, text, asks in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "asks"))):
                data = text.encode("utf-8", "surrogatepass")
                named = np.concatenate([*_word_hashes(data)]) if any(a["gram"] & 1 for a in asks) else None
                for k in range(0, len(asks), 2000):
                    some = asks[k:k + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k1] * len(some), pa.int64()), pa.array([k2] * len(some), pa.int64()),
                         *[pa.array([a[c] for a in some], t) for c, t in (
                             ("lo", pa.int64()), ("windows", pa.int32()), ("ahead", pa.int32()), ("n", pa.int64()), ("gram", pa.int64()))],
                         pa.array([named[a["lo"]:a["lo"] + a["windows"] + WORDS - 1].tobytes() if a["gram"] & 1 else
                                   data[a["lo"]:a["lo"] + a["windows"] + LENGTH - 1] for a in some], pa.binary())],
                        names=["k1", "k2", "lo", "windows", "ahead", "n", "gram", "data"])

    once = rows.select("k1", "k2", "text").join(asked, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    strings = once.select("k1", "k2", "text", "asks").mapInArrow(
        cut, "k1 long, k2 long, lo long, windows int, ahead int, n long, gram long, data binary")
    return alike.unionByName(many).unionByName(some).unionByName(_sort_shards(strings))


def _byte_spans(spans, data: bytes) -> Iterator[tuple[int, int]]:
    """The spans as ranges of bytes; of words, from the first one's first byte to the last one's last."""
    runs = merged((s["lo"], s["hi"]) for s in spans if s["words"])
    yield from ((s["lo"], s["hi"]) for s in spans if not s["words"])
    if runs:
        ends = np.array([m.span() for m in _NAME.finditer(data)], np.int64)
        yield from ((int(ends[a][0]), int(ends[b - 1][1])) for a, b in runs)


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of bytes in any of the spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the remaining bytes.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in
    another document or in the same one; with ``passages`` so do runs of WORDS words that also
    occur anywhere else, whatever blanks part the words.  A null text is empty; texts below LENGTH bytes stay
    as they are.  Repeated rows repeat each other; rows are told apart by ``doc_id`` and text,
    null ids included.  All columns are kept, older ones of the new names replaced; an empty
    table gives no rows.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    others = [c for c in docs.columns if c not in (*new, "text")]
    rows = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), "text" if "text" in docs.columns else F.lit("").alias("text"))
    rows = rows.select("row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.col("row.doc_id").cast("long")
    rows = rows.select(F.coalesce(key, F.lit(0)).alias("k1"), F.xxhash64(key.isNull(), "text").alias("k2"), "row", "text")
    spans = repeated_spans(rows, passages).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi", "words")).alias("spans"))

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                gone = merged(_byte_spans(spans or (), data))
                ends = [0, *(x for run in gone for x in run), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                out.append((len(data), len(data) - len(kept), len(gone), kept))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["row", "text"]).columns, *[pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.binary(),))]],
                names=["row", "text", *new])

    whole = rows.join(spans, ["k1", "k2"], "left").select("row", "text", "spans")
    from pyspark.sql import types as T
    schema = T.StructType([whole.schema["row"], whole.schema["text"], *[T.StructField(c, T.LongType()) for c in new[:3]],
                           T.StructField("kept", T.BinaryType())])
    done = whole.mapInArrow(cut, schema)
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns if c not in new], *new)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, passages: bool = False) -> DataFrame:
    """Documents with what is left of their text; a character cut in two goes as well."""
    @F.pandas_udf("string")
    def readable(kept):
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    left = without_repeats(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), passages)
    text = F.when(F.col("n_removed") > 0, readable("kept")).otherwise(F.col("row.text"))
    size = F.char_length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": text, "n_chars": size}
    return left.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
