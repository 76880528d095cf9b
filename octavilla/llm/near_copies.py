"""Near copies of texts: consistent weighted samples of TF-IDF shingles, banded, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, held_by_worker, stored, table, texts_of, whole_text
from .tokens import in_portions
from .toxicity import EDGES

WORDS, THRESHOLD = 5, 0.8
#: Samples per band and bands: a pair of similarity 0.8 shares a band with probability 0.9996.
ROWS, BANDS = 5, 20
#: Slots in which document frequencies of words are counted: 4 MB at any size of the corpus.
SLOT_BITS = 20
#: Distinct written words a worker remembers; shingles sampled at once.
MOST_WORDS, AT_ONCE = 250_000, 256
_QUANTILES = 1 << 14


class _Hashes(dict):
    """Hash of each written word without case and punctuation around it, 0 if nothing is left."""

    def __missing__(self, written: str) -> int:
        core = written.strip(EDGES)
        h = self[written] = xxhash.xxh3_64_intdigest(core.encode("utf-8", "surrogatepass")) | 1 if core else 0
        return h


def word_hashes(text: str) -> np.ndarray:
    known = held_by_worker(_Hashes, _Hashes, "near_copies")
    if len(known) > MOST_WORDS:
        known.clear()
    words = text.lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def shingles(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of five words as sorted hashes, and their weights: count times mean idf.

    A text of fewer words is one run.  The idf of a run is that of its words: were it counted
    on whole runs, what many copies share would weigh least and what an edit makes new most,
    and the larger a group of near copies, the less alike they would be.
    """
    w = word_hashes(text)
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    n = min(WORDS, len(w))
    rare = idf[(w >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    m = len(w) - n + 1
    run, weight = np.zeros(m, np.uint64), np.zeros(m, np.float32)
    for i in range(n):
        run = (run ^ w[i:i + m]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(32)
        weight += rare[i:i + m]
    ids, first, counts = np.unique(run, return_index=True, return_counts=True)
    return ids, (weight[first] / n * counts).astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of the smaller weights over sum of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum(dtype=float))
    total = float(a[1].sum(dtype=float) + b[1].sum(dtype=float)) - least
    return least / total if total else 0.0


def _draws():
    return held_by_worker("draws", _make_draws, "near_copies")


def _make_draws():
    """Quantiles of Gamma(2, 1), their logarithms, and a multiplier per sample."""
    x = np.linspace(0, 40, 400_001)
    q = np.interp((np.arange(_QUANTILES) + 0.5) / _QUANTILES, 1 - (1 + x) * np.exp(-x), x)
    odd = np.random.default_rng(11).integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return q.astype(np.float32), np.log(q).astype(np.float32), odd[:, None]


def samples(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Improved consistent weighted sampling: per sample the shingle and level that win.

    Shingle k draws r and c from Gamma(2, 1) and b from [0, 1); with t = floor(ln S / r + b)
    the smallest ln c - r (t - b + 1) wins.  Two weighted sets agree in a sample with a
    probability equal to their weighted Jaccard similarity.
    """
    gamma, log_gamma, odd = _draws()
    size = len(odd)
    best = np.full(size, np.inf, np.float32)
    winner, level = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    mask = np.uint64(_QUANTILES - 1)
    for at in range(0, len(ids), AT_ONCE):
        part, log_s = ids[at:at + AT_ONCE], np.log(weights[at:at + AT_ONCE])
        m = odd * part
        m ^= m >> np.uint64(31)
        m *= np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(30)
        r = gamma[(m & mask).view(np.int64)]
        b = ((m >> np.uint64(28)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
        t = np.floor(log_s / r + b)
        score = log_gamma[((m >> np.uint64(14)) & mask).view(np.int64)] - r * (t - b + 1)
        i = score.argmin(axis=1)
        here = np.take_along_axis(score, i[:, None], 1)[:, 0]
        better = here < best
        best[better] = here[better]
        winner[better] = part[i[better]]
        level[better] = np.take_along_axis(t, i[:, None], 1)[:, 0][better].astype(np.int64)
    return winner ^ (level.astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def band_keys(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    s = samples(ids, weights).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ s[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def word_rarity(docs: DataFrame) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 per slot, df counted over all documents.

    Each task sums its documents in one array, and one row per slot that occurs leaves it; the
    driver gets 2**SLOT_BITS numbers at most.
    """
    def count(batches):
        seen, rows = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            for text in texts_of(batch.column("text")):
                seen[np.unique((word_hashes(text) >> np.uint64(64 - SLOT_BITS)).astype(np.int64))] += 1
                rows += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], names=["slot", "n"])

    found = docs.select(whole_text().alias("text")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(1 << SLOT_BITS)
    slot, n = found["slot"].to_numpy(), found["n"].to_numpy().astype(float)
    df[slot[slot >= 0]] = n[slot >= 0]
    return (np.log((1 + n[slot < 0].sum()) / (1 + df)) + 1).astype(np.float32)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(node, keys, weight) of every document that has a word."""
    def sign(batches):
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in in_portions(texts_of(batch.column("text"))):
                rows = []
                for node, text in zip(ids[at:], texts):
                    s, w = shingles(text, idf.value)
                    if len(s):
                        rows.append((node, band_keys(s, w), float(w.sum(dtype=float))))
                at += len(texts)
                keys = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(keys)),
                     pa.array([r[2] for r in rows], pa.float64())], names=["node", "keys", "weight"])

    return docs.mapInArrow(sign, "node long, keys array<long>, weight double")


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b, similarity) of the pairs; ``a``'s shingles are kept while pairs of one ``a`` follow."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    @F.pandas_udf("double")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, held = None, None
        for xs, ys in batches:
            out = []
            for x, y in zip(xs, ys):
                if x != last:
                    last, held = x, shingles(x, idf.value)
                out.append(similarity(held, shingles(y, idf.value)))
            yield pd.Series(out, dtype="float64")

    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", measure("text_a", "text_b").alias("similarity"))


def _prefixes(texts: DataFrame, parts: DataFrame, idf, threshold: float) -> DataFrame:
    """(node, component, run, rest, total): the rarest runs of each text.

    ``rest`` is the weight of a run and of all commoner ones, ``total`` that of all.  Two texts of
    similarity t share a weight of t times either total at least; so the rarest run they share
    has a ``rest`` of that much in both, and runs with less need not meet.
    """
    def read(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                runs = [shingles(t, idf.value) for t in part.column("text").to_pylist()]
                size = [len(r[0]) for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("node").to_numpy(), size)), pa.array(np.repeat(part.column("tid").to_numpy(), size)),
                     pa.array(np.concatenate([r[0] for r in runs]).view(np.int64)), pa.array(np.concatenate([r[1] for r in runs]))],
                    names=["node", "tid", "run", "w"])

    def cut(batches):
        for batch in batches:
            lists = batch.column("runs")
            runs, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
            weight, ids = runs.field("w").to_numpy().astype(float), runs.field("run").to_numpy()
            kept, rest, total, size = [], [], [], []
            for start, end in zip(np.append(0, ends[:-1]), ends):
                left = weight[start:end][::-1].cumsum()[::-1]
                n = int((left >= threshold * left[0] - 1e-6).sum())
                kept.append(ids[start:start + n])
                rest.append(left[:n])
                size.append(n)
                total.append(left[0])
            if size:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.repeat(batch.column(c).to_numpy(), size)) for c in ("node", "component")],
                     pa.array(np.concatenate(kept)), pa.array(np.concatenate(rest)), pa.array(np.repeat(total, size))],
                    names=["node", "component", "run", "rest", "total"])

    rows = texts.select("text", "node", F.hash("text").alias("tid"))  # one id may have several texts
    rows = stored(rows.mapInArrow(read, "node long, tid int, run long, w float"), "runs")
    often = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    # a text's runs are as many as its words
    listed = rows.join(often, "run").groupBy("node", "tid").agg(F.sort_array(F.collect_list(F.struct("n", "run", "w"))).alias("runs"))
    listed = listed.join(parts, "node").select("node", "component", "runs")
    return listed.mapInArrow(cut, "node long, component long, run long, rest double, total double")


def _close(prefixes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different components that may reach ``threshold``; none that does is missing.

    At the rarest run they share, what is left of either bounds the weight shared.  Only
    texts outside a run's largest component ask, so near copies are not paired with each other.
    """
    counts = prefixes.groupBy("run", "component").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("run").agg(F.max_by("component", F.struct("n", "component")).alias("top"),
                                     F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("run", "top")
    met = prefixes.join(tops, "run")
    columns = ("node", "component", "rest", "total")
    asking = met.filter("component <> top").select("run", "top", *[F.col(c).alias(f"{c}_a") for c in columns])
    asked = met.select("run", *[F.col(c).alias(f"{c}_b") for c in columns])
    enough = F.least("rest_a", "rest_b") >= (F.col("total_a") + F.col("total_b")) * (threshold / (1 + threshold)) - 1e-6
    found = asking.join(asked, (asking["run"] == asked["run"]) & (F.col("component_a") != F.col("component_b"))
                        & ((F.col("component_b") == F.col("top")) | (F.col("node_a") < F.col("node_b"))) & enough)
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_copy_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) per row: the smallest id that links of at least ``threshold`` lead to.

    Equal texts are one node from the start, and only different texts are compared.  In every
    bucket of a band all members are verified against the smallest one.  What these links do
    not join may still be near: members of buckets that hold several components.  Among those
    texts an exact join takes over, band or no band: they meet on their rarest runs, and where
    what is left of either text could still be shared, the pair is verified.  Texts that merely
    hold one common passage, or copies of one text with many changes each, have rare runs of
    their own and do not meet.

    A null or empty text has no shingle and is a copy of other such texts only.  Rows with one
    id are one node.  A null ``doc_id`` joins the class of equal texts, else its class is null.
    Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    idf = spark.sparkContext.broadcast(word_rarity(rows))
    copies = stored(rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5")), "texts")
    reps = copies.groupBy("md5").agg(F.min("doc_id").alias("node"))
    signed = stored(signatures(rows, idf), "signatures").join(reps.select("node").distinct(), "node", "left_semi")
    members = signed.select("node", "weight", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("_last")).filter("pivot < _last").drop("_last")
    members = stored(members.join(buckets, "key"), "members")
    first = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    asked = members.select("node").distinct()
    texts = stored(rows.withColumnRenamed("doc_id", "node").join(asked, "node", "left_semi").dropDuplicates(["node", "text"]), "texts")
    known = stored(_verified(first, texts, idf), "pairs")
    links = known.filter(F.col("similarity") >= threshold).select("a", "b")
    classes = stored(components(links, "a", "b"), "classes")

    others = members.filter("node <> pivot").select("key", "node").join(classes, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    mixed = others.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    unsettled = stored(others.join(mixed, "key", "left_semi").select("node", "component").distinct(), "unsettled")
    rest = _close(stored(_prefixes(texts.join(unsettled, "node", "left_semi"), unsettled, idf, threshold), "prefixes"), threshold)
    rest = rest.join(known.select("a", "b"), ["a", "b"], "left_anti")
    more = stored(_verified(rest, texts, idf).filter(F.col("similarity") >= threshold).select("a", "b"), "links")
    if not more.isEmpty():
        classes = components(links.unionByName(more), "a", "b")
    idf.unpersist()  # all that needs it has been written
    named = reps.join(classes, "node", "left").select("md5", F.coalesce("component", "node").alias("class_id"))
    return copies.join(named, "md5").select("doc_id", "class_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class, and documents without an id.

    Of rows that share an id, one of each different text stays; other columns do not tell rows
    apart.  A null text is a text of its own here.  The columns are those of ``docs``.
    """
    kept = near_copy_classes(docs).filter("doc_id = class_id").select("doc_id").distinct()
    first = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return first.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_copy_classes(table(spark, sf_dir, "documents"))
    return classes.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
