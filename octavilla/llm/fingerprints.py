"""Document fingerprints by Order MinHash, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole_text

#: Words of a k-mer, minimal k-mers of a tuple, and signatures of a fingerprint (a power of 2).
K, TUPLE, BIN_BITS = 5, 2, 6
#: Low bits of a packed number that hold a position; the others hold a hash.
_LOW = 24
_HIGH = -(1 << _LOW)
#: Rows whose ids one task sorts, and quantiles of ids that reach the driver at most.
ROWS_SORTED, QUANTILES = 2000, 1024
#: First rows of buckets (24 bytes each) that are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 100_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _high(v: Column) -> Column:
    return v.bitwiseAND(F.lit(_HIGH).cast("long"))


def _low(v: Column) -> Column:
    return v.bitwiseAND(F.lit((1 << _LOW) - 1).cast("long"))


def _bin(v: Column) -> Column:
    return F.shiftrightunsigned(v, 64 - BIN_BITS)


def _kmers(text: Column) -> Column:
    """Hash and position of each run of K words in one number; fewer words are one run."""
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.when(F.size(h) == 0, 0).otherwise(F.greatest(F.size(h) - (K - 1), F.lit(1)))
        return F.transform(F.slice(h, F.lit(1), n), lambda x, i: _high(
            F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)])).bitwiseOR(i.cast("long")))

    return _let(words, runs)


def _numbered(kmers: Column) -> Column:
    """Equal k-mers told apart by their occurrence number: a hash of both, with the position.

    In ascending order equal k-mers stand together in text order.  The first of them is found
    by going back in powers of two, and only where the k-mer before is equal.
    """
    powers = F.array(*[F.lit(1 << p) for p in range(_LOW - 1, -1, -1)])

    def number(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            def back(at: Column, step: Column) -> Column:
                equal = (at >= step) & (_high(F.get(s, at - step)) == _high(x))
                return F.when(equal, at - step).otherwise(at)
            start = F.when((i > 0) & (_high(F.get(s, i - 1)) == _high(x)), F.aggregate(powers, i, back)).otherwise(i)
            return _high(F.xxhash64(_high(x), i - start)).bitwiseOR(_low(x))
        return F.transform(s, one)

    return _let(F.sort_array(kmers), number)


def order_minhash(text: Column) -> Column:
    """The fingerprint of a text: an array of numbers, one per bin that has a k-mer.

    One permutation deals the occurrence-numbered k-mers into bins by the first bits of their
    hash.  Of each bin the TUPLE smallest are selected and put back in text order, and the
    bin's number is followed by 24 bits of the hash of that tuple.  Moving a passage, unlike
    in plain MinHash, changes tuples.  A text without words has the empty array.
    """
    def select(u: Column) -> Column:
        return F.filter(u, lambda v, i: (i < TUPLE) | (_bin(v) != _bin(F.get(u, i - TUPLE))))

    def sign(p: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            other = F.get(p, i + 1)
            pair = other.isNotNull() & (_bin(other) == _bin(v))
            h = (F.when(~F.coalesce(pair, F.lit(False)), F.xxhash64(_high(v)))
                 .when(_low(v) < _low(other), F.xxhash64(_high(v), _high(other))).otherwise(F.xxhash64(_high(other), _high(v))))
            first = (i == 0) | (_bin(F.get(p, i - 1)) != _bin(v))
            return F.when(first, F.shiftleft(_bin(v), 24).bitwiseOR(F.shiftrightunsigned(h, 40)).cast("int"))
        return F.filter(F.transform(p, one), lambda e: e.isNotNull())

    return _let(_let(F.sort_array(_numbered(_kmers(text))), select), sign)


def fingerprint_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits per number."""
    return F.array_join(F.transform(fingerprint, lambda e: F.lpad(F.lower(F.hex(e)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal signatures over the bins that either text fills; 1 if neither has a word."""
    bins = F.size(F.array_union(*[F.transform(x, lambda e: F.shiftright(e, 24)) for x in (a, b)]))
    return F.when(bins == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / bins)


def with_next(rows: DataFrame, key: str, tie: str, carried: list[str], per_bucket: int = ROWS_SORTED,
              derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Adds ``next_<c>`` of each carried column: of the row next in descending ``key``, the first after the last.

    Ids are dealt into buckets that follow their order: between quantiles, of which the driver
    gets a bounded number, by an even division.  A bucket is sorted by one task, and its last
    row takes the first row of the next bucket that has one; which rows come first is found
    among narrow ones.  Equal ids are ordered by ``tie``, null ids come last.  ``derive`` adds
    columns to be carried.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        key, F.lit([i / QUANTILES for i in range(QUANTILES + 1)]), 10_000).alias("q")).first()
    cuts = sorted(set(size["q"] or []))[: QUANTILES + 1]
    buckets = max(1, size["n"] // per_bucket)
    cuts = cuts[:: max(1, len(cuts) // buckets)] if buckets < len(cuts) else cuts
    parts = max(1, buckets // max(len(cuts), 1))
    limits = F.array(*[F.lit(c).cast("long") for c in cuts])
    powers = F.array(*[F.lit(1 << p) for p in range(len(cuts).bit_length() - 1, -1, -1)])
    # number of cuts at or below the id
    cell = F.aggregate(powers, F.lit(0), lambda at, step: F.when(
        (at + step <= len(cuts)) & (F.get(limits, at + step - 1) <= F.col(key)), at + step).otherwise(at))
    cell = F.when(F.col(key).isNull(), -1).otherwise(cell) if cuts else F.lit(0)
    lo, hi = F.get(limits, F.col("_cell") - 1), F.get(limits, F.col("_cell"))
    share = (F.col(key) - lo).cast("double") / (hi - lo)
    sub = F.coalesce(F.floor(share * parts), F.lit(0)).cast("int") if cuts else F.lit(0)
    narrow = rows.select(key, tie).withColumn("_cell", cell).withColumn("_sub", sub)
    dealt = derive(rows).withColumn("_cell", cell).withColumn("_sub", sub)

    here = Window.partitionBy("_cell", "_sub").orderBy(F.col(key).desc_nulls_last(), F.col(tie))
    ordered = dealt.withColumn("_next", F.lead(F.struct(*carried)).over(here))
    best = F.min(F.struct(F.col(key).isNull().alias("none"), F.bitwise_not(key).alias("k"), F.col(tie).alias("t")))
    firsts = narrow.groupBy("_cell", "_sub").agg(best.alias("f")).select(
        F.col("_cell").alias("_c"), F.col("_sub").alias("_s"), F.bitwise_not("f.k").alias("_k"), F.col("f.t").alias("_t"))
    if (len(cuts) + 2) * (parts + 1) <= MOST_SENT:  # one row per bucket
        firsts = F.broadcast(firsts)
    heads = rows.join(firsts, F.col(key).eqNullSafe(F.col("_k")) & (F.col(tie) == F.col("_t"))).dropDuplicates(["_c", "_s"])
    heads = derive(heads).select("_c", "_s", F.struct(*carried).alias("_head"))
    used = narrow.select("_cell", "_sub").distinct()
    below = used.withColumn("_s", F.lag("_sub").over(Window.partitionBy("_cell").orderBy("_sub")))
    # one row per cell, QUANTILES + 2 at most
    cells = used.groupBy("_cell").agg(F.max("_sub").alias("_top"))
    order = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(F.struct("_cell", "_top")).over(order)
    cells = cells.select("_cell", F.coalesce(F.lag(F.struct("_cell", "_top")).over(Window.orderBy("_cell")), last).alias("_p"))
    follows = below.join(cells, "_cell").select(
        "_cell", "_sub", F.when(F.col("_s").isNotNull(), F.col("_cell")).otherwise(F.col("_p._cell")).alias("_c"),
        F.coalesce("_s", "_p._top").alias("_s"))
    first = follows.join(heads, ["_c", "_s"]).select(F.col("_cell").alias("_bc"), F.col("_sub").alias("_bs"), "_head")
    whole = ordered.join(first, (F.col("_cell") == F.col("_bc")) & (F.col("_sub") == F.col("_bs")) & F.col("_next").isNull(), "left")
    after = F.coalesce("_next", "_head")
    return whole.select(*[c for c in dealt.columns if c not in ("_cell", "_sub")], *[after[c].alias(f"next_{c}") for c in carried])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last half, rounded down, replaced by as many first characters of
    the next document in descending ``doc_id``.  A null text is the empty text; rows with one
    id follow one another by a hash of their text; a null id comes last; a lone document is
    its own next.  Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    pairs = with_next(rows, "doc_id", "tie", ["text", "marks"],
                      derive=lambda rows: rows.withColumn("marks", order_minhash(F.col("text"))))
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    pairs = pairs.select("doc_id", "n_chars", "marks", "next_marks", edited.alias("edited"))
    pairs = pairs.select("doc_id", "n_chars", "marks", "next_marks", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                         order_minhash(F.col("edited")).alias("edited_marks"))
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("marks")).alias("fingerprint"),
        fingerprint_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
