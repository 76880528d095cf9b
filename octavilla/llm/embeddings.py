"""Near copies among embeddings: a pigeonhole join over subspaces of rotated unit vectors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stored, table

THRESHOLD = 0.93
#: Dimensions of a block; coordinates that make its grid; rows of a tile, on average at most.
BLOCK, GRID, TILE = 8, 2, 1024
#: Added to squared distances for the rounding of single precision.
SLACK = 1e-5
#: A cell and the half of its neighbours that come after it, so that no two cells meet twice.
_FORWARD = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


@lru_cache(maxsize=8)
def _rotation(n: int) -> np.ndarray:
    """A fixed random rotation; it spreads what vectors have in common evenly over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def _blocks(n: int) -> list[slice]:
    ends = np.linspace(0, n, max(1, n // BLOCK) + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def usable(vector: str, label: str) -> Column:
    """A vector that can link: a label, at least one component, all finite, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(rep, label, embedding, copies): one row per different vector of a label, named by its smallest id."""
    return vectors.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def _points(vectors: DataFrame, distance: float) -> DataFrame:
    """(label, n, block, c0, c1, rep, v): each block of each rotated unit vector with its grid cell."""
    def cut(frames):
        for frame in frames:
            for n, same in frame.groupby(frame["embedding"].str.len()):
                x = np.stack(same["embedding"].to_numpy()).astype(float)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ _rotation(n)
                for i, at in enumerate(_blocks(n)):
                    part = x[:, at]
                    side = np.sqrt(distance * part.shape[1] / n + SLACK)
                    cell = np.floor(part[:, :GRID] / side).astype(int)
                    cell = np.hstack([cell, np.zeros((len(cell), GRID - cell.shape[1]), int)])
                    yield pd.DataFrame({
                        "label": same["label"], "n": n, "block": i, "c0": cell[:, 0], "c1": cell[:, 1], "rep": same["rep"],
                        "v": [r.tobytes() for r in part.astype(np.float32)]})

    schema = f"label {vectors.schema['label'].dataType.simpleString()}, n int, block int, c0 int, c1 int, rep long, v binary"
    return vectors.select("label", "rep", "embedding").mapInPandas(cut, schema)


def _tiles(points: DataFrame) -> DataFrame:
    """Cells in tiles of a bounded number of points: a crowded cell becomes many tiles."""
    cell = ["label", "n", "block", "c0", "c1"]
    counts = points.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    dealt = points.join(counts, cell).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    return dealt.groupBy(*cell, "tile").agg(F.collect_list("rep").alias("reps"), F.collect_list("v").alias("vs"))


def candidates(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b) pairs of vectors of one label that may reach ``threshold``; none that does is missing.

    Unit vectors of cosine c lie at squared distance 2 (1 - c).  Were every block farther than
    its share of 2 (1 - threshold), in proportion to its dimensions, the sum would be too; so a
    linked pair is within the share in one block at least.  Per block, a grid as wide as the
    share's root on two coordinates brings such pairs into one cell or two that touch.
    """
    distance = 2 * (1 - threshold)
    tiles = stored(_tiles(_points(vectors, distance)), "tiles")
    ahead = F.explode(F.array(*[F.struct(F.lit(a).alias("d0"), F.lit(b).alias("d1")) for a, b in _FORWARD]))
    other = tiles.withColumn("d", ahead).select(
        "label", "n", "block", (F.col("c0") - F.col("d.d0")).alias("c0"), (F.col("c1") - F.col("d.d1")).alias("c1"),
        ((F.col("d.d0") == 0) & (F.col("d.d1") == 0)).alias("same"),
        F.col("tile").alias("tile_b"), F.col("reps").alias("reps_b"), F.col("vs").alias("vs_b"))
    met = tiles.join(other, ["label", "n", "block", "c0", "c1"]).filter(~F.col("same") | (F.col("tile") <= F.col("tile_b")))

    def near(frames):
        for frame in frames:
            for r in frame.itertuples():
                x, y = (np.frombuffer(b"".join(v), np.float32).reshape(len(v), -1).astype(float) for v in (r.vs, r.vs_b))
                most = distance * x.shape[1] / r.n + SLACK
                d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
                i, j = np.nonzero(d <= most)
                a, b = np.asarray(r.reps)[i], np.asarray(r.reps_b)[j]
                keep = a != b
                yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return met.select("n", "reps", "vs", "reps_b", "vs_b").mapInPandas(near, "a long, b long").distinct()


def links(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine) of all pairs of different vectors of one label at or above ``threshold``."""
    named = vectors.select("rep", "label", "embedding")
    pairs = candidates(vectors, threshold)
    left = named.select(F.col("rep").alias("a"), F.col("label").alias("label_a"), F.col("embedding").alias("x"))
    right = named.select(F.col("rep").alias("b"), F.col("label").alias("label_b"), F.col("embedding").alias("y"))
    both = pairs.join(left, "a").join(right, "b").filter("label_a = label_b")

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        size = x.str.len().to_numpy()
        ok = size == y.str.len().to_numpy()
        for n in np.unique(size[ok]) if len(x) else ():
            at = np.flatnonzero(ok & (size == n))
            u, v = (np.stack(s.iloc[at].to_numpy()).astype(float) for s in (x, y))
            out[at] = (u * v).sum(1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
        return pd.Series(out)

    return both.withColumn("cosine", cosine("x", "y")).filter(F.col("cosine") >= threshold).select("a", "b", "cosine")


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only vectors with equal labels are compared, and only usable ones: a null or empty vector,
    one with a null or non-finite component, a zero vector, or one without label or id has no
    link and is its own component.  Vectors of different length never link.  Equal vectors are
    compared once and counted as linked to one another.  A repeated ``vec_id`` names one node.
    Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = rows.filter(usable("embedding", "label") & F.col("vec_id").isNotNull())
    reps = stored(distinct_vectors(good), "vectors")
    found = stored(links(reps, threshold), "links")
    both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = reps.groupBy(F.col("rep").alias("b")).agg(F.sum("copies").alias("w"))
    linked = both.join(weight, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    classes = (reps.join(linked, "rep", "left").join(components(found, "a", "b").withColumnRenamed("node", "rep"), "rep", "left")
               .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("n"),
                       F.coalesce("component", "rep").alias("component")))
    joined = good.select("vec_id", "label", "embedding").join(classes, ["label", "embedding"]).select("vec_id", "n", "component")
    alone = rows.filter(~(usable("embedding", "label") & F.col("vec_id").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    return joined.unionByName(alone).select(
        "vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def op10_embedding_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))
