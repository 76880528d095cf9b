"""Neighbour joins of boxes on a page.

A page can hold any number of blocks, so blocks are never paired page by page: a grid
cell is part of the join key and only boxes that share a cell meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 256


def _cells(lo: Column, hi: Column, cell: int) -> Column:
    return F.sequence(F.floor(lo / cell).cast("int"), F.floor(F.greatest(lo, hi) / cell).cast("int"))


def boxes_meeting(targets: DataFrame, others: DataFrame, page: list[str], rect: tuple[Column, Column, Column, Column],
                  box: tuple[Column, Column, Column, Column], cell: int = CELL) -> DataFrame:
    """Pairs whose rectangles (x0, y0, x1, y1) intersect, each pair once.

    Column names of the two sides must differ except for the page keys.  A pair that
    shares several cells is kept in the one that holds the corner of the intersection.
    ``cell`` should be near the size of the rectangles: a small one repeats the target in
    many cells, a large one lets distant boxes meet.  Rows are dealt with their own columns only:
    the rectangles are made of them again where a pair meets.
    """
    a = targets.withColumn("_cx", F.explode(_cells(rect[0], rect[2], cell))).withColumn("_cy", F.explode(_cells(rect[1], rect[3], cell)))
    b = others.withColumn("_cx", F.explode(_cells(box[0], box[2], cell))).withColumn("_cy", F.explode(_cells(box[1], box[3], cell)))
    left, top = F.greatest(rect[0], box[0]), F.greatest(rect[1], box[1])
    meets = (left <= F.least(rect[2], box[2])) & (top <= F.least(rect[3], box[3]))
    corner = (F.floor(left / cell) == F.col("_cx")) & (F.floor(top / cell) == F.col("_cy"))
    keys = [*page, "_cx", "_cy"]
    if all(targets.schema[c].dataType == others.schema[c].dataType for c in page):
        # a number before the keys: rows are sorted by it and hardly ever compared by page and cell
        a, b = (side.withColumn("_cell", F.xxhash64(*keys)) for side in (a, b))
        keys = ["_cell", *keys]
    return a.join(b, keys).filter(meets & corner).drop(*keys[:-2 - len(page)], "_cx", "_cy")
