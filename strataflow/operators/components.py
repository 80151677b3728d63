"""Connected components of masks, their statistics and selections.

A frame's mask is one bounded unit, so labels are made in a grouped numpy function; all that follows is
grouped by label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def label_mask(mask: np.ndarray) -> np.ndarray:
    """8-connected labels 1 .. n in raster order of each component's first pixel; 0 outside. Runs of each row are
    joined with the runs of the row above that they touch, by hooking to the least label and pointer jumping."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step > 0)
    end = np.nonzero(step < 0)[1]
    n = len(row)
    labels = np.zeros((h, w), np.int32)
    if not n:
        return labels
    # Runs of the row above that reach from start - 1 to end: those that end at or behind start and begin at or before end.
    wide = w + 2
    lo = np.searchsorted(row * wide + end, (row - 1) * wide + start, "left")
    hi = np.searchsorted(row * wide + start, (row - 1) * wide + end, "right")
    count = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(n), count)
    above = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    root = np.arange(n)
    while True:
        least = np.minimum(root[below], root[above])
        after = root.copy()
        np.minimum.at(after, root[below], least)
        np.minimum.at(after, root[above], least)
        while (after[after] != after).any():
            after = after[after]
        if (after == root).all():
            break
        root = after
    _, number = np.unique(root, return_inverse=True)
    width = end - start
    place = np.repeat(row * w + start - (np.cumsum(width) - width), width) + np.arange(width.sum())
    labels.reshape(-1)[place] = np.repeat(number + 1, width)
    return labels


def label_frames(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, label of the pixels with m = 1."""
    kinds = ", ".join(f"{k} {mask.schema[k].dataType.simpleString()}" for k in keys)
    names = list(keys)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        grid = np.zeros((y.max() + 1, x.max() + 1), bool)
        grid[y, x] = True
        found = label_mask(grid)[y, x]
        same = [pa.array([k.as_py()] * len(y), k.type) for k in key]
        return pa.table([*same, pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(found, pa.int32())], names=[*names, "y", "x", "label"])

    rows = mask.where("m = 1").select(*keys, F.col("y").cast("int"), F.col("x").cast("int"))
    return rows.groupBy(*keys).applyInArrow(run, f"{kinds}, y int, x int, label int")


def statistics(labelled: DataFrame, keys: list[str], mass: str | None = None) -> DataFrame:
    weight = F.sum(mass) if mass else F.count(F.lit(1)).cast("double")
    return labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("size"), weight.alias("mass"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def remove_small(labelled: DataFrame, keys: list[str], least: int) -> DataFrame:
    return labelled.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "label"))).where(F.col("_n") >= least).drop("_n")


def top_components(stats: DataFrame, keys: list[str], least: int = 8, most: int = 3, share: float = 0.05) -> DataFrame:
    """The heaviest components of enough size, of those with a share of the heaviest's mass."""
    w = Window.partitionBy(*keys).orderBy(F.desc("mass"), "label")
    ranked = stats.where((F.col("size") >= least) & (F.col("mass") > 0)).withColumns({"rank": F.row_number().over(w), "_top": F.max("mass").over(Window.partitionBy(*keys))})
    return ranked.where((F.col("rank") <= most) & (F.col("mass") >= share * F.col("_top"))).drop("_top")


def recruit(boxes: list[tuple[int, int, int, int, float]], box: tuple[int, int, int, int], total: float, reach: int = 32, share: float = 0.03) -> tuple[int, int, int, int]:
    """Grows a box (x0, y0, x1, y1) by components with a share of the mass within reach of the box grown so
    far, in label order."""
    x0, y0, x1, y1 = box
    for a, b, c, d, mass in boxes:
        if mass >= share * total and max(a - x1, x0 - c, 0) <= reach and max(b - y1, y0 - d, 0) <= reach:
            x0, y0, x1, y1 = min(x0, a), min(y0, b), max(x1, c), max(y1, d)
    return x0, y0, x1, y1
