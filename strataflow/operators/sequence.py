"""Operators along time: chunks, splits, ramps, running sums, debounce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(rows: DataFrame, keys: list[str], order: list[str], size: int = 8, step: int = 3, least: int = 6) -> DataFrame:
    """keys, start, stop of the overlapping runs over each group's rows in order; the last run may be
    shorter but not under ``least``. Only counts are grouped."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= least)
    starts = F.filter(F.sequence(F.lit(0), F.col("n"), F.lit(step)), lambda s: (s + least <= F.col("n")) & ((s == 0) | (s + least - 1 < F.col("n"))))
    return n.select(*keys, "n", F.explode(starts).alias("start")).select(*keys, "start", F.least(F.col("start") + size, F.col("n")).alias("stop"))


def gap_split(scores: DataFrame, keys: list[str], least_above: int = 4) -> DataFrame:
    """keys, cut: where the sorted scores part at their largest gap with ``least_above`` scores above it, if the
    gap has 0.4 of the top score and the cut is at 0.3 of it at most; else null (keep all)."""
    order = Window.partitionBy(*keys).orderBy("score")
    whole = Window.partitionBy(*keys)
    rows = scores.withColumns({"gap": F.lead("score").over(order) - F.col("score"), "above": F.count(F.lit(1)).over(whole) - F.row_number().over(order), "top": F.max("score").over(whole)})
    best = rows.where(F.col("above") >= least_above).groupBy(*keys, "top").agg(F.max(F.struct("gap", (-F.col("score")).alias("s"))).alias("b"))
    cut = -F.col("b.s")
    valid = (F.col("top") > 0) & (F.col("b.gap") > 0) & (F.col("b.gap") >= 0.4 * F.col("top")) & (cut <= 0.3 * F.col("top"))
    return best.select(*keys, F.when(valid, cut).alias("cut"))


def hysteresis(rows: DataFrame, keys: list[str], order: list[str], value: str, seconds: int = 86_400) -> DataFrame:
    """keys, order, strength, present. Going up, strength is (p - 0.10) / 0.20, going down (p - 0.35) / 0.20, within
    [0, 1]; present from 0.5 on. The state can only be set to present by p >= 0.45, to absent by p < 0.20, and
    stays in between, so it is the last such event: a window instead of a fold."""
    p = F.col(value)
    event = F.when(p >= 0.45, True).when(p < 0.20, False)
    before = F.coalesce(F.last(event, True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(before, (p - 0.10) / 0.20).otherwise((p - 0.35) / 0.20)))
    return rows.select(*keys, *order, strength.alias("strength"), (strength >= 0.5).alias("present"))


def running_motion(rows: DataFrame, keys: list[str], order: list[str], delta: str, cut: Column) -> DataFrame:
    """keys, order, total: running sum of delta that starts anew at every cut."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scene = rows.withColumn("_scene", F.sum(F.when(cut, 1).otherwise(0)).over(w))
    within = Window.partitionBy(*keys, "_scene").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return scene.select(*keys, *order, F.sum(delta).over(within).alias("total"))


def change_filter(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the row before; the first row of each key stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_was", F.lag(state).over(w)).withColumn("_first", F.row_number().over(w) == 1).where(F.col("_first") | ~F.col(state).eqNullSafe(F.col("_was"))).drop("_was", "_first")


def debounce(rows: DataFrame, keys: list[str], order: list[str], millis: Column, quiet_ms: int) -> DataFrame:
    """Rows that no other row of their key follows within the quiet time."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_ms", millis)
    return rows.withColumn("_next", F.lead("_ms").over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col("_ms") >= quiet_ms)).drop("_ms", "_next")


def history(rows: DataFrame, keys: list[str], order: list[str], value: str, depth: int = 3) -> DataFrame:
    """The values 1 .. depth rows before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"{value}_{k}": F.lag(value, k).over(w) for k in range(1, depth + 1)})


def sample_times(spans: DataFrame, keys: list[str], start: Column, end: Column, n: Column) -> DataFrame:
    """keys, k, target: n times spread over 5 % to 95 % of a span; one time stands in its middle."""
    lo, hi = start + (end - start) * 0.05, start + (end - start) * 0.95
    rows = spans.select(*keys, lo.alias("_lo"), hi.alias("_hi"), n.alias("_n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = F.when(F.col("_n") == 1, (F.col("_lo") + F.col("_hi")) / 2).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("k") / (F.col("_n") - 1))
    return rows.select(*keys, "k", F.floor(at).cast("long").alias("target"))
