"""Robust aggregates, regressions and scores over frame tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def median_mad(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, med, mad (scaled). Both come from one sorted array per group, so one exchange is enough."""
    got = rows.groupBy(*keys).agg(F.median(value).alias("med"), F.collect_list(value).alias("_v"))
    ordered = got.select(*keys, "med", F.sort_array(F.transform("_v", lambda x: F.abs(x - F.col("med")))).alias("_d"))
    return ordered.select(*keys, "med", (array_median(F.col("_d")) * MAD_SCALE).alias("mad"))


def with_median(rows: DataFrame, keys: list[str], value: str = "v", name: str = "med") -> DataFrame:
    """rows beside the median of their group: one exchange, where a join with the group's aggregate would read twice."""
    return rows.withColumn(name, F.median(value).over(Window.partitionBy(*keys)))


def array_median(ordered: Column) -> Column:
    """Median of a sorted array; of an empty one 0."""
    n = F.size(ordered)
    return F.when(n == 0, 0.0).otherwise((F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def nearest_rank(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """keys, q_value: the element at trunc((n - 1) q) of each group's sorted values, without
    interpolation. Equal values are counted before they are ordered, so a group is never collected."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    order = Window.partitionBy(*keys).orderBy(value)
    upto = counts.withColumn("_upto", F.sum("count").over(order)).withColumn("_n", F.sum("count").over(Window.partitionBy(*keys)))
    return upto.where(F.col("_upto") > F.floor((F.col("_n") - 1) * F.lit(q))).groupBy(*keys).agg(F.min(value).alias("q_value"))


def clamped_slope(x: str, y: str, lo: float, hi: float, least_var: float, default: float) -> Column:
    """OLS slope of y on x within [lo, hi]; default where x hardly varies."""
    return F.when(F.var_pop(x) > least_var, F.greatest(F.lit(lo), F.least(F.lit(hi), F.covar_pop(x, y) / F.var_pop(x)))).otherwise(default)


def exposure(rows: DataFrame, keys: list[str], x: str = "med", y: str = "v") -> DataFrame:
    """Gain (0.3 .. 3) and offset of every frame against the temporal median."""
    gain = clamped_slope(x, y, 0.3, 3.0, 1e-5, 1.0)
    return rows.groupBy(*keys).agg(gain.alias("gain"), (F.avg(y) - gain * F.avg(x)).alias("offset"))


def opacity(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """1 - slope of the median on the background, 0.5 without enough variance."""
    slope = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.covar_pop(x, y) / F.var_pop(x)))
    return rows.groupBy(*keys).agg(F.when(F.var_pop(x) >= 0.003, 1 - slope).otherwise(0.5).alias("alpha"))


def through_origin(rows: DataFrame, keys: list[str], expected: str, observed: str, absent: float = 1.0) -> DataFrame:
    """Presence: regression through the origin, within [-1, 2]; ``absent`` where nothing is expected."""
    den = F.sum(F.col(expected) * F.col(expected))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.sum(F.col(observed) * F.col(expected)) / den))
    return rows.groupBy(*keys).agg(F.when(den > 1e-3, score).otherwise(absent).alias("presence"))


def match_error(rows: DataFrame, keys: list[str], a: str, b: str, least: int = 1) -> DataFrame:
    """Population standard deviation of the difference, which brightness doesn't change."""
    return rows.groupBy(*keys).agg(F.when(F.count(a) >= least, F.stddev_pop(F.col(a) - F.col(b))).alias("error"))


def clean_mean(rows: DataFrame, keys: list[str], mask: str = "m", value: str = "v") -> DataFrame:
    """Mean of the pixels outside the mask; null without any."""
    return rows.groupBy(*keys).agg(F.avg(F.when(F.col(mask) == 0, F.col(value))).alias("mean"))


def layer_statistics(layer: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of masked, inverted and filled pixels of a layer (keys, alpha, fill), and the share of fills."""
    inverted, filled = F.count_if((F.col("alpha") > 0) & ~F.col("fill")), F.count_if("fill")
    got = layer.groupBy(*keys).agg((inverted + filled).alias("mask_pixels"), inverted.alias("inverted"), filled.alias("filled"))
    return got.withColumn("fill_share", F.when(F.col("mask_pixels") == 0, 0.0).otherwise(F.col("filled") / F.col("mask_pixels"))).withColumn("dominated", (F.col("mask_pixels") > 0) & (F.col("fill_share") >= 0.5))


def verified(scores: DataFrame, keys: list[str], inside: Column, least: float = 0.45, needed: int = 2) -> DataFrame:
    """How many frames outside a chunk a template was found in, and whether these are enough."""
    got = scores.withColumn("_in", inside).groupBy(*keys).agg(F.count_if(~F.col("_in") & (F.col("score") >= least)).alias("verified"), F.count_if(~F.col("_in")).alias("_out"))
    return got.select(*keys, "verified", (F.col("verified") >= F.least(F.lit(needed), F.col("_out"))).alias("enough"))
