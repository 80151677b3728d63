"""Frame tables: (clip, t, y, x[, c], v) and the projections on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import quantise

SIDE = 8


def embedding_frames(embeddings: DataFrame, side: int = SIDE) -> DataFrame:
    """Each vector of side * side numbers as a one-channel frame: clip (label), t (vec_id), y, x, v."""
    return embeddings.select(F.col("label").alias("clip"), F.col("vec_id").alias("t"), F.posexplode("embedding").alias("p", "e")).select(
        "clip", "t", (F.col("p") / side).cast("int").alias("y"), (F.col("p") % side).alias("x"), F.col("e").cast("double").alias("v")
    )


def closed_form_frames(spark: SparkSession, n: int = 16, w: int = 96, h: int = 48, alpha: float = 0.6, sx: int = 3, sy: int = 2) -> DataFrame:
    """Moving sine background (t, y, x, c, bg) under two white blocks of opacity alpha: b (byte), v."""
    cells = spark.range(n * h * w).select((F.col("id") / (h * w)).cast("int").alias("t"), ((F.col("id") / w).cast("int") % h).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    gx, gy = (F.col("x") + sx * F.col("t")).cast("double"), (F.col("y") + sy * F.col("t")).cast("double")
    red = 0.35 + 0.25 * F.sin(0.31 * gx) + 0.15 * F.sin(0.17 * gy)
    green = 0.40 + 0.20 * F.sin(0.23 * gx + 1) + 0.10 * F.sin(0.11 * (gx + gy))
    blue = 0.45 + 0.20 * F.sin(0.27 * gy + 2) + 0.10 * F.sin(0.13 * gx)
    rows = cells.select("t", "y", "x", F.posexplode(F.array(red, green, blue)).alias("c", "bg"))
    over = (F.col("x").between(20, 40) & F.col("y").between(14, 34)) | (F.col("x").between(50, 80) & F.col("y").between(22, 28))
    a = F.when(over, F.lit(alpha)).otherwise(0.0)
    b = quantise(a + (1 - a) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("bg"))))
    return rows.select("t", "y", "x", "c", "bg", a.alias("alpha"), b.alias("b")).withColumn("v", F.col("b") / 255.0)


def luminance(frames: DataFrame) -> DataFrame:
    return frames.groupBy("t", "y", "x").agg((F.sum("v") / 3).alias("lum"))


def shift(frames: DataFrame, w: int, h: int, dx: int, dy: int, keys: list[str]) -> DataFrame:
    """out(x, y) = in(x + dx, y + dy), clamped per axis: every source pixel is sent to the places it fills,
    so no join is needed."""

    def targets(axis: str, size: int, d: int) -> Column:
        at = F.col(axis) - d
        low = F.when(F.col(axis) == 0, F.lit(0)).otherwise(at)
        high = F.when(F.col(axis) == size - 1, F.lit(size - 1)).otherwise(at)
        low, high = F.greatest(F.lit(0), low), F.least(F.lit(size - 1), high)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    rows = frames.withColumn("_ty", targets("y", h, dy)).withColumn("_tx", targets("x", w, dx))
    rows = rows.withColumn("_y", F.explode("_ty")).withColumn("_x", F.explode("_tx"))
    return rows.select(*keys, F.col("_y").alias("y"), F.col("_x").alias("x"), "v")


def flip(frames: DataFrame, h: int) -> DataFrame:
    return frames.withColumn("y", h - 1 - F.col("y"))


def region(frames: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """Crop as a filter, then coordinates from the crop's corner."""
    inside = frames.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1))
    return inside.withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def unblend(v: Column, colour: Column, alpha: Column, fill: Column) -> Column:
    """The picture behind a translucent layer: (v - colour) / (1 - min(alpha, 0.8)), clamped."""
    return F.when(fill, v).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - colour) / (1 - F.least(alpha, F.lit(0.8))))))


def base_weight(alpha: Column, fill: Column) -> Column:
    """Confidence of an un-blended pixel: clean 10000, fill 0, else the inverse noise variance."""
    return F.when(fill, 0.0).when(alpha <= 0, 10000.0).otherwise(1 / F.pow(0.02 / (1 - alpha), 2))


def distinct_frames(embeddings: DataFrame) -> DataFrame:
    """First frame of every distinct content per clip."""
    return embeddings.groupBy(F.col("label").alias("clip"), "embedding").agg(F.min("vec_id").alias("t")).select("clip", "t")


def nearest_frames(targets: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """As-of pick: for every target time the frame nearest in time (earlier on ties), by two running
    windows over the union instead of a range join."""
    rows = targets.select(*keys, "target", F.lit(None).cast("long").alias("pts")).unionByName(frames.select(*keys, F.col("pts").alias("target"), "pts"))
    order = Window.partitionBy(*keys).orderBy("target", F.col("pts").isNull())
    back = Window.partitionBy(*keys).orderBy("target", F.col("pts").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("before", F.last("pts", True).over(back)).withColumn("after", F.first("pts", True).over(ahead)).where("pts is null")
    nearer = F.when(F.col("before").isNull() | (F.col("after") - F.col("target") < F.col("target") - F.col("before")), F.col("after")).otherwise(F.col("before"))
    return rows.select(*keys, "target", nearer.alias("pts"))


def ring(rows: DataFrame, width: int, height: int, border: int) -> DataFrame:
    """Pixels within ``border`` of the frame's edge."""
    x, y = F.col("x"), F.col("y")
    return rows.where((x < border) | (x >= width - border) | (y < border) | (y >= height - border))


def enough_samples(sync: DataFrame, exact: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """Sampled frames (keys, t, digest): those of the fast pass, and the exact ones too where the fast pass found too few
    different pictures. Of equal pictures the first counts, the fast pass's before the exact one's."""
    one = sync.withColumn("_pass", F.lit(0))
    found = one.groupBy(*keys).agg(F.count_distinct("digest").alias("_n"))
    few = exact.join(found, keys, "left").where(F.coalesce("_n", F.lit(0)) < least).drop("_n").withColumn("_pass", F.lit(1))
    best = one.unionByName(few).groupBy(*keys, "digest").agg(F.min(F.struct("_pass", "t")).alias("_b"))
    return best.select(*keys, F.col("_b.t").alias("t"), "digest")
