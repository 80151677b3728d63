"""Selections and guards: budgets, samples, hit tests, feeds, caches, mask adoption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_newer, trusted_url

BUDGET_BYTES, MAX_PIXELS = 96 << 20, 800_000


def within_budget(regions: DataFrame, keys: list[str], frames: Column) -> DataFrame:
    """Groups whose regions all fit and whose sampled pixels stay under the budget."""
    got = regions.groupBy(*keys).agg(F.sum(F.col("width").cast("long") * F.col("height") * 3).alias("_px"), F.max(F.col("width").cast("long") * F.col("height")).alias("_most"), F.max(frames).alias("frames"))
    return got.where((F.col("_px") * F.col("frames") <= BUDGET_BYTES) & (F.col("_most") <= MAX_PIXELS)).select(*keys, (F.col("_px") * F.col("frames")).alias("bytes"))


def systematic_sample(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Every stride-th row of a group, with the least stride that gives ``most`` rows at most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    got = rows.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return got.where(F.col("_k") % F.greatest(F.ceil(F.col("_n") / most), F.lit(1)) == 0).drop("_k", "_n")


def top_k(rows: DataFrame, keys: list[str], by: list[Column], most: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_r") <= most).drop("_r")


def hit_test(zones: DataFrame, keys: list[str], x: float, y: float, radius: float, preferred: Column) -> DataFrame:
    """Per group the zone that a touch means: the preferred zone's corners, then any corner in reach, then the
    last body under the point."""
    corner = F.least(*(F.greatest(F.abs(F.col(a) - x), F.abs(F.col(b) - y)) for a in ("left", "right") for b in ("top", "bottom")))
    inside = F.lit(x).between(F.col("left"), F.col("right")) & F.lit(y).between(F.col("top"), F.col("bottom"))
    rank = F.when((corner <= radius) & preferred, 0).when(corner <= radius, 1).when(inside, 2)
    rows = zones.withColumn("_rank", rank).where("_rank is not null")
    return top_k(rows, keys, [F.col("_rank"), F.desc("pos")], 1).select(*keys, "pos", F.col("_rank").alias("part"))


def latest_release(feed: Column, host: str, current: Column) -> Column:
    """(version, url, page, size, digest_url) of a release feed's JSON: no drafts or pre-releases, newer than the
    current version, with the last .apk asset and the last .apk.sha256 asset from the trusted host over https; the
    page where there is no asset."""
    f = F.from_json(feed, "tag_name string, html_url string, draft boolean, prerelease boolean, assets array<struct<name: string, browser_download_url: string, size: bigint>>")
    assets = F.coalesce(f.assets, F.array().cast("array<struct<name: string, browser_download_url: string, size: bigint>>"))
    named = lambda end: F.filter(assets, lambda a: F.lower(a.getField("name")).endswith(end))
    package = F.try_element_at(F.filter(named(".apk"), lambda a: trusted_url(a.browser_download_url, host)), F.lit(-1))
    digest = F.try_element_at(named(".apk.sha256"), F.lit(-1)).browser_download_url
    version = F.regexp_replace(F.coalesce(f.tag_name, F.lit("")), "^v", "")
    usable = ~F.coalesce(f.draft, F.lit(False)) & ~F.coalesce(f.prerelease, F.lit(False)) & (F.trim(version) != "") & is_newer(version, current)
    page = F.coalesce(f.html_url, F.lit(""))
    return F.when(
        usable,
        F.struct(
            version.alias("version"), F.coalesce(package.browser_download_url, page).alias("url"), page.alias("page"), F.coalesce(package.getField("size"), F.lit(0)).alias("size"),
            F.when(package.isNotNull() & trusted_url(digest, host), digest).alias("digest_url"),
        ),
    )


UPDATE = "version string, apk string, page string, size bigint, sha string"


def encode_update(version: Column, apk: Column, page: Column, size: Column, sha: Column) -> Column:
    return F.to_json(F.struct(version.alias("version"), apk.alias("apk"), page.alias("page"), size.cast("long").alias("size"), sha.alias("sha")))


def decode_update(json: Column) -> Column:
    """A cached update; null without version, package or page. A digest counts only with its 64 characters."""
    u = F.from_json(json, UPDATE)
    got = F.struct(u.version.alias("version"), u.apk.alias("apk"), u.page.alias("page"), F.coalesce(u.getField("size"), F.lit(0)).alias("size"), F.when(F.length(u.sha) == 64, u.sha).alias("sha"))
    return F.when(u.version.isNotNull() & u.apk.isNotNull() & u.page.isNotNull(), got)


def still_valid(update: Column, current: Column, host: str) -> Column:
    """Whether a cached update is still newer than what runs, and from the trusted host."""
    return F.coalesce(is_newer(update.version, current) & trusted_url(update.apk, host), F.lit(False))


def cached_or_fetched(cached: Column, fetched: Column, age_ms: Column, force: Column, ttl_ms: int = 21_600_000) -> Column:
    return F.when(~force & (age_ms < ttl_ms), cached).otherwise(fetched)


def two_blocks(stats: DataFrame, keys: list[str], least: int = 80) -> DataFrame:
    """Groups of exactly two large components side by side: gap in x of 2 to 30, more than 5 rows in common, like
    heights."""
    pair = stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("label", "size", "x0", "x1", "y0", "y1"))).alias("c")).where("n = 2")
    a, b = F.col("c")[0], F.col("c")[1]
    gap = F.greatest(a.x0 - b.x1, b.x0 - a.x1)
    common = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    ha, hb = a.y1 - a.y0 + 1, b.y1 - b.y0 + 1
    fits = (a.getField("size") >= least) & (b.getField("size") >= least) & gap.between(2, 30) & (common > 5) & (F.greatest(ha, hb) / F.least(ha, hb) < 1.6)
    return pair.select(*keys, fits.alias("joined"))


def adopt_union(masks: DataFrame, keys: list[str], parts: DataFrame | None = None) -> DataFrame:
    """Whether the union of two masks (m1, m2) replaces the first: it grows, by less than 1.8 times, stays under half
    of the pixels, and passes 15 % or has fewer components; parts (keys, parts_before, parts_after) counts these."""
    got = masks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("m1").alias("before"), F.sum(F.greatest("m1", "m2")).alias("after"))
    joins = F.lit(False)
    if parts is not None:
        got = got.join(parts, keys, "left")
        joins = F.coalesce(F.col("parts_after") < F.col("parts_before"), F.lit(False))
    fits = (F.col("after") > F.col("before")) & (F.col("after") < F.col("before") * 1.8) & (F.col("after") < F.col("n") * 0.5)
    return got.select(*keys, "before", "after", (fits & (joins | (F.col("after") > F.col("before") * 1.15))).alias("adopted"))


def nearest_first(candidates: Column) -> Column:
    """An array of structs in order of their field distance; equal distances keep their order."""
    placed = F.transform(candidates, lambda x, i: F.struct(x.distance.alias("d"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p.x)


def blank_render(rendered: DataFrame, reference: DataFrame, keys: list[str], width: int, height: int, steps: int = 8) -> DataFrame:
    """keys, blank: whether the probes of a grid, pixels (keys, y, x, v), are all 0 in what was rendered and not in what it
    was rendered from."""
    probes = lambda n: [n * (2 * i + 1) // (2 * steps) for i in range(steps)]
    on_grid = F.col("x").isin(probes(width)) & F.col("y").isin(probes(height))
    a = rendered.where(on_grid).groupBy(*keys).agg(F.bool_and(F.col("v") == 0).alias("_a"))
    b = reference.where(on_grid).groupBy(*keys).agg(F.bool_and(F.col("v") == 0).alias("_b"))
    return a.join(b, keys, "left").select(*keys, (F.col("_a") & ~F.coalesce("_b", F.lit(True))).alias("blank"))


def best_chunk(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Among chunks with 0.6 of the largest mask the one most filled, then the largest mask, then the first."""
    whole = Window.partitionBy(*keys)
    rows = chunks.withColumn("_most", F.max("mask").over(whole)).where(F.col("mask") >= 0.6 * F.col("_most"))
    return rows.groupBy(*keys).agg(F.max(F.struct("fraction", "mask", (-F.col("chunk")).alias("c"))).alias("b")).select(*keys, (-F.col("b.c")).alias("chunk"))


def purify(layer: DataFrame) -> DataFrame:
    """Every masked pixel becomes a fill without colour or opacity."""
    masked = (F.col("alpha") > 0) | F.col("fill")
    return layer.withColumns({"fill": masked, "alpha": F.lit(0.0)})
