"""All queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import components, frames, layers, selection, sequence, solvers, spatial, stats, stencil, tracking, zones
from ..sources import library
from ..sources.tables import read, ship
from ..streaming import restore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# DuckDB: pixels of the embeddings, each vector an 8 x 8 frame; and the closed-form frames.
PX = "px as materialized (select label as clip, vec_id as t, cast(i // 8 as int) as y, cast(i % 8 as int) as x, cast(embedding[i + 1] as double) as v from embeddings, range(64) r(i))"
CF = """g as (select cast(i // 4608 as int) as t, cast((i // 96) % 48 as int) as y, cast(i % 96 as int) as x from range(73728) r(i)),
bgs as (select t, y, x, unnest([0, 1, 2]) as c, unnest([0.35 + 0.25 * sin(0.31 * (x + 3 * t)) + 0.15 * sin(0.17 * (y + 2 * t)),
 0.40 + 0.20 * sin(0.23 * (x + 3 * t) + 1) + 0.10 * sin(0.11 * ((x + 3 * t) + (y + 2 * t))), 0.45 + 0.20 * sin(0.27 * (y + 2 * t) + 2) + 0.10 * sin(0.13 * (x + 3 * t))]) as bg from g),
cf as (select t, y, x, c, a, cast(floor(greatest(0, least(1, a + (1 - a) * greatest(0, least(1, bg)))) * 255 + 0.5) as int) as b, bg
 from (select *, cast(case when (x between 20 and 40 and y between 14 and 34) or (x between 50 and 80 and y between 22 and 28) then 0.6 else 0 end as double) as a from bgs))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def px(spark: SparkSession, d: str) -> DataFrame:
    return frames.embedding_frames(read(spark, d, "embeddings"))


def r6(c: str, alias: str | None = None):
    """Six digits, and no negative zero."""
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(alias or c)


def q6(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 as {alias or c}"


def sign_mask(rows: DataFrame) -> DataFrame:
    return rows.select("clip", "t", "y", "x", F.when(F.col("v") > 0, 1).otherwise(0).alias("m"))


MASK = "mk as (select clip, t, y, x, cast(v > 0 as int) as m from px)"


# --- temporal aggregates -----------------------------------------------------------------------------
@query("temporal_median_mad", f"with {PX}, m as (select clip, y, x, median(v) as med from px group by all) select clip, y, x, {q6('any_value(med)', 'med')}, round(median(abs(v - med)) * 1.4826, 6) + 0.0 as mad from px join m using (clip, y, x) group by clip, y, x")
def _(spark, d):
    return stats.median_mad(px(spark, d), ["clip", "y", "x"]).select("clip", "y", "x", r6("med"), r6("mad"))


@query("spread_map", f"with {CF}, m as (select y, x, c, median(b / 255.0) as med from cf group by all), s as (select y, x, c, median(abs(b / 255.0 - med)) * 1.4826 as mad from cf join m using (y, x, c) group by y, x, c) select y, x, round(avg(mad), 6) + 0.0 as spread from s group by y, x")
def _(spark, d):
    return stats.median_mad(frames.closed_form_frames(spark), ["y", "x", "c"]).groupBy("y", "x").agg(F.avg("mad").alias("spread")).select("y", "x", r6("spread"))


@query("mean_abs_deviation", f"with {PX}, m as (select clip, t, median(v) as med from px group by all) select clip, t, round(avg(abs(v - med)), 6) + 0.0 as mad from px join m using (clip, t) group by clip, t")
def _(spark, d):
    return stats.with_median(px(spark, d), ["clip", "t"]).groupBy("clip", "t").agg(F.avg(F.abs(F.col("v") - F.col("med"))).alias("mad")).select("clip", "t", r6("mad"))


@query("nearest_rank_quantile", "select l_returnflag, list_sort(list(l_quantity))[cast(floor((count(*) - 1) * 0.9) as bigint) + 1] as q_value from lineitem group by l_returnflag")
def _(spark, d):
    return stats.nearest_rank(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 0.9)


@query("nearest_rank_quantile_frames", f"with {PX} select clip, round(list_sort(list(v))[cast(floor((count(*) - 1) * 0.7) as bigint) + 1], 6) + 0.0 as q_value from px group by clip")
def _(spark, d):
    return stats.nearest_rank(px(spark, d), ["clip"], "v", 0.7).select("clip", r6("q_value"))


@query("exposure_regression", f"with {PX}, m as (select clip, y, x, median(v) as med from px group by all), j as (select * from px join m using (clip, y, x)), g as (select clip, t, case when var_pop(med) > 1e-5 then greatest(0.3, least(3.0, covar_pop(med, v) / var_pop(med))) else 1.0 end as gain, avg(v) as av, avg(med) as am from j group by clip, t) select clip, t, {q6('gain')}, {q6('av - gain * am', 'offs')} from g")
def _(spark, d):
    return stats.exposure(stats.with_median(px(spark, d), ["clip", "y", "x"]), ["clip", "t"]).select("clip", "t", r6("gain"), r6("offset", "offs"))


@query("motion_metric", f"with {PX}, m as (select clip, y, x, median(v) as med from px group by all), j as (select * from px join m using (clip, y, x)), g as (select clip, t, case when var_pop(med) > 1e-5 then greatest(0.3, least(3.0, covar_pop(med, v) / var_pop(med))) else 1.0 end as gain, avg(v) as av, avg(med) as am from j group by clip, t), e as (select clip, y, x, v - (gain * med + (av - gain * am)) as res from j join g using (clip, t)), em as (select clip, y, x, median(res) as rm from e group by all), s as (select clip, y, x, median(abs(res - rm)) * 1.4826 as mad from e join em using (clip, y, x) group by clip, y, x) select clip, round(median(mad), 6) + 0.0 as motion from s where x < 1 or x >= 7 or y < 1 or y >= 7 group by clip")
def _(spark, d):
    joined = stats.with_median(px(spark, d), ["clip", "y", "x"])
    residual = joined.join(stats.exposure(joined, ["clip", "t"]), ["clip", "t"]).withColumn("res", F.col("v") - (F.col("gain") * F.col("med") + F.col("offset")))
    return stats.median_mad(frames.ring(residual, 8, 8, 1), ["clip", "y", "x"], "res").groupBy("clip").agg(F.median("mad").alias("motion")).select("clip", r6("motion"))


@query("ols_opacity", "select l_returnflag, round(case when var_pop(l_discount) < 0.0003 then 0.5 else 1 - greatest(0, least(1, covar_pop(l_discount, l_tax) / var_pop(l_discount))) end, 6) + 0.0 as alpha from lineitem group by l_returnflag")
def _(spark, d):
    rows = read(spark, d, "lineitem")
    slope = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.covar_pop("l_discount", "l_tax") / F.var_pop("l_discount")))
    return rows.groupBy("l_returnflag").agg(F.when(F.var_pop("l_discount") < 0.0003, 0.5).otherwise(1 - slope).alias("alpha")).select("l_returnflag", r6("alpha"))


@query("frame_opacity", f"with {CF}, m as (select y, x, c, median(b / 255.0) as med, avg(bg) as bgm from cf where a > 0 group by all) select c, round(case when var_pop(bgm) < 0.003 then 0.5 else 1 - greatest(0, least(1, covar_pop(bgm, med) / var_pop(bgm))) end, 6) + 0.0 as alpha from m group by c")
def _(spark, d):
    rows = frames.closed_form_frames(spark).where("alpha > 0").groupBy("y", "x", "c").agg(F.median("v").alias("med"), F.avg("bg").alias("bgm"))
    return stats.opacity(rows, ["c"], "bgm", "med").select("c", r6("alpha"))


@query("tone_regression", f"with {PX}, p as (select clip, t, y, x, v, lag(v) over (partition by clip, y, x order by t) as was from px) select clip, t, round(case when var_pop(was) > 1e-5 then greatest(0.6, least(1.6, covar_pop(was, v) / var_pop(was))) else 1.0 end, 6) + 0.0 as gain from p where was is not null group by clip, t")
def _(spark, d):
    rows = sequence.history(px(spark, d), ["clip", "y", "x"], ["t"], "v", 1).where("v_1 is not null")
    return rows.groupBy("clip", "t").agg(stats.clamped_slope("v_1", "v", 0.6, 1.6, 1e-5, 1.0).alias("gain")).select("clip", "t", r6("gain"))


@query("pair_correlation", f"with {PX}, p as (select a.clip, a.y, a.x, corr(a.v, b.v) as r, count(*) as n from px a join px b on a.clip = b.clip and a.t = b.t and a.y = b.y and b.x = a.x + 1 group by all having var_pop(a.v) >= 4e-4 and var_pop(b.v) >= 4e-4) select clip, round(greatest(0, least(1, median(r))), 6) + 0.0 as gamma from p group by clip having count(*) >= 4")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("clip", "t", "y").orderBy("x")
    pairs = px(spark, d).withColumn("b", F.lead("v").over(w)).where("b is not null").groupBy("clip", "y", "x").agg(F.corr("v", "b").alias("r"), F.var_pop("v").alias("va"), F.var_pop("b").alias("vb"))
    ok = pairs.where("va >= 4e-4 and vb >= 4e-4").groupBy("clip").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.median("r"))).alias("gamma"), F.count(F.lit(1)).alias("n"))
    return ok.where("n >= 4").select("clip", r6("gamma"))


@query("presence_score", f"with {PX}, m as (select clip, y, x, median(v) as med from px group by all) select clip, t, round(case when sum(med * med) > 1e-3 then greatest(-1, least(2, sum(v * med) / sum(med * med))) else 1 end, 6) + 0.0 as presence from px join m using (clip, y, x) group by clip, t")
def _(spark, d):
    return stats.through_origin(stats.with_median(px(spark, d), ["clip", "y", "x"]), ["clip", "t"], "med", "v").select("clip", "t", r6("presence"))


@query("match_error", f"with {PX}, p as (select clip, t, v, lag(v) over (partition by clip, y, x order by t) as was from px) select clip, t, round(stddev_pop(v - was), 6) + 0.0 as error from p where was is not null group by clip, t")
def _(spark, d):
    rows = sequence.history(px(spark, d), ["clip", "y", "x"], ["t"], "v", 1).where("v_1 is not null")
    return stats.match_error(rows, ["clip", "t"], "v", "v_1").select("clip", "t", r6("error"))


@query("motion_search", f"with {CF}, l as materialized (select t, y, x, sum(b) / 765.0 as lum from cf where t < 4 group by t, y, x having max(a) = 0), n as (select count(*) as n from l where t = 0), e as (select a.t, a.x - b.x as dx, a.y - b.y as dy, round(sqrt(greatest(0, avg((a.lum - b.lum) * (a.lum - b.lum)) - avg(a.lum - b.lum) * avg(a.lum - b.lum))), 9) as err from l a join l b on b.t = a.t - 1 where a.x - b.x between -24 and 24 and a.y - b.y between -24 and 24 group by a.t, a.x - b.x, a.y - b.y having count(*) >= greatest((select n from n) / 3.0, 30)) select t, arg_min(dx, (err, abs(dx) + abs(dy), dy, dx)) as dx, arg_min(dy, (err, abs(dx) + abs(dy), dy, dx)) as dy, round(min(err), 6) + 0.0 as error from e group by t having min(err) <= 0.06")
def _(spark, d):
    rows = frames.closed_form_frames(spark, n=4)
    clean = rows.groupBy("t", "y", "x").agg((F.max("alpha") == 0).alias("clean"))
    return restore.frame_motion(frames.luminance(rows).join(clean, ["t", "y", "x"]), []).where("dx is not null").select("t", "dx", "dy", r6("error"))


# --- neighbourhoods ------------------------------------------------------------------------------------
def _gradient_sql(axis: str) -> str:
    other = "y" if axis == "x" else "x"
    return f"{PX}, gd as (select clip, t, y, x, lead(v) over (partition by clip, t, {other} order by {axis}) - v as d from px), gm as (select clip, y, x, median(d) as med from gd where d is not null group by all), gg as (select clip, y, x, any_value(med) as med, median(abs(d - med)) * 1.4826 as mad from gd join gm using (clip, y, x) where d is not null group by clip, y, x)"


for _axis in ("x", "y"):

    @query(f"consistent_gradient_{_axis}", f"with {_gradient_sql(_axis)} select clip, y, x, round(case when abs(med) > 0.02 and abs(med) > 2 * mad then med else 0 end, 6) + 0.0 as g from gg")
    def _(spark, d, axis=_axis):
        return stencil.consistent_gradient(px(spark, d), ["clip"], axis).select("clip", "y", "x", r6("g"))


@query("significant_gradient", f"with {_gradient_sql('x')}, n as (select clip, count(distinct t) as n from px group by clip), mm as (select clip, y, x, cast(median(v) > 0 as int) as m from px group by all), tt as (select clip, y, x, greatest(m, coalesce(lead(m) over (partition by clip, y order by x), 0)) as touch from mm) select clip, y, x, round(case when abs(med) > 2.5 / sqrt(n) * mad then med else 0 end, 6) + 0.0 as g from gg join n using (clip) join tt using (clip, y, x) where touch = 1")
def _(spark, d):
    rows = px(spark, d)
    mask = rows.groupBy("clip", "y", "x").agg(F.when(F.median("v") > 0, 1).otherwise(0).alias("m"))
    return stencil.significant_gradient(rows, mask, ["clip"], "x").select("clip", "y", "x", r6("g"))


@query("gradient_energy", f"with {CF}, px as (select c as clip, t, y, x, b / 255.0 as v from cf), gx as (select clip, t, y, x, lead(v) over (partition by clip, t, y order by x) - v as d from px), gy as (select clip, t, y, x, lead(v) over (partition by clip, t, x order by y) - v as d from px), ga as (select 0 as ax, * from gx where d is not null union all select 1, * from gy where d is not null), gm as (select ax, clip, y, x, median(d) as med from ga group by all), gs as (select ax, clip, y, x, any_value(med) as med, median(abs(d - med)) * 1.4826 as mad from ga join gm using (ax, clip, y, x) group by ax, clip, y, x), gc as (select * from gs where abs(med) > 0.02 and abs(med) > 2 * mad), en as (select clip, y, x, med * med as s from gc union all select clip, y + ax, x + 1 - ax, med * med from gc) select clip, y, x, round(sum(s), 6) + 0.0 as energy from en group by all")
def _(spark, d):
    rows = frames.closed_form_frames(spark).select(F.col("c").alias("clip"), "t", "y", "x", "v")
    return stencil.gradient_energy(rows, ["clip"]).select("clip", "y", "x", r6("energy"))


for _r in (1, 2):

    @query(f"local_range_r{_r}", f"with {PX} select a.clip, a.t, a.y, a.x, round(max(b.v) - min(b.v), 6) + 0.0 as span from px a join px b on a.clip = b.clip and a.t = b.t and abs(a.y - b.y) <= {_r} and abs(a.x - b.x) <= {_r} group by all")
    def _(spark, d, r=_r):
        return stencil.local_range(px(spark, d), ["clip", "t"], r).select("clip", "t", "y", "x", r6("span"))


@query("dilate_mask", f"with {PX}, {MASK} select a.clip, a.t, a.y, a.x, max(b.m) as m from mk a join mk b on a.clip = b.clip and a.t = b.t and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all")
def _(spark, d):
    return stencil.dilate(sign_mask(px(spark, d)), ["clip", "t"])


@query("masked_median_3x3", f"with {PX} select a.clip, a.t, a.y, a.x, round(case when a.v >= 0 and count(b.v) >= 3 then median(b.v) else -1 end, 6) + 0.0 as v from px a left join px b on a.clip = b.clip and a.t = b.t and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and b.v >= 0 group by a.clip, a.t, a.y, a.x, a.v")
def _(spark, d):
    return stencil.masked_median(px(spark, d), ["clip", "t"]).select("clip", "t", "y", "x", r6("v"))


@query("fill_distances", f"with {PX}, {MASK}, j as (select a.clip, a.t, a.y, a.x, a.m, min(case when b.y = a.y and b.x < a.x then a.x - b.x end) as l, min(case when b.y = a.y and b.x > a.x then b.x - a.x end) as r, min(case when b.x = a.x and b.y < a.y then a.y - b.y end) as u, min(case when b.x = a.x and b.y > a.y then b.y - a.y end) as d from mk a left join mk b on a.clip = b.clip and a.t = b.t and b.m = 0 and (a.y = b.y or a.x = b.x) group by all) select clip, t, y, x, m, case when m = 0 then 0 else coalesce(l, 255) end as dl, case when m = 0 then 0 else coalesce(r, 255) end as dr, case when m = 0 then 0 else coalesce(u, 255) end as du, case when m = 0 then 0 else coalesce(d, 255) end as dd from j")
def _(spark, d):
    return stencil.fill_distances(sign_mask(px(spark, d)), ["clip", "t"])


@query("directional_nearest", f"with {PX}, {MASK}, j as (select a.clip, a.t, a.y, a.x, max(case when b.y = a.y and b.x < a.x then b.x end) as l, min(case when b.y = a.y and b.x > a.x then b.x end) as r, max(case when b.x = a.x and b.y < a.y then b.y end) as u, min(case when b.x = a.x and b.y > a.y then b.y end) as d from mk a left join mk b on a.clip = b.clip and a.t = b.t and b.m = 0 and (a.y = b.y or a.x = b.x) where a.m = 1 group by a.clip, a.t, a.y, a.x) select clip, t, y, x, coalesce(l, -1) as \"left\", coalesce(r, -1) as \"right\", coalesce(u, -1) as up, coalesce(d, -1) as down from j")
def _(spark, d):
    return stencil.directional_nearest(sign_mask(px(spark, d)), ["clip", "t"])


@query("gaussian_blur_9x9", f"with {PX}, k as (select i as dy, j as dx, exp(-(i * i + j * j) / 10.0) as w from range(-4, 5) a(i), range(-4, 5) b(j)), tp as (select clip, t, y, x, least(7, greatest(0, y + dy)) as sy, least(7, greatest(0, x + dx)) as sx, w from px, k) select tp.clip, tp.t, tp.y, tp.x, round(sum(w * b.v) / sum(w), 6) + 0.0 as v from tp join px b on b.clip = tp.clip and b.t = tp.t and b.y = sy and b.x = sx group by all")
def _(spark, d):
    return stencil.weighted_blur(px(spark, d), ["clip", "t"], 8, 8).select("clip", "t", "y", "x", r6("v"))


@query("pixelate", f"with {PX} select a.clip, a.t, a.y, a.x, round(b.v, 6) + 0.0 as v from px a join px b on a.clip = b.clip and a.t = b.t and b.y = least(7, (a.y // 3) * 3 + 1) and b.x = least(7, (a.x // 3) * 3 + 1)")
def _(spark, d):
    return stencil.pixelate(px(spark, d), ["clip", "t"], 3).select("clip", "t", "y", "x", r6("v"))


# --- frame projections -----------------------------------------------------------------------------------
@query("luminance", f"with {CF} select t, y, x, round(sum(b) / 765.0, 6) + 0.0 as lum from cf group by t, y, x")
def _(spark, d):
    return frames.luminance(frames.closed_form_frames(spark)).select("t", "y", "x", r6("lum"))


@query("quantise", f"with {CF} select t, c, cast(sum(b) as bigint) as total, cast(min(b) as int) as lo, cast(max(b) as int) as hi from cf group by t, c")
def _(spark, d):
    return frames.closed_form_frames(spark).groupBy("t", "c").agg(F.sum("b").alias("total"), F.min("b").alias("lo"), F.max("b").alias("hi"))


@query("frame_shift", f"with {PX} select a.clip, a.t, a.y, a.x, round(b.v, 6) + 0.0 as v from px a join px b on a.clip = b.clip and a.t = b.t and b.y = least(7, greatest(0, a.y - 1)) and b.x = least(7, greatest(0, a.x + 2))")
def _(spark, d):
    return frames.shift(px(spark, d), 8, 8, 2, -1, ["clip", "t"]).select("clip", "t", "y", "x", r6("v"))


@query("frame_flip", f"with {PX} select clip, t, 7 - y as y, x, round(v, 6) + 0.0 as v from px")
def _(spark, d):
    return frames.flip(px(spark, d), 8).select("clip", "t", "y", "x", r6("v"))


@query("region_extract", f"with {PX} select clip, t, y - 2 as y, x - 1 as x, round(v, 6) + 0.0 as v from px where x between 1 and 5 and y between 2 and 5")
def _(spark, d):
    return frames.region(px(spark, d), 1, 2, 5, 4).select("clip", "t", "y", "x", r6("v"))


@query("unblend", f"with {CF} select t, y, x, c, round(greatest(0, least(1, (b / 255.0 - a) / (1 - least(a, 0.8)))), 6) + 0.0 as v, round(case when a <= 0 then 10000.0 else 1 / power(0.02 / (1 - a), 2) end, 6) + 0.0 as weight from cf where t < 2")
def _(spark, d):
    rows = frames.closed_form_frames(spark, n=2)
    v = frames.unblend(F.col("v"), F.col("alpha"), F.col("alpha"), F.lit(False))
    return rows.withColumns({"v": v, "weight": frames.base_weight(F.col("alpha"), F.lit(False))}).select("t", "y", "x", "c", r6("v"), r6("weight"))


@query("distinct_frames", "select label as clip, min(vec_id) as t from embeddings group by label, embedding")
def _(spark, d):
    return frames.distinct_frames(read(spark, d, "embeddings"))


@query("border_ring", f"with {PX} select clip, t, cast(count(*) as bigint) as n, round(avg(v), 6) + 0.0 as mean from px where x < 2 or x >= 6 or y < 2 or y >= 6 group by clip, t")
def _(spark, d):
    return frames.ring(px(spark, d), 8, 8, 2).groupBy("clip", "t").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).select("clip", "t", "n", r6("mean"))


@query("layer_statistics", f"with {PX}, l as (select clip, t, greatest(v, 0) as a, v > 0 and y < 4 as fill from px), g as (select clip, t, count(*) filter (a > 0 and not fill) as inverted, count(*) filter (fill) as filled from l group by all) select clip, t, inverted + filled as mask_pixels, inverted, filled, round(case when inverted + filled = 0 then 0 else filled / (inverted + filled) end, 6) + 0.0 as fill_share, inverted + filled > 0 and filled >= 0.5 * (inverted + filled) as dominated from g")
def _(spark, d):
    layer = px(spark, d).select("clip", "t", F.greatest("v", F.lit(0.0)).alias("alpha"), ((F.col("v") > 0) & (F.col("y") < 4)).alias("fill"))
    return stats.layer_statistics(layer, ["clip", "t"]).select("clip", "t", "mask_pixels", "inverted", "filled", r6("fill_share"), "dominated")


@query("clean_mean", f"with {PX}, {MASK} select px.clip, px.t, round(avg(case when m = 0 then v end), 6) + 0.0 as mean from px join mk using (clip, t, y, x) group by px.clip, px.t")
def _(spark, d):
    return stats.clean_mean(px(spark, d).withColumn("m", F.when(F.col("v") > 0, 1).otherwise(0)), ["clip", "t"]).select("clip", "t", r6("mean"))


@query("verified_count", f"with {PX}, s as (select clip, t, max(v) as score from px group by all) select clip, count(*) filter (t % 3 <> 0 and score >= 0.45) as verified, count(*) filter (t % 3 <> 0 and score >= 0.45) >= least(2, count(*) filter (t % 3 <> 0)) as enough from s group by clip")
def _(spark, d):
    return stats.verified(px(spark, d).groupBy("clip", "t").agg(F.max("v").alias("score")), ["clip"], F.col("t") % 3 == 0)


def millis() -> Column:
    """Milliseconds since 1970 of a time without zone, whatever zone the session has."""
    return F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


# --- sequences ----------------------------------------------------------------------------------------------
EV = "ev as (select *, epoch_us(ts) // 1000 as ms from events)"


@query("sliding_chunks_8_3", "with n as (select user_id, count(*) as n from events group by user_id) select user_id, s as start, least(s + 8, n) as stop from (select user_id, n, unnest(range(0, n + 1, 3)) as s from n where n >= 6) where s + 6 <= n and (s = 0 or s + 5 < n)")
def _(spark, d):
    return sequence.chunks(read(spark, d, "events"), ["user_id"], ["ts"]).select("user_id", F.col("start").cast("long"), F.col("stop").cast("long"))


@query("presence_split_gap", f"with {PX}, s as (select clip, t, round(max(v), 6) as score from px group by all), g as (select *, lead(score) over w - score as gap, count(*) over (partition by clip) - row_number() over w as above, max(score) over (partition by clip) as top from s window w as (partition by clip order by score)), b as (select clip, top, max(gap) as gap, arg_max(score, (gap, -score)) as cut from g where above >= 4 group by clip, top) select clip, case when top > 0 and gap > 0 and gap >= 0.4 * top and cut <= 0.3 * top then cut end as cut from b")
def _(spark, d):
    scores = px(spark, d).groupBy("clip", "t").agg(F.round(F.max("v"), 6).alias("score"))
    return sequence.gap_split(scores, ["clip"])


@query("hysteresis_presence", "with recursive e as (select user_id, event_id, (value % 100) / 100.0 as p, row_number() over (partition by user_id order by event_id) as k from events), w as (select user_id, event_id, k, greatest(0, least(1, (p - 0.35) / 0.20)) as s from e where k = 1 union all select e.user_id, e.event_id, e.k, greatest(0, least(1, case when w.s >= 0.5 then (e.p - 0.10) / 0.20 else (e.p - 0.35) / 0.20 end)) from w join e on e.user_id = w.user_id and e.k = w.k + 1) select user_id, event_id, round(s, 6) + 0.0 as strength, s >= 0.5 as present from w")
def _(spark, d):
    rows = read(spark, d, "events").withColumn("p", (F.col("value") % 100) / 100.0)
    return sequence.hysteresis(rows, ["user_id"], ["event_id"], "p").select("user_id", "event_id", r6("strength"), "present")


@query("running_motion_reset", "with s as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as scene from events) select user_id, event_id, round(sum(value) over (partition by user_id, scene order by event_id), 4) + 0.0 as total from s")
def _(spark, d):
    out = sequence.running_motion(read(spark, d, "events"), ["user_id"], ["event_id"], "value", F.col("event_type") == "purchase")
    return out.select("user_id", "event_id", (F.round("total", 4) + F.lit(0.0)).alias("total"))


@query("change_filter", "select user_id, event_id, event_type from (select *, lag(event_type) over w as was, row_number() over w as k from events window w as (partition by user_id order by event_id)) where k = 1 or event_type is distinct from was")
def _(spark, d):
    return sequence.change_filter(read(spark, d, "events"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("debounce_last", f"with {EV} select user_id, event_id from (select *, lead(ms) over (partition by user_id order by ts, event_id) as nxt from ev) where nxt is null or nxt - ms >= 3600000")
def _(spark, d):
    return sequence.debounce(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], millis(), 3_600_000).select("user_id", "event_id")


@query("frame_history", f"with {PX} select clip, t, y, x, round(lag(v, 1) over w, 6) + 0.0 as v_1, round(lag(v, 2) over w, 6) + 0.0 as v_2, round(lag(v, 3) over w, 6) + 0.0 as v_3 from px window w as (partition by clip, y, x order by t)")
def _(spark, d):
    return sequence.history(px(spark, d), ["clip", "y", "x"], ["t"], "v", 3).select("clip", "t", "y", "x", r6("v_1"), r6("v_2"), r6("v_3"))


_COUNT_RULE = "case when d <= 0 then 16 when d < 4000 then 10 when d < 15000 then 16 when d < 60000 then 20 else 24 end"


@query("sample_count_rule", f"select event_id, {_COUNT_RULE} as n from (select event_id, cast(floor(value * 200) as bigint) - 500 as d from events)")
def _(spark, d):
    return read(spark, d, "events").select("event_id", S.sample_count(F.floor(F.col("value") * 200) - 500).alias("n"))


@query("sample_times", f"with {EV}, s as (select user_id, min(ms) as a, max(ms) as b, count(*) as n from ev group by user_id) select user_id, cast(k as int) as k, cast(floor(case when n = 1 then ((a + (b - a) * 0.05) + (a + (b - a) * 0.95)) / 2 else (a + (b - a) * 0.05) + ((a + (b - a) * 0.95) - (a + (b - a) * 0.05)) * k / (m - 1) end) as bigint) // 1000 as target from (select *, least(n, 16) as m from s), lateral (select unnest(range(0, m)) as k)")
def _(spark, d):
    spans = read(spark, d, "events").withColumn("ms", millis()).groupBy("user_id").agg(F.min("ms").alias("a"), F.max("ms").alias("b"), F.least(F.count(F.lit(1)), F.lit(16)).cast("int").alias("n"))
    out = sequence.sample_times(spans, ["user_id"], F.col("a").cast("double"), F.col("b").cast("double"), F.col("n"))
    return out.select("user_id", "k", F.floor(F.col("target") / 1000).alias("target"))


@query("nearest_frame", f"with {EV}, tg as (select user_id, (min(ms) + max(ms)) // 2 as target from ev group by user_id) select tg.user_id, target, arg_min(ms, (abs(ms - target), ms)) as pts from tg join ev using (user_id) group by all")
def _(spark, d):
    ev = read(spark, d, "events").select("user_id", millis().alias("pts"))
    target = ev.groupBy("user_id").agg(F.expr("(min(pts) + max(pts)) div 2").alias("target"))
    return frames.nearest_frames(target, ev, ["user_id"])


# --- components ---------------------------------------------------------------------------------------------
LABELS = f"{PX}, mc as (select clip, t, y, x, y * 8 + x as p from px where v > 0.05), rc(clip, t, y, x, lo) as (select clip, t, y, x, p from mc union select b.clip, b.t, b.y, b.x, rc.lo from rc join mc b on b.clip = rc.clip and b.t = rc.t and abs(b.y - rc.y) <= 1 and abs(b.x - rc.x) <= 1), lm as (select clip, t, y, x, min(lo) as lo from rc group by all), lb as (select clip, t, y, x, cast(dense_rank() over (partition by clip, t order by lo) as int) as label from lm)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = px(spark, d).select("clip", "t", "y", "x", F.when(F.col("v") > 0.05, 1).otherwise(0).alias("m"))
    return components.label_frames(rows, ["clip", "t"])


@query("connected_components", f"with recursive {LABELS} select * from lb")
def _(spark, d):
    return labelled(spark, d)


@query("remove_small", f"with recursive {LABELS} select clip, t, y, x, label from (select *, count(*) over (partition by clip, t, label) as n from lb) where n >= 6")
def _(spark, d):
    return components.remove_small(labelled(spark, d), ["clip", "t"], 6)


_STATS = "st as (select clip, t, label, count(*) as size, cast(count(*) as double) as mass, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from lb group by all)"


@query("component_stats", f"with recursive {LABELS}, {_STATS} select * from st")
def _(spark, d):
    return components.statistics(labelled(spark, d), ["clip", "t"])


@query("topk_components", f"with recursive {LABELS}, {_STATS} select clip, t, label, mass, cast(rank as int) as rank from (select *, row_number() over (partition by clip, t order by mass desc, label) as rank, max(mass) over (partition by clip, t) as top from st where size >= 4 and mass > 0) where rank <= 3 and mass >= 0.05 * top")
def _(spark, d):
    return components.top_components(components.statistics(labelled(spark, d), ["clip", "t"]), ["clip", "t"], least=4).select("clip", "t", "label", "mass", "rank")


# --- zones and rectangles -----------------------------------------------------------------------------------
def part_rects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    side = lambda a, m: ((k * a) % m).cast("double") / m
    return read(spark, d, "part").select("p_partkey", S.rect(side(7, 101) * 1.2 - 0.1, side(13, 89), side(31, 97), side(17, 83)).alias("r"))


_RAW = "raw as (select p_partkey as k, cast((p_partkey * 7) % 101 as double) / 101 * 1.2 - 0.1 as l, cast((p_partkey * 13) % 89 as double) / 89 as t, cast((p_partkey * 31) % 97 as double) / 97 as r, cast((p_partkey * 17) % 83 as double) / 83 as b from part)"
_SAN = f"{_RAW}, s1 as (select k, greatest(0, least(1, least(l, r))) as l, greatest(0, least(1, least(t, b))) as t, greatest(0, least(1, greatest(l, r))) as r, greatest(0, least(1, greatest(t, b))) as b from raw), san as (select k, l, t, case when r - l < 0.02 then least(1, l + 0.02) else r end as r, case when b - t < 0.02 then least(1, t + 0.02) else b end as b from s1)"


def rect_columns(c: str):
    return [(F.round(F.col(f"{c}.{x}"), 6) + F.lit(0.0)).alias(x) for x in ("left", "top", "right", "bottom")]


def _rect_sql(left: str, t: str, r: str, b: str) -> str:
    return f'round({left}, 6) + 0.0 as "left", round({t}, 6) + 0.0 as top, round({r}, 6) + 0.0 as "right", round({b}, 6) + 0.0 as bottom'


def sane_rects(spark: SparkSession, d: str) -> DataFrame:
    return part_rects(spark, d).withColumn("r", S.rect_sanitized(F.col("r")))


@query("rect_sanitize", f"with {_SAN} select k as p_partkey, {_rect_sql('l', 't', 'r', 'b')} from san")
def _(spark, d):
    return sane_rects(spark, d).select("p_partkey", *rect_columns("r"))


@query("rect_translate", f"with {_SAN}, m as (select *, case when 1 - r < -l then -l else greatest(-l, least(1 - r, 0.3)) end as dx, case when 1 - b < -t then -t else greatest(-t, least(1 - b, -0.2)) end as dy from san) select k as p_partkey, {_rect_sql('l + dx', 't + dy', 'r + dx', 'b + dy')} from m")
def _(spark, d):
    return sane_rects(spark, d).withColumn("r", S.rect_translated(F.col("r"), F.lit(0.3), F.lit(-0.2))).select("p_partkey", *rect_columns("r"))


@query("rect_resize", f"with {_SAN} select k as p_partkey, {_rect_sql('case when k % 2 = 0 then greatest(0, least(r - 0.02, l + 0.1)) else l end', 'case when k % 4 < 2 then greatest(0, least(b - 0.02, t - 0.05)) else t end', 'case when k % 2 = 1 then greatest(l + 0.02, least(1, r + 0.1)) else r end', 'case when k % 4 >= 2 then greatest(t + 0.02, least(1, b - 0.05)) else b end')} from san")
def _(spark, d):
    k = F.col("p_partkey")
    corner = F.concat(F.when(k % 4 < 2, "TOP").otherwise("BOTTOM"), F.when(k % 2 == 0, "_LEFT").otherwise("_RIGHT"))
    return sane_rects(spark, d).withColumn("r", S.rect_resized(F.col("r"), corner, F.lit(0.1), F.lit(-0.05))).select("p_partkey", *rect_columns("r"))


@query("crop_rect", f"with {_SAN}, c as (select *, list_position([t, 1 - b, l, 1 - r], greatest(t, 1 - b, l, 1 - r)) as w from san) select k as p_partkey, {_rect_sql('case when w = 4 then r else 0 end', 'case when w = 2 then b else 0 end', 'case when w = 3 then l else 1 end', 'case when w = 1 then t else 1 end')} from c")
def _(spark, d):
    return sane_rects(spark, d).withColumn("r", S.crop_excluding(F.col("r"))).select("p_partkey", *rect_columns("r"))


@query("ndc_crop", f"with {_SAN} select k as p_partkey, {_rect_sql('l * 2 - 1', '1 - t * 2', 'r * 2 - 1', '1 - b * 2')} from san")
def _(spark, d):
    return sane_rects(spark, d).withColumn("r", S.to_ndc(F.col("r"))).select("p_partkey", *rect_columns("r"))


@query("even_size", f"with {_SAN}, n as (select k, greatest(2, cast(floor(1921 * (r - l)) as int)) as w, greatest(2, cast(floor(1079 * (b - t)) as int)) as h from san) select k as p_partkey, w - w % 2 as width, h - h % 2 as height from n")
def _(spark, d):
    r = F.col("r")
    return sane_rects(spark, d).select("p_partkey", S.even_size(F.lit(1921), r.right - r.left).alias("width"), S.even_size(F.lit(1079), r.bottom - r.top).alias("height"))


def _region_sql(margin: int) -> str:
    return f"{{'l': greatest(0, cast(floor(l * 1920 + 0.5) as int) - {margin}), 't': greatest(0, cast(floor(t * 1080 + 0.5) as int) - {margin}), 'r': least(1920, cast(floor(r * 1920 + 0.5) as int) + {margin}), 'b': least(1080, cast(floor(b * 1080 + 0.5) as int) + {margin})}}"


@query("region_of_zone", f"with {_SAN}, m as (select k, {_region_sql(28)} as a, {_region_sql(14)} as c, {_region_sql(8)} as e from san), p as (select k, case when greatest(1, a.r - a.l) * greatest(1, a.b - a.t) <= 800000 then a when greatest(1, c.r - c.l) * greatest(1, c.b - c.t) <= 800000 then c else e end as z from m) select k as p_partkey, z.l as \"left\", z.t as top, greatest(1, z.r - z.l) as width, greatest(1, z.b - z.t) as height from p")
def _(spark, d):
    return sane_rects(spark, d).select("p_partkey", S.region_of(F.col("r"), F.lit(1920), F.lit(1080)).alias("z")).select("p_partkey", "z.left", "z.top", "z.width", "z.height")


@query("zone_hit", f"with {_SAN} select k as p_partkey, 0.5 between l and r and 0.4 between t and b as hit from san")
def _(spark, d):
    return sane_rects(spark, d).select("p_partkey", S.rect_contains(F.col("r"), F.lit(0.5), F.lit(0.4)).alias("hit"))


@query("zone_uniforms", f"with {_SAN}, z as (select *, row_number() over (partition by k % 10 order by k) as n from san) select k as p_partkey, {_rect_sql('l', '1 - b', 'r', '1 - t')} from z where n <= 6")
def _(spark, d):
    rows = zones.first_zones(sane_rects(spark, d).withColumns({"g": F.col("p_partkey") % 10, "pos": F.col("p_partkey")}), ["g"])
    r = F.col("r")
    return rows.withColumn("r", S.rect(r.left, 1 - r.bottom, r.right, 1 - r.top)).select("p_partkey", *rect_columns("r"))


@query("atlas_packing", "with l as (select p_partkey % 50 as g, p_partkey as pos, case when p_size % 7 <> 0 then p_size * 3 + 1 end as w, p_size + 2 as h from part) select g, pos, w as width, h as height, coalesce(cast(sum(h) over (partition by g order by pos rows between unbounded preceding and 1 preceding) as bigint), 0) as atlas_row, max(w) over (partition by g) as atlas_width, cast(sum(h) over (partition by g) as bigint) as atlas_height from l where w is not null and pos % 11 <> 0")
def _(spark, d):
    rows = read(spark, d, "part").select((F.col("p_partkey") % 50).alias("g"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 3 + 1).alias("width"), (F.col("p_size") + 2).alias("height"))
    # Every eleventh layer was analysed in another size than its region has now.
    rows = rows.withColumns({"region_width": F.col("width"), "region_height": F.col("height") + F.when(F.col("pos") % 11 == 0, 1).otherwise(0)})
    return zones.atlas(rows, ["g"])


_REG = "zn as (select p_partkey as zone_id from part), rg as (select p_partkey // 2 as zone_id, p_partkey as pos, p_size as \"left\", p_size + 1 as top, p_size + 2 as width, p_size + 3 as height, p_size % 3 as mask_pixels from part)"


def region_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, d, "part")
    s = F.col("p_size")
    return part.select(F.col("p_partkey").alias("zone_id")), part.select(F.floor(F.col("p_partkey") / 2).alias("zone_id"), F.col("p_partkey").alias("pos"), s.alias("left"), (s + 1).alias("top"), (s + 2).alias("width"), (s + 3).alias("height"), (s % 3).alias("mask_pixels"))


@query("zone_lookup_default", f"with {_REG}, f as (select zone_id, arg_min({{'l': \"left\", 't': top, 'w': width, 'h': height}}, pos) as r from rg where mask_pixels > 0 group by zone_id) select zone_id, coalesce(r.l, 0) as \"left\", coalesce(r.t, 0) as top, coalesce(r.w, 0) as width, coalesce(r.h, 0) as height from zn left join f using (zone_id)")
def _(spark, d):
    return zones.lookup(*region_rows(spark, d))


@query("remaining_zones", f"with {_REG} select zone_id from zn where zone_id not in (select zone_id from rg where mask_pixels > 0)")
def _(spark, d):
    return zones.remaining(*region_rows(spark, d))


@query("positional_join", "with a as (select row_number() over (order by p_partkey) - 1 as pos, p_partkey as zone_id from part), b as (select row_number() over (order by s_suppkey) - 1 as pos, s_suppkey as layer_id from supplier) select pos, zone_id, layer_id from a join b using (pos)")
def _(spark, d):
    zone_list = zones.numbered(read(spark, d, "part").select(F.col("p_partkey").alias("zone_id")), "zone_id")
    return zones.positional(zone_list, zones.numbered(read(spark, d, "supplier").select(F.col("s_suppkey").alias("layer_id")), "layer_id")).select("pos", "zone_id", "layer_id")


@query("feather_units", "select p_partkey, round(case when p_size % 2 = 0 then 2.5 else (p_size / 50.0) * 0.03 * least(p_size * 40, 1080) end / greatest(p_size * 40, 1080), 6) + 0.0 as feather from part")
def _(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", S.feather_units(s % 2 == 0, s / 50.0, s * 40, F.lit(1080)).alias("feather")).select("p_partkey", r6("feather"))


@query("target_bitrate", "select p_partkey, cast(greatest(2000000, least(120000000, greatest(floor(cast(p_size * 80 as bigint) * (p_size * 45) * 0.30 * case when p_size % 5 > 1 then 24.0 * (p_size % 5) else 30.0 end), floor(p_size * 100000 * 2.0)))) as int) as bitrate from part")
def _(spark, d):
    s = F.col("p_size")
    fps = F.when(s % 5 > 1, 24.0 * (s % 5)).otherwise(1.0)
    return read(spark, d, "part").select("p_partkey", S.target_bitrate(s * 80, s * 45, fps, s * 100000).alias("bitrate"))


@query("derived_bitrate", "select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey when o_orderkey % 5 > 0 then least(cast(floor(o_totalprice) as bigint) * 8000 // (o_orderkey % 5 * 1000), 2147483647) else 0 end as bitrate from orders")
def _(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", S.bitrate_or_derived(F.when(k % 3 == 0, k).otherwise(0), F.floor("o_totalprice"), k % 5 * 1000).cast("long").alias("bitrate"))


@query("display_size", "select p_partkey, case when ((p_size * 90 - 360) % 360 + 360) % 360 % 180 <> 0 then 1080 else 1920 end as width, case when ((p_size * 90 - 360) % 360 + 360) % 360 % 180 <> 0 then 1920 else 1080 end as height from part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", S.display_size(F.lit(1920), F.lit(1080), F.col("p_size") * 90 - 360).alias("z")).select("p_partkey", "z.width", "z.height")


@query("weight_codec", "select p_partkey, b, round(case when b = 0 then 0 else power(10.0, b / 32.0) end, 4) + 0.0 as w from (select p_partkey, cast(case when p_retailprice - 1000 <= 1 then 0 else greatest(1, least(255, floor(32 * log10(p_retailprice - 1000) + 0.5))) end as int) as b from part)")
def _(spark, d):
    rows = read(spark, d, "part").select("p_partkey", S.encode_weight(F.col("p_retailprice") - 1000).alias("b"))
    return rows.select("p_partkey", "b", (F.round(S.decode_weight(F.col("b")), 4) + F.lit(0.0)).alias("w"))


@query("parabolic_peak", f"with {PX}, p as (select clip, t, y, x, lag(v) over w as a, v as b, lead(v) over w as c from px window w as (partition by clip, t, y order by x)) select clip, t, y, x, round(case when abs(a - 2 * b + c) < 1e-9 then 0 else greatest(-0.5, least(0.5, 0.5 * (a - c) / (a - 2 * b + c))) end, 5) + 0.0 as peak from p where a is not null and c is not null")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("clip", "t", "y").orderBy("x")
    rows = px(spark, d).withColumns({"a": F.lag("v").over(w), "c": F.lead("v").over(w)}).where("a is not null and c is not null")
    return rows.select("clip", "t", "y", "x", (F.round(S.parabolic_offset(F.col("a"), F.col("v"), F.col("c")), 5) + F.lit(0.0)).alias("peak"))


@query("method_resolution", "select p_partkey, case when m = 'INPAINT' and p_size % 2 = 0 then 3 when m = 'BLUR' then 1 when m = 'PIXELATE' then 2 else 0 end as method_id from (select *, ['INPAINT', 'BLUR', 'PIXELATE', 'CROP'][p_partkey % 4 + 1] as m from part)")
def _(spark, d):
    m = F.get(F.array(*map(F.lit, library.METHODS)), (F.col("p_partkey") % 4).cast("int"))
    return read(spark, d, "part").select("p_partkey", S.method_id(m, F.col("p_size") % 2 == 0).alias("method_id"))


# --- names, versions, library --------------------------------------------------------------------------------
_HOSTILE = "['../../', '', '..', 'a/b:', '.', ' ']"


@query("sanitize_name", f"with n as (select p_partkey, concat({_HOSTILE}[p_partkey % 6 + 1], p_name, '.', ['mp4', 'MOV', 'x y'][p_partkey % 3 + 1]) as s from part), a as (select p_partkey, trim(replace(regexp_replace(regexp_replace(s, '\\.[^.]*$', ''), '[\\\\/:*?\"<>|\\x00-\\x1F]', '', 'g'), '..', '')) as s from n), b as (select p_partkey, trim(left(ltrim(s, '.'), 96)) as s from a) select p_partkey, concat(case when s = '' then 'video' else s end, '_sans_filigrane.mp4') as name from b")
def _(spark, d):
    k = F.col("p_partkey")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (k % n).cast("int"))
    name = F.concat(pick(["../../", "", "..", "a/b:", ".", " "], 6), F.col("p_name"), F.lit("."), pick(["mp4", "MOV", "x y"], 3))
    return read(spark, d, "part").select("p_partkey", S.display_name(name).alias("name"))


@query("safe_version", "select p_partkey, case when v = '' then 'update' else v end as v from (select p_partkey, trim(left(trim(regexp_replace(regexp_replace(regexp_replace(s, '^v', ''), '[^0-9.]', '', 'g'), '\\.+', '.', 'g'), '.'), 32), '.') as v from (select p_partkey, concat(['v', '../', '', '..x'][p_partkey % 4 + 1], case when p_partkey % 7 = 0 then 'beta' else concat(p_size, '..', p_partkey, '-rc', p_size) end) as s from part))")
def _(spark, d):
    k = F.col("p_partkey")
    s = F.concat(F.get(F.array(*map(F.lit, ["v", "../", "", "..x"])), (k % 4).cast("int")), F.when(k % 7 == 0, "beta").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".."), k.cast("string"), F.lit("-rc"), F.col("p_size").cast("string"))))
    return read(spark, d, "part").select("p_partkey", S.safe_version(s).alias("v"))


@query("is_newer", "with v as (select p_partkey, [p_size % 4, p_partkey % 11, p_size % 3] as a, case when p_partkey % 2 = 0 then [p_partkey % 4, p_size % 11] else [p_partkey % 4, p_size % 11, 1] end as b from part), c as (select p_partkey, list_filter(list_transform([1, 2, 3], lambda i: sign(coalesce(a[i], 0) - coalesce(b[i], 0))), lambda s: s <> 0) as d from v) select p_partkey, coalesce(d[1] > 0, false) as newer from c")
def _(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda *xs: F.concat_ws(".", *(x.cast("string") for x in xs))
    a = F.concat(F.lit("v"), text(s % 4, k % 11, s % 3), F.lit("-debug"))
    b = F.when(k % 2 == 0, text(k % 4, s % 11)).otherwise(text(k % 4, s % 11, F.lit(1)))
    return read(spark, d, "part").select("p_partkey", S.is_newer(a, b).alias("newer"))


@query("duration_format", "select o_orderkey, concat(lpad(cast(cast(floor(o_totalprice) as bigint) // 60 as varchar), cast(greatest(2, length(cast(cast(floor(o_totalprice) as bigint) // 60 as varchar))) as int), '0'), ':', lpad(cast(cast(floor(o_totalprice) as bigint) % 60 as varchar), 2, '0')) as text from orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.duration_text(F.floor("o_totalprice") * 1000).alias("text"))


@query("trusted_url", "select page_id, starts_with(url, 'https://') and lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) = 'blog.therhe.example.org' as trusted from pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", S.trusted_url(F.col("url"), "blog.therhe.example.org").alias("trusted"))


@query("url_digest", "select page_id, sha256(url) as digest from pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("digest"))


def index_items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        k.cast("long").alias("id"), F.concat(F.lit("content://v/"), k).alias("uri"), F.concat(F.lit("clip"), k, F.lit(".mp4")).alias("name"), F.lit("src.mp4").alias("source"),
        (k * 7919 % 100003).cast("long").alias("createdAt"), F.floor("o_totalprice").cast("long").alias("durationMs"), F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        (k * 1000).cast("long").alias("size"), F.get(F.array(*map(F.lit, [*library.METHODS, "LASER"])), (k % 5).cast("int")).alias("method"), (k % 6).cast("int").alias("zones"), F.when(k % 2 == 0, F.concat(F.lit("t"), k)).alias("thumb"),
    )


_ITEMS = "it as (select o_orderkey as id, concat('content://v/', o_orderkey) as uri, concat('clip', o_orderkey, '.mp4') as name, o_orderkey * 7919 % 100003 as createdAt, cast(floor(o_totalprice) as bigint) as durationMs, o_orderkey * 1000 as size, ['INPAINT', 'BLUR', 'PIXELATE', 'CROP', 'INPAINT'][o_orderkey % 5 + 1] as method, cast(o_orderkey % 6 as int) as zones, case when o_orderkey % 2 = 0 then concat('t', o_orderkey) end as thumb from orders)"


@query("library_roundtrip", f"with {_ITEMS} select id, uri, name, createdAt, durationMs, size, method, zones, thumb from it where id % 9 <> 0")
def _(spark, d):
    rows = library.encode(index_items(spark, d))
    # Every ninth entry lacks its uri and must drop out.
    broken = rows.withColumn("json", F.when(F.col("id") % 9 == 0, '{"foo":"bar"}').otherwise(F.col("json")))
    text = broken.select(F.concat(F.lit('{"version":1,"items":['), "json", F.lit("]}")).alias("value"))
    return library.decode(text, "value").select("id", "uri", "name", "createdAt", "durationMs", "size", "method", "zones", "thumb")


@query("library_prune", f"with {_ITEMS} select id, uri from it where id % 3 = 0")
def _(spark, d):
    items = index_items(spark, d)
    return library.prune(items, items.where("id % 3 = 0").select("uri")).select("id", "uri")


@query("library_pruned", f"with {_ITEMS} select id, uri from it where id % 3 <> 0")
def _(spark, d):
    items = index_items(spark, d)
    return library.pruned(items, items.where("id % 3 = 0").select("uri")).select("id", "uri")


@query("library_upsert", f"with {_ITEMS} select id, case when id % 10 = 0 then 'new.mp4' else name end as name from it")
def _(spark, d):
    items = index_items(spark, d)
    new = items.where("id % 10 = 0").withColumn("name", F.lit("new.mp4"))
    return library.upsert(items, new).select("id", "name")


@query("library_rename", f"with {_ITEMS} select id, case when id % 4 = 0 and id % 8 <> 0 then concat('renamed', id, '.mp4') else name end as name from it")
def _(spark, d):
    typed = F.when(F.col("id") % 8 != 0, F.concat(F.lit("../renamed"), F.col("id"), F.lit(".mov"))).otherwise("  ")
    return library.rename(index_items(spark, d), F.col("id") % 4 == 0, typed).select("id", "name")


@query("library_recent", f"with {_ITEMS} select id, createdAt from it order by createdAt desc, id desc limit 8")
def _(spark, d):
    return library.recent(index_items(spark, d)).select("id", "createdAt")


@query("library_totals", f"with {_ITEMS} select method, count(*) as n, cast(sum(size) as bigint) as total from it group by method")
def _(spark, d):
    return library.with_defaults(index_items(spark, d)).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))


@query("library_caption", f"with {_ITEMS} select id, concat_ws(' • ', nullif(thumb, ''), case when zones > 0 then concat(zones, '×', zones * 2) end) as caption from it")
def _(spark, d):
    return index_items(spark, d).select("id", S.caption(F.col("zones"), F.col("zones") * 2, F.col("thumb")).alias("caption"))


# --- spatial rules and solvers --------------------------------------------------------------------------------
@query("zone_feather", f"with {PX}, u as (select *, (x + 0.5) / 8 as ux, (y + 0.5) / 8 as uy from px), e as (select *, greatest(0.25 - ux, ux - 0.625) as dx, greatest(0.25 - uy, uy - 0.5) as dy from u), s as (select *, sqrt(power(greatest(dx, 0), 2) + power(greatest(dy, 0), 2)) + least(greatest(dx, dy), 0) as dist from e), m as (select *, greatest(0, least(1, dist / 0.2)) as k from s) select clip, t, y, x, {q6('dist')}, round(v * (k * k * (3 - 2 * k)), 6) + 0.0 as v from m")
def _(spark, d):
    zone = S.rect(F.lit(0.25), F.lit(0.25), F.lit(0.625), F.lit(0.5))
    rows = px(spark, d).withColumn("dist", S.rect_distance((F.col("x") + 0.5) / 8, (F.col("y") + 0.5) / 8, zone))
    return rows.withColumn("v", F.col("v") * (1 - S.feather_mix(F.col("dist"), 0.2))).select("clip", "t", "y", "x", r6("dist"), r6("v"))


def fixture_pixels(spark: SparkSession, n: int = 16) -> DataFrame:
    """Two clips of the closed-form frames, one under a translucent and one under an opaque overlay."""
    ship(spark)
    clips = [frames.closed_form_frames(spark, n=n, alpha=a).select(F.lit(name).alias("video_id"), "t", "y", "x", "c", "b") for name, a in (("opaque", 1.0), ("translucent", 0.6))]
    return clips[0].unionByName(clips[1])


@query("layer_analyze")
def _(spark, d):
    clips = packed(fixture_pixels(spark)).select("video_id", F.col("pts_us").alias("t"), F.lit(96).alias("w"), F.lit(48).alias("h"), "rgb")
    return layers.estimate_layers(clips, ["video_id"]).select("video_id", "y", "x", F.round("alpha", 3).alias("alpha"), "fill", "dl", "dr", "du", "dd", "reason", "present", "components")


def packed(pixels: DataFrame) -> DataFrame:
    """video_id, pts_us, rgb: pixels as one binary frame each, row-major and interleaved."""
    at = (F.col("y") * 96 + F.col("x")) * 3 + F.col("c")
    ordered = F.array_sort(F.collect_list(F.struct(at.alias("p"), "b")))
    rgb = F.unhex(F.array_join(F.transform(ordered, lambda e: F.lpad(F.hex(e.b), 2, "0")), ""))
    return pixels.groupBy("video_id", (F.col("t").cast("long") * 33_333).alias("pts_us")).agg(rgb.alias("rgb"))


def known_layer(alpha: float = 0.6) -> layers.Layer:
    import numpy as np

    y, x = np.mgrid[0:48, 0:96]
    over = ((x >= 20) & (x <= 40) & (y >= 14) & (y <= 34)) | ((x >= 50) & (x <= 80) & (y >= 22) & (y <= 28))
    a = over * alpha
    return layers.Layer(np.repeat(a[..., None], 3, -1), a, over & (alpha > layers.INVERT), "ok", 0, [], 1.0)


@query("restore_frames")
def _(spark, d):
    clips = packed(fixture_pixels(spark))
    restored = [restore.restore_batch(clips.where(F.col("video_id") == name), known_layer(a)) for name, a in (("opaque", 1.0), ("translucent", 0.6))]
    return restored[0].unionByName(restored[1]).select("video_id", "pts_us", F.sha2("rgb", 256).alias("digest"))


_SINES = "s as (select i as p, j as k, sin(pi() * (i + 1) * (j + 1) / 9) as s from range(8) a(i), range(8) b(j))"


@query("poisson_relief", f"with {PX}, {_SINES}, h as (select clip, t, sy.k as ky, sx.k as kx, sum(v * sy.s * sx.s) as c from px join s sy on sy.p = y join s sx on sx.p = x group by all) select clip, t, cast(sy.p as int) as y, cast(sx.p as int) as x, round(sum(c * sy.s * sx.s / (2 * cos(pi() * (ky + 1) / 9) + 2 * cos(pi() * (kx + 1) / 9) - 4)) * 4 / 81, 6) + 0.0 as v from h join s sy on sy.k = ky join s sx on sx.k = kx group by all")
def _(spark, d):
    return layers.map_regions(px(spark, d), ["clip", "t"], solvers.poisson).select("clip", "t", "y", "x", r6("v"))


@query("harmonic_fill")
def _(spark, d):
    return layers.map_regions(px(spark, d), ["clip", "t"], _fill_positive).select("clip", "t", "y", "x", (F.round("v", 3) + F.lit(0.0)).alias("v"))


def _fill_positive(v):
    return solvers.harmonic_fill(v[..., None], v > 0.1)[..., 0]


def _holes(v):
    return solvers.fill_holes(v > 0)


def _band(v):
    return solvers.soft_band(v > 0.15, 2)


def _nearest(v):
    """Steps to the nearest clean pixel, 0 where there is none."""
    import numpy as np

    y, x = np.mgrid[0 : v.shape[0], 0 : v.shape[1]]
    there = solvers.nearest_clean(v > 0.1).reshape(v.shape)
    return np.abs(there // v.shape[1] - y) + np.abs(there % v.shape[1] - x)


def _mirror(v):
    return solvers.mirror_fill(v, (2, 3, 5, 7))


def _patches(v):
    import numpy as np

    hole = np.zeros(v.shape, bool)
    hole[3:5, 3:5] = True
    return solvers.patch_fill(v[..., None], hole)[..., 0]


@query("fill_holes", f"with recursive {PX}, mc as (select clip, t, y, x from px where v <= 0), rc(clip, t, y, x) as (select * from mc where y in (0, 7) or x in (0, 7) union select b.clip, b.t, b.y, b.x from rc join mc b on b.clip = rc.clip and b.t = rc.t and abs(b.y - rc.y) + abs(b.x - rc.x) = 1) select clip, t, y, x, cast(not exists (select 1 from rc where rc.clip = px.clip and rc.t = px.t and rc.y = px.y and rc.x = px.x) as double) as v from px")
def _(spark, d):
    return layers.map_regions(px(spark, d), ["clip", "t"], _holes)


@query("soft_band", f"with {PX}, hi as (select clip, t, y, x from px where v > 0.15) select clip, t, y, x, cast(not v > 0.15 and exists (select 1 from hi where hi.clip = px.clip and hi.t = px.t and abs(hi.y - px.y) + abs(hi.x - px.x) <= 2) as double) as v from px")
def _(spark, d):
    return layers.map_regions(px(spark, d), ["clip", "t"], _band)


@query("nearest_clean", f"with {PX} select a.clip, a.t, a.y, a.x, cast(coalesce(min(abs(a.y - b.y) + abs(a.x - b.x)), 0) as double) as v from px a left join px b on a.clip = b.clip and a.t = b.t and not b.v > 0.1 group by all")
def _(spark, d):
    return layers.map_regions(px(spark, d), ["clip", "t"], _nearest)


_MIRRORS = "m as (select *, unnest([{'sy': 3 - y, 'sx': x, 'd': y - 1}, {'sy': 9 - y, 'sx': x, 'd': 5 - y}, {'sy': y, 'sx': 5 - x, 'd': x - 2}, {'sy': y, 'sx': 13 - x, 'd': 7 - x}]) as s from px where y between 2 and 4 and x between 3 and 6)"


@query("mirror_inpaint", f"with {PX}, {_MIRRORS}, f as (select m.clip, m.t, m.y, m.x, sum(b.v / (m.s.d * m.s.d)) / sum(1.0 / (m.s.d * m.s.d)) as v from m join px b on b.clip = m.clip and b.t = m.t and b.y = m.s.sy and b.x = m.s.sx group by all) select px.clip, px.t, px.y, px.x, round(coalesce(f.v, px.v), 6) + 0.0 as v from px left join f using (clip, t, y, x)")
def _(spark, d):
    return layers.map_regions(px(spark, d), ["clip", "t"], _mirror).select("clip", "t", "y", "x", r6("v"))


@query("patch_synthesis")
def _(spark, d):
    return layers.map_regions(px(spark, d), ["clip", "t"], _patches).select("clip", "t", "y", "x", (F.round("v", 4) + F.lit(0.0)).alias("v"))


_TEMPLATE = CF.replace("then 0.6 else", "then 0.75 else") + """, v as materialized (select t, y, x, a, max(case when c = 0 then b end) / 255.0 as r, max(case when c = 1 then b end) / 255.0 as g, max(case when c = 2 then b end) / 255.0 as bl from cf group by t, y, x, a),
md as (select y, x, median(r) as r, median(g) as g, median(bl) as bl from v where a > 0 group by all),
sp as materialized (select md.*, greatest(median(abs(v.r - md.r)), median(abs(v.g - md.g)), median(abs(v.bl - md.bl))) * 1.4826 <= 0.06 as support from v join md using (y, x) group by all),
rg as materialized (select distinct p.y, p.x from v p join md on abs(p.y - md.y) <= 1 and abs(p.x - md.x) <= 1 where p.t = 0 and p.a = 0)"""


def fixture_template(spark: SparkSession, d: str, kernel, ddl: str) -> DataFrame:
    """kernel(frames in 0..1, overlay mask) -> rows, over the closed-form clip under an overlay of opacity 0.75."""
    import numpy as np
    import pandas as pd

    ship(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((pdf.t.max() + 1, 48, 96, 3))
        v[pdf.t, pdf.y, pdf.x, pdf.c] = pdf.b / 255.0
        mask = np.zeros((48, 96), bool)
        mask[pdf.y, pdf.x] = pdf.alpha > 0
        return pd.DataFrame(kernel(v, mask), columns=[c.split()[0] for c in ddl.split(", ")])

    return frames.closed_form_frames(spark, alpha=0.75).select("t", "y", "x", "c", "b", "alpha").groupBy().applyInPandas(run, ddl)


def _template_rows(v, mask):
    import numpy as np

    t = tracking.build_template(v, mask, mask)
    y, x = np.nonzero(mask | t.ring)
    level = np.where(t.support, t.values.mean(-1), 0)
    return [(int(a), int(b), float(level[a, b]), bool(t.support[a, b]), bool(t.ring[a, b])) for a, b in zip(y, x)]


def _template_places(v, mask):
    t = tracking.build_template(v, mask, mask)
    out = []
    for k, frame in enumerate(v):
        (dy, dx), score = tracking.template_offset(t, frame)
        out.append((k, int(dy), int(dx), float(score)))
    return out


@query("template_build", f"with {_TEMPLATE} select y, x, round(case when support then (r + g + bl) / 3 else 0 end, 6) + 0.0 as level, support, false as ring from sp union all select y, x, 0.0, false, true from rg")
def _(spark, d):
    return fixture_template(spark, d, _template_rows, "y int, x int, level double, support boolean, ring boolean").select("y", "x", r6("level"), "support", "ring")


@query("template_match", f"with {_TEMPLATE}, s as materialized (select * from sp where support), k as (select avg(r) as r, avg(g) as g, avg(bl) as bl, count(*) as n from s), o as (select i as dx, j as dy from range(-16, 17) a(i), range(-16, 17) b(j)), c as (select v.t, dx, dy, avg(least(0.25, (abs(v.r - s.r) + abs(v.g - s.g) + abs(v.bl - s.bl)) / 3)) as cost, count(*) as n from s, o, v where v.y = s.y + dy and v.x = s.x + dx group by all), q as (select v.t, dx, dy, avg(least(0.25, (abs(v.r - k.r) + abs(v.g - k.g) + abs(v.bl - k.bl)) / 3)) as cost, count(*) as n from rg, o, k, v where v.y = rg.y + dy and v.x = rg.x + dx group by all), e as (select t, dx, dy, round(case when c.n < (select n // 2 from k) then -1 when q.n >= 8 then 0.6 * greatest(-1, least(1, 1 - c.cost / 0.1)) + 0.4 * greatest(0, least(1, q.cost / 0.1)) else greatest(-1, least(1, 1 - c.cost / 0.1)) end, 9) as score from c left join q using (t, dx, dy)), b as (select t, max(score) as top, arg_max({{'x': dx, 'y': dy}}, (score, -abs(dx) - abs(dy), -dy, -dx)) as o, max(score) filter (dx = 0 and dy = 0) as zero from e group by t), f as (select *, top >= 0.45 and greatest(abs(o.x), abs(o.y)) < 16 and ((o.x = 0 and o.y = 0) or top > zero + 0.08) as found from b) select t, cast(case when found then o.y else 0 end as int) as dy, cast(case when found then o.x else 0 end as int) as dx, round(case when found then top else 0 end, 6) + 0.0 as score from f")
def _(spark, d):
    return fixture_template(spark, d, _template_places, "t int, dy int, dx int, score double").select("t", "dy", "dx", r6("score"))


@query("spatial_render")
def _(spark, d):
    """Every embedding frame as a grey picture, its zone reconstructed, blurred or in blocks by turns."""
    byte = lambda e: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e + 0.5) * 255))).cast("int")), 2, "0")
    pixels = F.unhex(F.array_join(F.flatten(F.transform("embedding", lambda e: F.array_repeat(byte(e), 3))), ""))
    rows = read(spark, d, "embeddings").select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("pts_us"), F.lit(8).alias("w"), F.lit(8).alias("h"), pixels.alias("rgb"))
    done = [spatial.render_frames(rows.where(F.col("pts_us") % 3 == m), [(0.25, 0.25, 0.625, 0.5)], m) for m in (0, 1, 2)]
    return done[0].unionByName(done[1]).unionByName(done[2]).select("video_id", "pts_us", F.hex("rgb").alias("rgb"))


# --- selections and guards -------------------------------------------------------------------------------------
@query("analysis_budget", "select p_partkey % 40 as g, cast(sum(p_size * 9 * (p_size * 5) * 3) * 16 as bigint) as bytes from part group by g having sum(p_size * 9 * (p_size * 5) * 3) * 16 <= 100663296 and max(p_size * 9 * (p_size * 5)) <= 800000")
def _(spark, d):
    rows = read(spark, d, "part").select((F.col("p_partkey") % 40).alias("g"), (F.col("p_size") * 9).alias("width"), (F.col("p_size") * 5).alias("height"))
    return selection.within_budget(rows, ["g"], F.lit(16))


@query("systematic_sample", f"with {PX}, r as (select *, row_number() over (partition by clip, t order by y, x) - 1 as k, count(*) over (partition by clip, t) as n from px where v <= 0.1) select clip, t, y, x from r where k % greatest(cast(ceil(n / 10.0) as bigint), 1) = 0")
def _(spark, d):
    return selection.systematic_sample(px(spark, d).where("v <= 0.1"), ["clip", "t"], ["y", "x"], 10).select("clip", "t", "y", "x")


@query("topk_taps", f"with {PX}, g as (select clip, t, y, x, round(abs(lead(v) over (partition by clip, t, y order by x) - v), 6) as mag from px) select clip, t, y, x, mag + 0.0 as mag from (select *, row_number() over (partition by clip, t order by mag desc, y, x) as r from g where mag is not null) where r <= 5")
def _(spark, d):
    taps = stencil.gradients(px(spark, d), ["clip", "t"], "x").withColumn("mag", F.round(F.abs("d"), 6))
    return selection.top_k(taps, ["clip", "t"], [F.desc("mag"), F.col("y"), F.col("x")], 5).select("clip", "t", "y", "x", "mag")


@query("zone_hit_test", f"with {_SAN}, c as (select *, least(greatest(abs(l - 0.5), abs(t - 0.4)), greatest(abs(r - 0.5), abs(t - 0.4)), greatest(abs(l - 0.5), abs(b - 0.4)), greatest(abs(r - 0.5), abs(b - 0.4))) as dist, 0.5 between l and r and 0.4 between t and b as inside from san), k as (select *, case when dist <= 0.05 and k % 3 = 0 then 0 when dist <= 0.05 then 1 when inside then 2 end as part from c) select k % 25 as g, arg_min(k, (part, -k)) as pos, min(part) as part from k where part is not null group by k % 25")
def _(spark, d):
    rows = sane_rects(spark, d).select((F.col("p_partkey") % 25).alias("g"), F.col("p_partkey").alias("pos"), "r.*")
    return selection.hit_test(rows, ["g"], 0.5, 0.4, 0.05, F.col("pos") % 3 == 0)


@query("release_feed", "select p_partkey, cast(p_partkey as varchar) || '.' || p_size as version, case when p_size % 5 = 0 then 'https://github.com/p' when p_size % 3 = 0 then 'https://github.com/b.APK' else 'https://github.com/a.apk' end as url, case when p_size % 5 = 0 then 0 else cast(p_size as bigint) end as size, case when p_size % 5 <> 0 and p_size % 2 = 0 then 'https://github.com/s' end as digest_url from part where p_partkey % 4 > 0 and (p_partkey > 20 or (p_partkey = 20 and p_size > 3))")
def _(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    asset = lambda name, url, size: F.struct(F.lit(name).alias("name"), F.lit(url).alias("browser_download_url"), size.cast("long").alias("size"))
    first, second, evil, text = asset("a.apk", "https://github.com/a.apk", s), asset("b.APK", "https://github.com/b.APK", s), asset("c.apk", "https://evil.org/c.apk", s), asset("a.txt", "https://github.com/a.txt", s)
    digest = F.when(s % 2 == 0, asset("a.apk.sha256", "https://github.com/s", s)).otherwise(asset("a.apk.sha256", "https://evil.org/s", s))
    assets = F.when(s % 5 == 0, F.array(evil, text, digest)).when(s % 3 == 0, F.array(first, second, evil, digest)).otherwise(F.array(first, text, digest))
    feed = F.to_json(F.struct(F.concat(F.lit("v"), k.cast("string"), F.lit("."), s.cast("string")).alias("tag_name"), F.lit("https://github.com/p").alias("html_url"), (k % 4 == 0).alias("draft"), F.lit(False).alias("prerelease"), assets.alias("assets")))
    return read(spark, d, "part").select("p_partkey", selection.latest_release(feed, "github.com", F.lit("20.3")).alias("r")).where("r is not null").select("p_partkey", "r.version", "r.url", "r.size", "r.digest_url")


@query("update_codec", "select p_partkey, concat(p_partkey, '.1') as version, 'https://github.com/a.apk' as apk, cast(p_size as bigint) as size, case when p_size % 2 = 0 then repeat('a', 64) end as sha, p_partkey > 50 or (p_partkey = 50 and 1 > 0) as valid from part where p_size % 7 <> 0")
def _(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    json = selection.encode_update(F.concat(k.cast("string"), F.lit(".1")), F.when(s % 7 != 0, F.lit("https://github.com/a.apk")), F.lit("https://github.com/p"), s, F.when(s % 2 == 0, F.repeat(F.lit("a"), 64)).otherwise("short"))
    rows = read(spark, d, "part").select("p_partkey", selection.decode_update(json).alias("u")).where("u is not null")
    return rows.select("p_partkey", "u.version", "u.apk", "u.size", "u.sha", selection.still_valid(F.col("u"), F.lit("50.0"), "github.com").alias("valid"))


@query("ttl_cache", "select event_id, case when event_id % 7 <> 0 and value * 100000 < 21600000 then 'cached' else 'fetched' end as source from events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", selection.cached_or_fetched(F.lit("cached"), F.lit("fetched"), F.col("value") * 100_000, F.col("event_id") % 7 == 0).alias("source"))


@query("two_block_detector", f"with recursive {LABELS}, {_STATS}, p as (select clip, t, list(struct_pack(l := label, s := size, x0 := x0, x1 := x1, y0 := y0, y1 := y1) order by label) as c from st group by all having count(*) = 2) select clip, t, c[1].s >= 3 and c[2].s >= 3 and greatest(c[1].x0 - c[2].x1, c[2].x0 - c[1].x1) between 2 and 30 and least(c[1].y1, c[2].y1) - greatest(c[1].y0, c[2].y0) > 5 and greatest(c[1].y1 - c[1].y0 + 1, c[2].y1 - c[2].y0 + 1) / least(c[1].y1 - c[1].y0 + 1, c[2].y1 - c[2].y0 + 1) < 1.6 as joined from p")
def _(spark, d):
    return selection.two_blocks(components.statistics(labelled(spark, d), ["clip", "t"]), ["clip", "t"], least=3)


@query("mask_union", f"with {PX}, m as (select clip, t, cast(v > 0.12 as int) as m1, cast(v < -0.2 as int) as m2 from px), s as (select clip, t, count(*) as n, sum(m1) as before, sum(greatest(m1, m2)) as after from m group by all) select clip, t, cast(before as bigint) as before, cast(after as bigint) as after, after > before and after < before * 1.8 and after < n * 0.5 and (t % 3 = 0 or after > before * 1.15) as adopted from s")
def _(spark, d):
    masks = px(spark, d).select("clip", "t", F.when(F.col("v") > 0.12, 1).otherwise(0).alias("m1"), F.when(F.col("v") < -0.2, 1).otherwise(0).alias("m2"))
    parts = masks.groupBy("clip", "t").agg(F.lit(3).alias("parts_before")).withColumn("parts_after", F.when(F.col("t") % 3 == 0, 2).otherwise(3))
    return selection.adopt_union(masks, ["clip", "t"], parts)


@query("chunk_selection", "with c as (select p_partkey % 60 as g, p_partkey as chunk, p_size * 10 as mask, (p_partkey % 8) / 8.0 as fraction from part), m as (select *, max(mask) over (partition by g) as most from c) select g, arg_max(chunk, (fraction, mask, -chunk)) as chunk from m where mask >= 0.6 * most group by g")
def _(spark, d):
    k = F.col("p_partkey")
    return selection.best_chunk(read(spark, d, "part").select((k % 60).alias("g"), k.alias("chunk"), (F.col("p_size") * 10).alias("mask"), ((k % 8) / 8.0).alias("fraction")), ["g"])


@query("purify_fills", f"with {PX} select clip, t, cast(sum(cast(v > 0 or y < 2 as int)) as bigint) as filled, cast(0 as double) as alpha from px group by clip, t")
def _(spark, d):
    layer = px(spark, d).select("clip", "t", F.greatest("v", F.lit(0.0)).alias("alpha"), (F.col("y") < 2).alias("fill"))
    return selection.purify(layer).groupBy("clip", "t").agg(F.count_if("fill").alias("filled"), F.max("alpha").alias("alpha"))


@query("blank_probe", f"with {PX}, r as (select clip, t, y, x, v, case when t % 2 = 0 then 0 else greatest(v, 0) end as o from px) select clip, t, bool_and(o = 0) and not bool_and(greatest(v, 0) = 0) as blank from r group by clip, t")
def _(spark, d):
    source = px(spark, d).withColumn("v", F.greatest("v", F.lit(0.0)))
    rendered = source.withColumn("v", F.when(F.col("t") % 2 == 0, 0.0).otherwise(F.col("v")))
    return selection.blank_render(rendered, source, ["clip", "t"], 8, 8)


@query("source_defaults", "select p_partkey, coalesce(case when p_size % 3 = 0 then p_name end, 'video.mp4') as name, coalesce(case when p_size % 2 = 0 then p_size end, 0) as size from part")
def _(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", S.name_and_size(F.when(s % 3 == 0, F.col("p_name")), F.when(s % 2 == 0, s)).alias("n")).select("p_partkey", "n.name", "n.size")


@query("integrity_gate", "select page_id, octet_length(encode(concat(case when page_id % 3 = 0 then 'PK' else 'XX' end, html))) >= 2000 and page_id % 3 = 0 and (page_id % 2 = 1 or page_id % 5 <> 0) as ok from pages")
def _(spark, d):
    k = F.col("page_id")
    content = F.concat(F.when(k % 3 == 0, "PK").otherwise("XX"), F.col("html")).cast("binary")
    digest = F.when(k % 2 == 0, F.when(k % 5 == 0, F.lit("0")).otherwise(F.sha2(content, 256)))
    return read(spark, d, "pages").select("page_id", S.archive_ok(content, digest, 2000).alias("ok"))


# --- labels, sizes and edits --------------------------------------------------------------------------------------
@query("container_info", "select p_partkey, p_size * 10 as width, p_size * 4 as height, (p_size * 90) % 360 as rotation, case when p_size % 4 = 0 then 0 else p_size * 100 end as duration_ms, case when p_size % 3 = 0 then p_size * 7 when p_size % 4 = 0 then 0 else least(p_partkey * 8000 // (p_size * 100), 2147483647) end as bitrate from part where p_size % 5 <> 0")
def _(spark, d):
    s, text = F.col("p_size"), lambda c: c.cast("string")
    info = S.container_info(F.when(s % 5 != 0, text(s * 10)).otherwise("n/a"), text(s * 4), text(s * 90 - 720), F.when(s % 4 != 0, text(s * 100)), F.col("p_partkey"), F.when(s % 3 == 0, text(s * 7)), F.lit(None).cast("string"))
    return read(spark, d, "part").select("p_partkey", info.alias("i")).where("i is not null").select("p_partkey", "i.width", "i.height", "i.rotation", F.col("i.duration_ms").cast("long").alias("duration_ms"), "i.bitrate")


@query("display_copy", "with z as (select p_partkey, p_size * 80 as w, p_size * 45 as h from part) select p_partkey, case when greatest(w, h) <= 1280 then w else greatest(1, w * 1280 // greatest(w, h)) end as width, case when greatest(w, h) <= 1280 then h else greatest(1, h * 1280 // greatest(w, h)) end as height from z")
def _(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", S.bounded_size(s * 80, s * 45, 1280).alias("z")).select("p_partkey", "z.width", "z.height")


@query("thumbnail", "with z as (select p_partkey, p_size * 80 as w, p_size * 45 as h from part) select p_partkey, p_partkey * 1000 // 4 as time_us, case when w <= 512 then w else w * 512 // w end as width, case when w <= 512 then h else h * 512 // w end as height from z")
def _(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", S.thumbnail(s * 80, s * 45, F.col("p_partkey")).alias("z")).select("p_partkey", "z.time_us", "z.size.width", "z.size.height")


@query("size_text", "with z as (select o_orderkey, cast(power(10, o_orderkey % 13) as double) * (1 + o_orderkey % 9) as n from orders), u as (select *, case when n > 9e14 then 'PB' when n > 9e11 then 'TB' when n > 9e8 then 'GB' when n > 9e5 then 'MB' when n > 900 then 'kB' else 'B' end as unit, case when n > 9e14 then n / 1e15 when n > 9e11 then n / 1e12 when n > 9e8 then n / 1e9 when n > 9e5 then n / 1e6 when n > 900 then n / 1e3 else n end as v from z) select o_orderkey, concat(case when unit = 'B' or v >= 10 then printf('%.0f', v) when v < 1 then printf('%.2f', v) else printf('%.1f', v) end, ' ', unit) as text from u")
def _(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", S.size_text(F.pow(F.lit(10.0), k % 13) * (1 + k % 9)).alias("text"))


@query("relative_date", "with z as (select o_orderkey, (o_orderkey % 17 - 2) * 86400000 * (o_orderkey % 5) + o_orderkey % 5000 * 60000 as ms from orders), m as (select *, (2000000000 - ms) // 60000 as mins from z) select o_orderkey, case when ms <= 0 then '' when mins < 60 then concat(greatest(mins, 0), ' minute', case when greatest(mins, 0) = 1 then '' else 's' end, ' ago') when mins < 1440 then concat(mins // 60, ' hour', case when mins // 60 = 1 then '' else 's' end, ' ago') when mins < 10080 then concat(mins // 1440, ' day', case when mins // 1440 = 1 then '' else 's' end, ' ago') else strftime(date '1970-01-01' + cast(ms // 86400000 as int), '%Y-%m-%d') end as text from m")
def _(spark, d):
    k = F.col("o_orderkey")
    ms = (k % 17 - 2) * 86_400_000 * (k % 5) + k % 5000 * 60_000
    return read(spark, d, "orders").select("o_orderkey", S.relative_date(ms, F.lit(2_000_000_000)).alias("text"))


@query("method_labels", "select p_partkey, ['Reconstruction', 'Blur', 'Pixelate', 'Crop'][p_partkey % 4 + 1] as label, p_partkey % 4 < 3 as shader, printf('%.0f Mb/s', (p_size * 2 + 1) * 1.0) as bitrate from part")
def _(spark, d):
    m = F.get(F.array(*map(F.lit, library.METHODS)), (F.col("p_partkey") % 4).cast("int"))
    return read(spark, d, "part").select("p_partkey", S.method_label(m).alias("label"), S.uses_shader(m).alias("shader"), S.bitrate_label((F.col("p_size") * 2 + 1) * 1_000_000).alias("bitrate"))


@query("texture_scale", "select p_partkey, cast(p_size * 2 as double) as x, cast(case when p_size % 2 = 0 then -p_size else p_size end as double) as y, cast(least(p_size * 9, 255) as int) as clamped from part")
def _(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", S.texture_scale(s * 2, s, s % 2 == 0).alias("z"), S.byte_clamp(s * 9).alias("clamped")).select("p_partkey", "z.x", "z.y", "clamped")


@query("library_exported", f"with {_ITEMS} select id, concat('src', id, '_sans_filigrane.mp4') as name, case when id % 2 = 0 then id else id * 3 end as durationMs from it")
def _(spark, d):
    k = F.col("id")
    rows = index_items(spark, d).withColumns({"source": F.concat(F.lit("src"), k, F.lit(".mov")), "duration_ms": F.when(k % 2 == 0, k).otherwise(0), "source_duration_ms": k * 3})
    return library.exported(rows).select("id", "name", "durationMs")


@query("nearest_candidates", "select p_partkey, list_transform(list_sort([{'d': p_size % 4, 'i': 0}, {'d': p_partkey % 4, 'i': 1}, {'d': 2, 'i': 2}, {'d': (p_size + 1) % 4, 'i': 3}]), lambda x: x.i)[1] as first, list_transform(list_sort([{'d': p_size % 4, 'i': 0}, {'d': p_partkey % 4, 'i': 1}, {'d': 2, 'i': 2}, {'d': (p_size + 1) % 4, 'i': 3}]), lambda x: x.i)[4] as last from part")
def _(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    far = [s % 4, k % 4, F.lit(2), (s + 1) % 4]
    found = selection.nearest_first(F.array(*(F.struct(x.cast("int").alias("distance"), F.lit(i).alias("i")) for i, x in enumerate(far))))
    return read(spark, d, "part").select("p_partkey", found.alias("f")).select("p_partkey", F.col("f")[0].i.alias("first"), F.col("f")[3].i.alias("last"))


@query("zone_offsets", f"with {_REG}, f as (select zone_id, arg_min(pos * 2, pos) as r from rg group by zone_id), u as (select zone_id, max(pos) as pos from rg where mask_pixels > 0 group by zone_id) select zone_id, coalesce(r, 0) as atlas_row, pos from zn left join f using (zone_id) left join u using (zone_id)")
def _(spark, d):
    zone_rows, regions = region_rows(spark, d)
    regions = regions.withColumn("atlas_row", F.col("pos") * 2)
    return zones.offsets(zone_rows, regions).join(zones.restorable(regions), "zone_id", "left")


@query("preview_routes", f"with {_REG}, u as (select distinct zone_id from rg where mask_pixels > 0) select zn.zone_id, case when zn.zone_id % 4 = 3 then 'source' when u.zone_id is not null and zn.zone_id % 4 = 0 and zn.zone_id % 5 <> 0 then 'restored' else 'shader' end as route from zn left join u on u.zone_id = zn.zone_id")
def _(spark, d):
    zone_rows, regions = region_rows(spark, d)
    k = F.col("zone_id")
    m = F.get(F.array(*map(F.lit, library.METHODS)), (k % 4).cast("int"))
    return zones.preview_routes(zone_rows, regions, m, k % 5 != 0)


def zone_lists(spark: SparkSession, d: str) -> DataFrame:
    """Zone lists of ten zones or so: g, zone_id, pos, r."""
    k = F.col("p_partkey")
    return sane_rects(spark, d).select(F.floor(k / 10).alias("g"), k.alias("zone_id"), (k % 10).alias("pos"), "r")


@query("effect_selection", f"with {_SAN}, z as (select *, k // 10 as g from san), f as (select g, count(*) as n, arg_min({{'l': l, 't': t, 'r': r, 'b': b}}, k) as z from z group by g), c as (select *, list_position([z.t, 1 - z.b, z.l, 1 - z.r], greatest(z.t, 1 - z.b, z.l, 1 - z.r)) as w from f) select g, case when g % 3 = 0 then 'crop' else 'removal' end as effect, least(n, 6) as zones, round(case when g % 3 = 0 then case when w = 4 then z.r else 0 end * 2 - 1 end, 6) + 0.0 as \"left\" from c")
def _(spark, d):
    got = zones.effects(zone_lists(spark, d), ["g"], F.when(F.col("g") % 3 == 0, "CROP").otherwise("BLUR"))
    return got.select("g", "effect", "zones", (F.round("rect.left", 6) + F.lit(0.0)).alias("left"))


@query("zone_edits", "with z as (select p_partkey // 10 as g, p_partkey as zone_id, p_partkey % 10 as pos from part), a as (select g, zone_id, pos from z union all select g, max(zone_id) + 1, max(pos) + 1 from z group by g), r as (select * from a where not (pos = 3)) select g, zone_id, pos, pos = max(pos) over (partition by g) as selected from r")
def _(spark, d):
    more = zones.add_zone(zone_lists(spark, d), ["g"])
    return zones.remove_zone(more, ["g"], F.col("pos") == 3).select("g", "zone_id", "pos", "selected")


@query("current_results", "select p_partkey, p_size % 3 as version from part where p_size % 3 = p_partkey % 3")
def _(spark, d):
    part = read(spark, d, "part")
    return zones.current_results(part.select("p_partkey", (F.col("p_size") % 3).cast("long").alias("version")), part.select("p_partkey", (F.col("p_partkey") % 3).alias("version")), ["p_partkey"])


@query("exact_second_pass", "with s as (select user_id, event_id, event_id % 7 as digest from events where event_id % 2 = 0), n as (select user_id, count(distinct digest) as n from s group by user_id), e as (select user_id, event_id, event_id % 11 as digest, 1 as pass from events where event_id % 2 = 1), u as (select user_id, event_id, digest, 0 as pass from s union all select e.* from e left join n using (user_id) where coalesce(n, 0) < 8) select user_id, arg_min(event_id, (pass, event_id)) as t, digest from u group by user_id, digest")
def _(spark, d):
    k = F.col("event_id")
    rows = read(spark, d, "events").select("user_id", k.alias("t"), k)
    sync = rows.where("event_id % 2 = 0").select("user_id", "t", (k % 7).alias("digest"))
    return frames.enough_samples(sync, rows.where("event_id % 2 = 1").select("user_id", "t", (k % 11).alias("digest")), ["user_id"])


