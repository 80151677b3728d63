"""Layer estimation and restoration on closed-form scenes."""

import numpy as np
import pandas as pd

from strataflow.operators import layers, solvers
from strataflow.operators.components import label_mask, recruit
from strataflow.streaming import restore

H, W = 48, 96


def background(t, sx=3, sy=2):
    y, x = np.mgrid[0:H, 0:W]
    gx, gy = x + sx * t, y + sy * t
    rgb = [0.35 + 0.25 * np.sin(0.31 * gx) + 0.15 * np.sin(0.17 * gy), 0.40 + 0.20 * np.sin(0.23 * gx + 1) + 0.10 * np.sin(0.11 * (gx + gy)), 0.45 + 0.20 * np.sin(0.27 * gy + 2) + 0.10 * np.sin(0.13 * gx)]
    return np.clip(np.stack(rgb, -1), 0, 1)


def overlay():
    y, x = np.mgrid[0:H, 0:W]
    return ((x >= 20) & (x <= 40) & (y >= 14) & (y <= 34)) | ((x >= 50) & (x <= 80) & (y >= 22) & (y <= 28))


def clip(n, alpha, noise=0.004, seed=1, there=lambda t: True, moving=True):
    r = np.random.default_rng(seed)
    out = []
    for t in range(n):
        a = (overlay() * alpha * there(t))[..., None]
        out.append(np.floor(np.clip(a + (1 - a) * background(t if moving else 0) + r.normal(0, 1, (H, W, 3)) * noise, 0, 1) * 255 + 0.5).astype(np.uint8))
    return np.stack(out)


def test_translucent_overlay_is_found_and_taken_out():
    frames, over = clip(16, 0.6), overlay()
    layer = layers.estimate(frames)
    assert layer.reason == "ok" and (layer.mask & over).sum() / over.sum() >= 0.9
    assert (layer.mask & ~over).sum() < 0.25 * over.sum()
    assert (layer.alpha > 0).sum() > layer.fill.sum() and abs(layer.alpha[27, 30] - 0.6) < 0.12
    error = np.abs(layers.scene(frames[5:6] / 255.0, layer)[0] - background(5))[over]
    assert error.mean() < 0.04


def test_opaque_overlay_becomes_fill_with_distances():
    layer = layers.estimate(clip(12, 1.0))
    d = layers.fill_distances(layer.fill)
    assert layer.fill.sum() > (layer.alpha > 0).sum() and layer.fill[24, 30] and 8 <= d[0, 24, 30] <= 13 and 8 <= d[1, 24, 30] <= 13


def test_presence_follows_the_frames_that_carry_the_overlay():
    assert layers.present_frames(clip(20, 0.6, there=lambda t: t % 2 == 0) / 255.0) == list(range(0, 20, 2))


def test_still_scene_gives_a_static_fill_and_few_frames_none():
    layer = layers.estimate(clip(12, 0.6, noise=0, moving=False))
    assert layer.reason == "static-fill" and layer.template is not None and layer.fill.sum() >= 300
    assert layers.estimate(clip(3, 0.6)) is None


def test_restoration_gets_better_with_history():
    for alpha, first, late in ((0.6, 0.05, 0.02), (1.0, 0.16, 0.03)):
        layer, over = layers.estimate(clip(16, alpha)), overlay()
        restorer, frames = restore.Restorer(layer), clip(24, alpha, seed=2)
        errors = [np.abs(restorer.process(t, frames[t]) / 255.0 - background(t))[over].mean() for t in range(24)]
        assert errors[0] < first and np.mean(errors[-8:]) < min(late, errors[0])


def test_state_survives_dump_and_time_going_back_clears_it():
    layer, frames = layers.estimate(clip(16, 0.6)), clip(8, 0.6, seed=3)
    a, b = restore.Restorer(layer), restore.Restorer(layer)
    for t in range(5):
        a.process(t, frames[t])
    b.load(a.dump())
    assert np.abs(a.process(5, frames[5]).astype(int) - b.process(5, frames[5])).max() <= 1
    assert len(a.ring) > 1
    a.process(0, frames[0])
    assert len(a.ring) == 1 and restore.depth_for(40_001) == 10


def test_stream_equals_batch(spark, tmp_path):
    layer, frames = layers.estimate(clip(16, 0.6)), clip(6, 0.6, seed=4)
    rows = pd.DataFrame([("v", t * 1000, frames[t].tobytes()) for t in range(6)], columns=["video_id", "pts_us", "rgb"])
    schema = "video_id string, pts_us long, rgb binary"
    for k in range(2):
        spark.createDataFrame(rows[k * 3 : k * 3 + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    restore.restore_stream(stream, layer).writeStream.format("memory").queryName("restored").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.pts_us: bytes(r.rgb) for r in spark.table("restored").collect()}
    want = {r.pts_us: bytes(r.rgb) for r in restore.restore_batch(spark.createDataFrame(rows, schema), layer).collect()}
    assert got.keys() == want.keys()
    assert max(np.abs(np.frombuffer(got[k], np.uint8).astype(int) - np.frombuffer(want[k], np.uint8)).max() for k in got) <= 1


def test_solvers_against_dense_systems():
    r = np.random.default_rng(0)
    f = r.normal(size=(5, 7))
    u = solvers.poisson(f)
    p = np.pad(u, 1)
    assert np.allclose(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * u, f)
    ramp = np.add.outer(np.arange(9.0), 2 * np.arange(12.0))[..., None]
    mask = np.zeros((9, 12), bool)
    mask[3:6, 4:9] = True
    assert np.abs(solvers.harmonic_fill(np.where(mask[..., None], 0, ramp), mask) - ramp).max() < 0.01
    g = solvers.masked_poisson(np.ones((9, 12)), mask)
    q = np.pad(g, 1)
    assert np.abs((q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] - 4 * g - 1)[mask]).max() < 1e-3 and not g[~mask].any()


def test_floods_labels_and_patches():
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert solvers.fill_holes(ring)[3, 3] and not solvers.fill_holes(ring)[0, 0]
    assert label_mask(np.array([[1, 0, 1], [0, 0, 0], [1, 1, 0]], bool)).max() == 3
    assert solvers.nearest_clean(np.array([[False, True, True]])).tolist() == [0, 0, 0]
    assert solvers.soft_band(ring, 1).sum() == 21
    assert recruit([(10, 0, 12, 2, 5.0), (90, 0, 92, 2, 5.0)], (0, 0, 4, 4), 20.0) == (0, 0, 12, 4)
    stripes = np.tile((np.arange(16) // 2 % 2)[None, :, None], (16, 1, 1)).astype(float)
    hole = np.zeros((16, 16), bool)
    hole[6:9, 6:9] = True
    assert np.abs(solvers.patch_fill(np.where(hole[..., None], 0.5, stripes), hole, shift=1.0) - stripes).mean() < 0.05


def test_patch_donors_come_from_the_whole_image():
    image = np.random.default_rng(1).random((15, 13, 1))
    image[7:] = image[:8]
    hole = np.zeros((15, 13), bool)
    hole[3:5, 6:8] = True  # 191 clean pixels; what belongs in the hole stands 7 rows below
    assert np.allclose(solvers.patch_fill(np.where(hole[..., None], 0.5, image), hole, shift=1.0, drawn=0), image)
    few = solvers.patch_fill(np.where(hole[..., None], 0.5, image), hole, grid=1, shift=1.0)
    assert np.isin(few[hole], image[~hole]).all()


def test_slow_scenes_stay_in_the_ring():
    from strataflow.plans import catalog

    noise = np.random.default_rng(5).random((50, 142))
    wide = sum(noise[i : i + 48, j : j + 140] for i in range(3) for j in range(3)) / 9
    wide = np.repeat((wide * 255).astype(np.uint8)[..., None], 3, -1)
    restorer = restore.Restorer(catalog.known_layer(1.0))
    for t in range(40):  # half a pixel a frame
        restorer.process(t, wide[:, t // 2 : t // 2 + 96])
    places = [float(r[3][1]) for r in restorer.ring]
    assert len(places) < restorer.depth and max(places) - min(places) > 14 and min(np.abs(np.diff(places))) >= 2
    again = restore.Restorer(catalog.known_layer(1.0))
    again.load(restorer.dump())
    last = wide[:, 20:116]
    assert again.number == restorer.number and np.abs(again.process(40, last).astype(int) - restorer.process(40, last)).max() <= 1


def test_restore_query_covers_both_clips(spark):
    from strataflow.plans import catalog

    got = catalog.QUERIES["restore_frames"](spark, "").groupBy("video_id").count().collect()
    assert {tuple(r) for r in got} == {("opaque", 16), ("translucent", 16)}


def test_render_against_a_pixel_at_a_time():
    """The zone kernels over arrays against the same rules for one pixel."""
    import math

    from strataflow.operators import spatial

    rng = np.random.default_rng(8)
    image = rng.random((20, 26, 3))
    zone = (0.3, 0.25, 0.7, 0.65)

    def read(u, v):
        x, y = min(max(u, 0.001), 0.999) * 26 - 0.5, min(max(v, 0.001), 0.999) * 20 - 0.5
        out = np.zeros(3)
        for j, ky in ((0, 1 - (y - math.floor(y))), (1, y - math.floor(y))):
            for i, kx in ((0, 1 - (x - math.floor(x))), (1, x - math.floor(x))):
                out += ky * kx * image[min(max(math.floor(y) + j, 0), 19), min(max(math.floor(x) + i, 0), 25)]
        return out

    def blurred(u, v):
        grow, total, weight = 0.02 + 0.10 * 0.5, np.zeros(3), 0
        for i in range(-4, 5):
            for j in range(-4, 5):
                k = math.exp(-(i * i + j * j) / 10)
                total += k * read(u + i * max(0.4 * grow, 1.5 / 26), v + j * max(0.4 * grow, 1.5 / 20))
                weight += k
        return total / weight

    def blocks(u, v):
        n = 24 - 20 * 0.5
        bw, bh = max(0.4 / n, 2 / 26), max(0.4 / n, 2 / 20)
        return read((math.floor((u - 0.3) / bw) + 0.5) * bw + 0.3, (math.floor((v - 0.25) / bh) + 0.5) * bh + 0.25)

    for method, one in ((spatial.BLUR, blurred), (spatial.PIXELATE, blocks)):
        got = spatial.render(image, [zone], method, 0.5, 0.5)
        border = 0.5 * 0.03 * 20 / 26
        for y in range(20):
            for x in range(26):
                u, v = (x + 0.5) / 26, (y + 0.5) / 20
                dx, dy = abs(u - 0.5) - 0.2, abs(v - 0.45) - 0.2
                d = math.hypot(max(dx, 0), max(dy, 0)) + min(max(dx, dy), 0)
                t = min(max(d / border, 0), 1)
                mix = 1 - t * t * (3 - 2 * t)
                want = image[y, x] if d > border else image[y, x] * (1 - mix) + one(u, v) * mix
                assert np.allclose(got[y, x], want)


def test_reconstruction_continues_gradients_and_texture():
    from strataflow.operators import spatial

    y, x = np.mgrid[0:40, 0:60]
    ramp = np.repeat(((x + y) / 110)[..., None], 3, -1)
    hidden = ramp.copy()
    hidden[14:26, 20:40] = 1.0
    zone = (20 / 60, 14 / 40, 40 / 60, 26 / 40)
    assert np.abs(spatial.render(hidden, [zone]) - ramp)[14:26, 20:40].max() < 0.12
    region = spatial.Region(18, 12, ramp[12:28, 18:42], np.ones((16, 24), bool))
    assert np.abs(spatial.render(hidden, [zone], spatial.RESTORED, regions=[region]) - ramp).max() < 1e-12
    assert (spatial.render(hidden, []) == hidden).all() and np.isfinite(spatial.render(hidden, [(0.0, 0.0, 1.0, 1.0)])).all()
    assert spatial.resize((hidden * 255).astype(np.uint8), 60, 40).shape == (40, 60, 3) and spatial.resize((ramp * 255).astype(np.uint8), 30, 20).shape == (20, 30, 3)


def test_frames_in_and_out(spark):
    from strataflow.operators import spatial

    frames = clip(2, 0.6)
    rows = pd.DataFrame([("v", t, W, H, frames[t].tobytes()) for t in range(2)], columns=["video_id", "pts_us", "w", "h", "rgb"])
    df = spark.createDataFrame(rows, "video_id string, pts_us long, w int, h int, rgb binary")
    small = spatial.fit_frames(df, 48, 24).collect()
    assert all(len(r.rgb) == 48 * 24 * 3 and (r.w, r.h) == (48, 24) for r in small)
    region = {r.pts_us: bytes(r.rgb) for r in spatial.read_back(df, 5, 3, 10, 7, flip=True).collect()}
    assert region[1] == frames[1][::-1][3:10, 5:15].tobytes()
    assert all(r.rgb != frames[r.pts_us].tobytes() for r in spatial.render_frames(df, [(0.2, 0.2, 0.8, 0.8)], 2).collect())


def test_a_frame_costs_few_milliseconds():
    """350 x 100 pixels under an opaque text-like overlay, the dearest case."""
    import time

    rng = np.random.default_rng(0)
    wide = rng.random((100, 500, 3))
    for _ in range(3):
        wide = (wide + np.roll(wide, 1, 0) + np.roll(wide, 1, 1)) / 3
    y, x = np.mgrid[0:100, 0:350]
    a = np.where((y > 30) & (y < 70) & (x > 60) & (x < 290), np.where((x // 6 + y // 9) % 2 == 0, 1.0, 0.5), 0.0)
    layer = layers.Layer(np.repeat(np.where(a < 1, a, 0)[..., None], 3, -1), np.where(a < 1, a, 0), a == 1, "ok", 16, list(range(16)), 1.0)
    restorer = restore.Restorer(layer)
    frames = [np.floor((a[..., None] + (1 - a[..., None]) * wide[:, 3 * t : 3 * t + 350]) * 255).astype(np.uint8) for t in range(24)]
    began = time.process_time()
    for t, frame in enumerate(frames):
        restorer.process(t, frame)
    print("ms a frame:", round((time.process_time() - began) / 24 * 1000, 1))
    assert (time.process_time() - began) / 24 < 0.5 and restorer.motion is not None


def test_a_stopped_query_keeps_what_it_published(spark, tmp_path):
    from strataflow.streaming.jobs import stop_and_keep

    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for name, source, want in (("kept_rows", stream, 5), ("kept_none", stream.where("id > 100"), None)):
        query = source.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        kept = stop_and_keep(spark, query, name)
        assert (kept.count() if kept is not None else None) == want and not query.isActive
