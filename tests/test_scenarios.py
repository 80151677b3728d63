"""Layer estimation and restoration on closed-form scenes, with the acceptance limits of FIXTURES 3 (S1 to S16)."""

import functools

import numpy as np
import pytest

from strataflow.operators import layers
from strataflow.streaming.restore import Restorer

H, W = 48, 96
Y, X = np.mgrid[0:H, 0:W]
# Strokes of the text overlay (x0, y0, x1, y1), and opacities by distance to the shape.
STROKES = [(20, 14, 22, 30), (28, 14, 30, 30), (20, 21, 30, 23), (38, 14, 40, 30), (48, 14, 50, 30), (48, 27, 58, 29)]
BLOCKS = [(20, 14, 40, 34), (50, 22, 80, 28)]
CUTS = (20, 40)


def distance(shape, dx=0, dy=0):
    """Chebyshev distance to the shape moved by (dx, dy)."""
    x, y = X - dx, Y - dy
    return np.min([np.maximum(np.maximum(np.maximum(a - x, x - c), np.maximum(b - y, y - d)), 0) for a, b, c, d in shape], axis=0)


def background(t, speed=(3, 2), scene=0, x=X, y=Y):
    gx, gy, p = x + speed[0] * t, y + speed[1] * t, 2.3 * scene
    red = 0.35 + 0.25 * np.sin(0.31 * gx + p) + 0.15 * np.sin(0.17 * gy + p)
    green = 0.40 + 0.20 * np.sin(0.23 * gx + 1 + p) + 0.10 * np.sin(0.11 * (gx + gy))
    blue = 0.45 + 0.20 * np.sin(0.27 * gy + 2 + p) + 0.10 * np.sin(0.13 * gx)
    return np.clip(np.stack([red, green, blue], -1), 0, 1)


def opacity(shape, steps, dx=0, dy=0):
    d = distance(shape, dx, dy)
    return np.select([d == k for k in range(len(steps))], steps, 0.0)


@functools.lru_cache(None)
def clip(n, shape, steps, noise=0.004, speed=(3, 2), clips=False, seed=7):
    """(frames, backgrounds); with clips, time starts anew at the cuts, the scene alternates and the overlay moves by (6, 3)."""
    r = np.random.default_rng(seed)
    frames, truth = [], []
    for t in range(n):
        k = sum(t >= c for c in CUTS) if clips else 0
        bg = background(t - (0, *CUTS)[k], speed, k % 2)
        a = opacity(BLOCKS if shape == "blocks" else STROKES, steps, 6 * k, 3 * k)[..., None]
        frames.append(np.floor(np.clip(a + (1 - a) * bg + r.uniform(-1, 1, bg.shape) * noise, 0, 1) * 255 + 0.5).astype(np.uint8))
        truth.append(bg)
    return np.stack(frames), np.stack(truth)


def run(layer, frames, truth, area):
    """Mean error of each restored frame over the area, pixels gone black after the tenth frame, offsets, and the restorer."""
    restorer, errors, black, offsets = Restorer(layer), [], 0, []
    for t, frame in enumerate(frames):
        out = restorer.process(t, frame) / 255.0
        errors.append(np.abs(out - truth[t])[area].mean())
        black += int(((out < 0.02) & (truth[t] > 0.15))[area].sum()) if t >= 10 else 0
        offsets.append(tuple(restorer.offset))
    return np.array(errors), black, offsets, restorer


def sampled(frames):
    """Every fifth frame from the second one on."""
    return frames[1::5]


LOGO = distance(BLOCKS) == 0


def test_s1_translucent_overlay():
    frames, truth = clip(16, "blocks", (0.6,))
    layer = layers.estimate(frames)
    assert layer.reason == "ok" and (layer.mask & LOGO).sum() >= 0.9 * LOGO.sum()
    assert (layer.mask & ~LOGO).sum() < 0.25 * LOGO.sum()
    assert (layer.alpha > 0).sum() > layer.fill.sum() and abs(layer.alpha[27, 30] - 0.6) < 0.12
    restored = (frames[5, 27, 30] / 255 - layer.colour[27, 30]) / (1 - layer.alpha[27, 30])
    assert np.abs(restored - truth[5, 27, 30]).max() < 0.065


def test_s2_soft_edges():
    steps = (0.55, 0.28, 0.12, 0.04)
    frames, truth = clip(40, "blocks", steps)
    layer = layers.estimate(frames[:16])
    ramp = (distance(BLOCKS) >= 1) & (distance(BLOCKS) <= 3)
    assert layer.reason == "ok" and layer.mask[ramp].sum() >= 0.8 * ramp.sum()
    undone = np.where((layer.alpha > 0)[..., None], (frames[:16] / 255 - layer.colour) / (1 - layer.alpha)[..., None], frames[:16] / 255)
    assert np.abs(undone - truth[:16])[:, ramp].mean() < 0.022
    errors, *_ = run(layer, frames, truth, distance(BLOCKS) <= 3)
    assert errors[0] < 0.045 and errors[-10:].mean() < min(errors[0], 0.03)


def test_s3_hard_edges_leave_no_ring():
    frames, truth = clip(16, "blocks", (0.6,))
    layer, ring = layers.estimate(frames), distance(BLOCKS) == 1
    assert (layer.alpha[ring] > 0.02).sum() < 0.35 * ring.sum()
    assert np.abs(frames / 255 - truth)[:, ring].mean() < 0.008


def test_s4_opaque_overlay():
    layer = layers.estimate(clip(12, "blocks", (1.0,))[0])
    d = layers.fill_distances(layer.fill)
    assert layer.fill.sum() > (layer.alpha > 0).sum() and layer.fill[27, 30] and 8 <= d[0, 27, 30] <= 13 and 8 <= d[1, 27, 30] <= 13


def test_s5_frames_without_the_overlay():
    frames, without = clip(20, "blocks", (0.6,))[0], clip(20, "blocks", (0.0,))[0]
    mixed = np.where((np.arange(20) % 2 == 0)[:, None, None, None], frames, without)
    layer = layers.estimate(mixed)
    assert len(layer.present) == 10 and layer.gated
    restorer = Restorer(layer)
    upright = restorer.process(0, frames[3])
    assert restorer.presence > 0.7
    rgba = np.concatenate([without[4], np.full((H, W, 1), 255, np.uint8)], -1)
    assert (restorer.process(1, rgba) == rgba).all() and restorer.presence < 0.3
    flipped = Restorer(layer)
    assert (flipped.process(0, frames[3][::-1], flip=True)[27, 30] == upright[27, 30]).all() and abs(flipped.presence - 1) < 0.3


def test_s6_restoration_follows_the_scene():
    frames, truth = clip(40, "blocks", (0.6,))
    layer = layers.estimate(frames[:16])
    area = (X >= 22) & (X < 38) & (Y >= 16) & (Y < 32)
    errors, _, _, restorer = run(layer, frames, truth, area)
    assert not layer.gated and errors[0] < 0.05 and errors[-10:].mean() < errors[0]
    assert np.abs(restorer.motion - (-2, -3)).max() < 0.6


def test_s7_still_scene():
    frame, truth = clip(1, "blocks", (0.6,))
    layer = layers.estimate(np.repeat(frame, 12, axis=0))
    assert layer.reason == "static-fill" and layer.template is not None and layer.fill.sum() >= 300
    out = Restorer(layer).process(0, frame[0]) / 255
    assert abs(out[layer.fill][:, 0].mean() - truth[0][layer.fill][:, 0].mean()) < 0.10


def test_s8_too_few_frames_or_too_large_a_region():
    assert layers.estimate(clip(16, "blocks", (0.6,))[0][:3]) is None
    assert layers.estimate(np.broadcast_to(np.zeros((1, 1, 1, 3), np.uint8), (8, 1000, 801, 3))) is None


def test_s9_thin_soft_text():
    frames, truth = clip(40, "text", (0.55, 0.30, 0.14, 0.05, 0.018), 0.008)
    layer = layers.estimate(frames[:16])
    ramp = (distance(STROKES) >= 1) & (distance(STROKES) <= 3)
    assert layer.reason == "ok" and layer.mask[ramp].sum() >= 0.85 * ramp.sum()
    errors, *_ = run(layer, frames, truth, distance(STROKES) <= 4)
    assert errors[0] < 0.045 and errors[-10:].mean() < min(0.015, 0.65 * errors[0])


def test_s10_opaque_text():
    frames, truth = clip(40, "text", (1.0, 0.65, 0.25, 0.07), 0.008)
    errors, *_ = run(layers.estimate(frames[:16]), frames, truth, distance(STROKES) <= 3)
    assert errors[0] < 0.12 and errors[-10:].mean() < min(0.015, 0.35 * errors[0])


def test_s11_slow_scene():
    frames, truth = clip(80, "text", (1.0, 0.65, 0.25, 0.07), 0.008, (0.15, 0.10), seed=11)
    layer = layers.estimate(sampled(frames))
    assert layer.mask.any()
    errors, *_ = run(layer, frames, truth, distance(STROKES) <= 3)
    assert errors[0] < 0.12 and errors[-10:].mean() < 0.12


def test_s12_fast_scene():
    frames, truth = clip(60, "text", (0.45, 0.30, 0.15, 0.05), 0.008, (6, 4), seed=13)
    errors, black, *_ = run(layers.estimate(sampled(frames)), frames, truth, distance(STROKES) <= 3)
    assert black == 0 and errors[-10:].mean() < 0.02


def test_s13_overlay_rendered_anew_for_each_clip():
    frames, truth = clip(60, "text", (0.45, 0.30, 0.15, 0.05), 0.008, (6, 4), True, seed=17)
    layer = layers.estimate(sampled(frames))
    assert layer is not None and layer.mask.any()
    errors, black, *_ = run(layer, frames, truth, distance(STROKES) <= 3)
    assert black < 20 and errors[-10:].mean() < 0.09


def test_s14_opaque_overlay_rendered_anew_for_each_clip():
    frames, truth = clip(60, "blocks", (1.0, 0.5), 0.008, (6, 4), True, seed=23)
    layer = layers.estimate(sampled(frames))
    assert layer is not None and layer.mask.any() and layer.template is not None
    errors, black, offsets, _ = run(layer, frames, truth, distance(BLOCKS) <= 2)
    y0, x0 = offsets[2]
    followed = sum(offsets[t] == (y0 + 3 * k, x0 + 6 * k) for t in range(10, 60) for k in [sum(t >= c for c in CUTS)])
    assert followed >= 45 and black < 20 and errors[-10:].mean() < 0.09


def test_s15_still_opaque_overlay_does_not_wander():
    frames, truth = clip(40, "blocks", (1.0, 0.5))
    layer = layers.estimate(frames[:16])
    assert layer.reason == "ok" and layer.template is not None
    *_, offsets, _ = run(layer, frames, truth, LOGO)
    assert not np.any(offsets)


def test_s16_region_and_atlas(spark):
    from pyspark.sql import functions as F

    from strataflow.functions import scalars as S
    from strataflow.operators import zones

    zone = S.rect(*map(F.lit, (0.30, 0.50, 0.70, 0.75)))
    region = spark.range(1).select(S.region_of(zone, F.lit(200), F.lit(120)).alias("r")).first().r
    assert tuple(region) == (32, 32, 136, 86)
    x, y = np.meshgrid(np.arange(136), np.arange(86))
    a = (((x >= 50) & (x <= 70) & (y >= 35) & (y <= 55)) * 0.6)[..., None]
    r = np.random.default_rng(7)
    frames = np.stack([np.floor(np.clip(a + (1 - a) * background(t, x=x, y=y) + r.uniform(-0.004, 0.004, (86, 136, 3)), 0, 1) * 255 + 0.5) for t in range(10)]).astype(np.uint8)
    layer = layers.estimate(frames)
    assert layer.mask.any()
    rows = [(1, 0, 136, 86, 136, 86, int(layer.mask.sum())), (1, 1, 136, 85, 136, 86, 5), (1, 2, None, None, 20, 20, 0)]
    atlas = zones.atlas(spark.createDataFrame(rows, "g int, pos int, width int, height int, region_width int, region_height int, mask_pixels int"), ["g"]).collect()
    assert [(r.atlas_row, r.atlas_width, r.atlas_height) for r in atlas] == [(0, 136, 86)]


@pytest.mark.parametrize("shape", [(48, 96), (7, 5), (1, 1), (1, 9), (30, 1)])
def test_labels_against_a_flood(shape):
    from strataflow.operators.components import label_mask

    r = np.random.default_rng(shape[0])
    for density in (0.2, 0.45, 0.6, 1.0):
        mask = r.random(shape) < density
        want, n = np.zeros(shape, int), 0
        for y, x in np.argwhere(mask):
            if not want[y, x]:
                n += 1
                stack = [(y, x)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < shape[0] and 0 <= b < shape[1] and mask[a, b] and not want[a, b]:
                        want[a, b] = n
                        stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (label_mask(mask) == want).all()


def test_nearest_clean_against_a_queue():
    from collections import deque

    from strataflow.operators.solvers import nearest_clean

    r = np.random.default_rng(3)
    for _ in range(20):
        mask = r.random((9, 13)) < 0.8
        want = np.where(mask.ravel(), -1, np.arange(mask.size))
        queue = deque(np.flatnonzero(~mask.ravel()).tolist())
        while queue:
            p = queue.popleft()
            y, x = divmod(p, 13)
            for q in ([p - 1] if x else []) + ([p + 1] if x < 12 else []) + ([p - 13] if y else []) + ([p + 13] if y < 8 else []):
                if want[q] < 0:
                    want[q] = want[p]
                    queue.append(q)
        if not mask.all():
            assert (nearest_clean(mask) == want).all()


def test_shift_errors_against_loops():
    from strataflow.streaming.restore import SEARCH, Matcher

    r = np.random.default_rng(1)
    now, before, clean = r.random((40, 37)), r.random((40, 37)), r.random((40, 37)) < 0.7
    matcher = Matcher(clean)
    got = matcher.errors(matcher.ready(now), matcher.ready(before))
    for dy, dx in ((0, 0), (3, -7), (-12, 5), (SEARCH, -SEARCH), (1, 1)):
        d = [now[y, x] - before[y - dy, x - dx] for y in range(40) for x in range(37) if 0 <= y - dy < 40 and 0 <= x - dx < 37 and clean[y, x] and clean[y - dy, x - dx]]
        want = np.std(d) if len(d) >= matcher.least else np.inf
        assert np.isclose(got[SEARCH + dy, SEARCH + dx], want) or got[SEARCH + dy, SEARCH + dx] == want
