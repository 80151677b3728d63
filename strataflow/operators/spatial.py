"""Spatial methods on one frame: zones are replaced by a mirrored reconstruction, a blur, blocks, or the restored
picture of their region, and blended at their border. Zones are (left, top, right, bottom) in 0..1, y down.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Methods by number, and the kernels' sizes, widths and limits.
INPAINT, BLUR, PIXELATE, RESTORED = 0, 1, 2, 3
MAX_ZONES, EDGE = 6, 0.001
BLUR_REACH, BLUR_WIDTH, BLUR_LEAST, BLUR_SHARE = 4, 10.0, 1.5, (0.02, 0.10)
LOW_REACH, LOW_WIDTH, LOW_RADIUS, GAP, FADE, FAR, SEAM, LEAST_SEAM = 3, 4.5, (6.0, 48.0), 2.0, 8.0, 4096.0, 0.05, 2.0
BLOCKS, LEAST_BLOCK = (24.0, 4.0), 2.0


@dataclass
class Region:
    """A restored region: its place in pixels, its pixels, and where they replace the frame's."""

    left: int
    top: int
    pixels: np.ndarray
    mask: np.ndarray


def smoothstep(lo: float, hi: float, x: np.ndarray) -> np.ndarray:
    t = np.clip((x - lo) / (hi - lo), 0, 1)
    return t * t * (3 - 2 * t)


def sample(image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bilinear value at (u, v) in 0..1, kept off the very border and clamped at it."""
    h, w = image.shape[:2]
    x, y = np.clip(u, EDGE, 1 - EDGE) * w - 0.5, np.clip(v, EDGE, 1 - EDGE) * h - 0.5
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    at = lambda i, j: image[np.clip(y0 + i, 0, h - 1), np.clip(x0 + j, 0, w - 1)]
    return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy


def _kernel(reach: int, width: float) -> list[tuple[int, int, float]]:
    span = range(-reach, reach + 1)
    weights = [(i, j, float(np.exp(-(i * i + j * j) / width))) for i in span for j in span]
    total = sum(k for _, _, k in weights)
    return [(i, j, k / total) for i, j, k in weights]


def blur(image: np.ndarray, u: np.ndarray, v: np.ndarray, stride: tuple[float, float]) -> np.ndarray:
    return sum(k * sample(image, u + i * stride[0], v + j * stride[1]) for i, j, k in _kernel(BLUR_REACH, BLUR_WIDTH))


def low_pass(image: np.ndarray, u: np.ndarray, v: np.ndarray, step: float, side: int, zone: tuple[float, ...]) -> np.ndarray:
    """Wide average around (u, v), every tap pushed out of the zone on one side: left, right, above, below."""
    h, w = image.shape[:2]
    le, t, r, b = zone
    out = 0
    for i, j, k in _kernel(LOW_REACH, LOW_WIDTH):
        x, y = u + i * step / w, v + j * step / h
        if side == 0:
            x = np.minimum(x, le - GAP / w)
        elif side == 1:
            x = np.maximum(x, r + GAP / w)
        elif side == 2:
            y = np.minimum(y, t - GAP / h)
        else:
            y = np.maximum(y, b + GAP / h)
        out = out + k * sample(image, x, y)
    return out


def inpaint(image: np.ndarray, u: np.ndarray, v: np.ndarray, zone: tuple[float, ...]) -> np.ndarray:
    """Copies of the surroundings mirrored across the nearest edges of the zone, in the tone that the four edges let
    expect; a blur where no edge has a source inside the frame."""
    h, w = image.shape[:2]
    size = np.array([w, h], float)
    le, t, r, b = zone
    x, y = np.clip(u, le + 0.5 / w, r - 0.5 / w), np.clip(v, t + 0.5 / h, b - 0.5 / h)
    snap = lambda p, n: (np.floor(p * n) + 0.5) / n
    depth = [(x - le) * w, (r - x) * w, (y - t) * h, (b - y) * h]
    sources = [(le - GAP / w - (x - le), y), (r + GAP / w + (r - x), y), (x, t - GAP / h - (y - t)), (x, b + GAP / h + (b - y))]
    sources = [(snap(p, w), snap(q, h)) for p, q in sources]
    fade = FADE / size
    valid = [
        smoothstep(0, fade[0], sources[0][0]), 1 - smoothstep(1 - fade[0], 1, sources[1][0]),
        smoothstep(0, fade[1], sources[2][1]), 1 - smoothstep(1 - fade[1], 1, sources[3][1]),
    ]
    shorter = min((r - le) * w, (b - t) * h)
    away = np.stack([d + (1 - ok) * FAR for d, ok in zip(depth, valid)])
    near = np.exp(-(away - away.min(0)) / max(SEAM * shorter, LEAST_SEAM))
    near /= near.sum(0)
    step = float(np.clip(0.5 * shorter, *LOW_RADIUS)) / 3
    copy = sum(k[..., None] * sample(image, *s) for k, s in zip(near, sources))
    low = sum(k[..., None] * low_pass(image, *s, step, side, zone) for side, (k, s) in enumerate(zip(near, sources)))
    share = np.stack([ok / (d * d + 1) for d, ok in zip(depth, valid)])
    edges = [(np.full_like(x, le - GAP / w), y), (np.full_like(x, r + GAP / w), y), (x, np.full_like(y, t - GAP / h)), (x, np.full_like(y, b + GAP / h))]
    expected = sum(k[..., None] * low_pass(image, *e, step, side, zone) for side, (k, e) in enumerate(zip(share, edges))) / np.maximum(share.sum(0), 1e-12)[..., None]
    none = sum(valid) <= 1e-4
    return np.where(none[..., None], blur(image, u, v, (FADE / w, FADE / h)) if none.any() else 0, np.clip(copy + expected - low, 0, 1))


def pixelate(image: np.ndarray, u: np.ndarray, v: np.ndarray, zone: tuple[float, ...], strength: float) -> np.ndarray:
    """The value at the centre of each block; blocks grow with the strength and have two pixels at least."""
    h, w = image.shape[:2]
    le, t, r, b = zone
    count = BLOCKS[0] + (BLOCKS[1] - BLOCKS[0]) * strength
    bw, bh = max((r - le) / count, LEAST_BLOCK / w), max((b - t) / count, LEAST_BLOCK / h)
    return sample(image, (np.floor((u - le) / bw) + 0.5) * bw + le, (np.floor((v - t) / bh) + 0.5) * bh + t)


def distance(u: np.ndarray, v: np.ndarray, zone: tuple[float, ...]) -> np.ndarray:
    """Signed distance to a zone, negative inside."""
    le, t, r, b = zone
    dx, dy = np.abs(u - (le + r) / 2) - (r - le) / 2, np.abs(v - (t + b) / 2) - (b - t) / 2
    return np.hypot(np.maximum(dx, 0), np.maximum(dy, 0)) + np.minimum(np.maximum(dx, dy), 0)


def feather_of(method: int, feather: float, width: int, height: int) -> float:
    """Width of the blended border: a few pixels for the reconstruction, else by the smaller side."""
    pixels = 2.5 if method in (INPAINT, RESTORED) else feather * 0.03 * min(width, height)
    return pixels / max(width, height)


def render(image: np.ndarray, zones: list[tuple[float, ...]], method: int = INPAINT, strength: float = 0.5, feather: float = 0.5, regions: list[Region | None] | None = None) -> np.ndarray:
    """image (h, w, 3) in 0..1 with up to ``MAX_ZONES`` zones replaced one after the other, each over the result of those
    before. With method ``RESTORED`` a zone's region replaces exactly its mask; zones without one are reconstructed."""
    h, w = image.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    u, v = (x + 0.5) / w, (y + 0.5) / h
    out = image.copy()
    border = feather_of(method, feather, w, h)
    for k, zone in enumerate(zones[:MAX_ZONES]):
        region = regions[k] if method == RESTORED and regions and k < len(regions) else None
        if region is not None:
            rows, columns = slice(region.top, region.top + region.mask.shape[0]), slice(region.left, region.left + region.mask.shape[1])
            out[rows, columns] = np.where(region.mask[..., None], region.pixels, image[rows, columns])
            continue
        d = distance(u, v, zone)
        touched = d <= border
        if not touched.any():
            continue
        at = u[touched], v[touched]
        if method in (INPAINT, RESTORED):
            made = inpaint(image, *at, zone)
        elif method == BLUR:
            grow = BLUR_SHARE[0] + BLUR_SHARE[1] * strength
            made = blur(image, *at, (max((zone[2] - zone[0]) * grow, BLUR_LEAST / w), max((zone[3] - zone[1]) * grow, BLUR_LEAST / h)))
        else:
            made = pixelate(image, *at, zone, strength)
        mix = (1 - smoothstep(0, max(border, 1e-5), d[touched]))[:, None]
        out[touched] = out[touched] * (1 - mix) + made * mix
    return out


def render_frames(frames: DataFrame, zones: list[tuple[float, ...]], method: int = INPAINT, strength: float = 0.5, feather: float = 0.5) -> DataFrame:
    """frames (video_id, pts_us, w, h, rgb) with the zones replaced; frames of another size than w x h stay as they are."""

    def run(batches):
        for b in batches:
            done = []
            for raw, w, h in zip(b.column("rgb").to_pylist(), b.column("w").to_pylist(), b.column("h").to_pylist()):
                if raw is not None and w and h and len(raw) == w * h * 3:
                    got = render(np.frombuffer(raw, np.uint8).reshape(h, w, 3) / 255.0, zones, method, strength, feather)
                    raw = np.floor(np.clip(got, 0, 1) * 255 + 0.5).astype(np.uint8).tobytes()
                done.append(raw)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("video_id", "pts_us", "w", "h")), pa.array(done, pa.binary())], names=["video_id", "pts_us", "w", "h", "rgb"])

    rows = frames.select("video_id", "pts_us", "w", "h", "rgb")
    return rows.mapInArrow(run, rows.schema)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resampling to exactly width x height; the same array where it has that size."""
    if image.shape[:2] == (height, width):
        return image
    h, w = image.shape[:2]
    y, x = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def fit_frames(frames: DataFrame, width: int, height: int) -> DataFrame:
    """frames (video_id, pts_us, w, h, rgb) forced to exactly width x height, so that masks stay aligned to the pixel."""

    def run(batches):
        for b in batches:
            rows = zip(b.column("rgb").to_pylist(), b.column("w").to_pylist(), b.column("h").to_pylist())
            done = [resize(np.frombuffer(raw, np.uint8).reshape(h, w, 3), width, height).tobytes() for raw, w, h in rows]
            size = [pa.array([n] * len(b), pa.int32()) for n in (width, height)]
            yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("pts_us"), *size, pa.array(done, pa.binary())], names=["video_id", "pts_us", "w", "h", "rgb"])

    rows = frames.select("video_id", "pts_us", "w", "h", "rgb").where("octet_length(rgb) = 3L * w * h and w > 0 and h > 0")
    return rows.selectExpr("video_id", "pts_us", "cast(w as int) as w", "cast(h as int) as h", "rgb").mapInArrow(run, f"video_id {rows.schema['video_id'].dataType.simpleString()}, pts_us {rows.schema['pts_us'].dataType.simpleString()}, w int, h int, rgb binary")


def read_back(frames: DataFrame, left: int, top: int, width: int, height: int, flip: bool = False) -> DataFrame:
    """frames (video_id, pts_us, w, h, rgb) -> the bytes of one region, top row first; frames are bottom row first
    where ``flip``."""

    def run(batches):
        for b in batches:
            done = []
            for raw, w, h in zip(b.column("rgb").to_pylist(), b.column("w").to_pylist(), b.column("h").to_pylist()):
                image = np.frombuffer(raw, np.uint8).reshape(h, w, 3)
                done.append((image[::-1] if flip else image)[top : top + height, left : left + width].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("pts_us"), pa.array(done, pa.binary())], names=["video_id", "pts_us", "rgb"])

    rows = frames.select("video_id", "pts_us", "w", "h", "rgb")
    return rows.mapInArrow(run, f"video_id {rows.schema['video_id'].dataType.simpleString()}, pts_us {rows.schema['pts_us'].dataType.simpleString()}, rgb binary")
