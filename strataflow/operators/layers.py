"""Overlay-layer estimation over one region's frames: a translucent or opaque picture that stays in
place while the scene behind it moves.

observed = c + (1 - a) * scene, with a the layer's opacity and c its colour times opacity. Where a is
above ``INVERT`` the scene can't be told from it and the pixel is a fill.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from . import refine, solvers, tracking
from .components import label_mask, recruit
from .solvers import fill_distances
from .tracking import Template
from .tracking import median_mad as mad

# Gates and thresholds of the analysis.
INVERT, MIN_FRAMES, MIN_PRESENT, RING, MIN_COMPONENT, MIN_MOTION, MAX_PIXELS = 0.8, 6, 4, 4, 6, 0.012, 800_000
TAU_GRADIENT, K_CONSISTENT, TAU_RELIEF, TAU_RANGE, OVERMASK, OVERMASK_KEEP = 0.02, 2.0, 0.05, 0.10, 0.60, 0.70
STATIC_CONTRAST, STATIC_SPREADS, STATIC_SIZE, STATIC_SHARE, STATIC_RECRUIT, STATIC_MOST = 0.10, 4.0, 8, 0.05, 0.03, 3
STATIC_GROW, STATIC_CLUSTER, STATIC_COVER = 6, 32, 0.70
CHUNK, CHUNK_STEP, CHUNK_LEAST, CHUNK_FILLED, CHUNK_TAKEOVER, DIRECT_COMPLETE = 8, 3, 0.6, 0.30, 0.60, 0.75
FILLED, VERIFIED, ALIGN_INVERTED, ALIGN_LEAST, ALIGN_RESIDUAL = 0.50, 2, 0.40, 0.9, 0.85
BLOCK_LEAST, BLOCK_GAP, BLOCK_ROWS, BLOCK_HEIGHTS, UNION_MOST, UNION_GROWS, UNION_SHARE = 80, (2, 30), 5, 1.6, 1.8, 1.15, 0.5
REFINE_PASSES, REFINE_GAIN, GHOST_SLACK, COLOUR_SLACK = 3, 0.8, 0.03, 0.02


@dataclass
class Layer:
    colour: np.ndarray
    alpha: np.ndarray
    fill: np.ndarray
    reason: str
    frames: int
    present: list[int]
    motion: float
    components: int = 0
    template: Template | None = None

    @property
    def mask(self) -> np.ndarray:
        return (self.alpha > 0) | self.fill

    @property
    def gated(self) -> bool:
        """Whether some frames lack the overlay."""
        return len(self.present) < self.frames

    @property
    def fill_share(self) -> float:
        """Share of the masked pixels that are fill."""
        return float(self.fill.sum() / max(1, self.mask.sum()))


def rank(x: np.ndarray, q: float) -> float:
    s = np.sort(x, axis=None)
    return float(s[int((len(s) - 1) * q)]) if len(s) else 0.0


def inner(shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, bool)
    out[RING:-RING, RING:-RING] = True
    return out


def present_frames(v: np.ndarray) -> list[int]:
    """Frames that carry the layer, told by regression on the median gradients and the largest score gap."""
    n = len(v)
    every = list(range(n))
    if n < MIN_FRAMES + 2:
        return every
    dx, dy = np.diff(v, axis=2), np.diff(v, axis=1)
    mx, my = np.median(dx, axis=0), np.median(dy, axis=0)
    size = np.zeros((2, *v.shape[1:3]))
    size[0, :, :-1], size[1, :-1] = np.abs(mx).max(-1), np.abs(my).max(-1)
    limit = max(rank(size, 0.98), 0.02)
    tx, ty = size[0, :, :-1] >= limit, size[1, :-1] >= limit
    den = (mx[tx] ** 2).sum() + (my[ty] ** 2).sum()
    if den <= 1e-6 or tx.sum() + ty.sum() < 20:
        return every
    score = np.array([((dx[t][tx] * mx[tx]).sum() + (dy[t][ty] * my[ty]).sum()) / den for t in range(n)])
    s = np.sort(score)
    gaps = np.diff(s)[: n - MIN_PRESENT]
    k = int(gaps.argmax())
    if s[-1] <= 0 or gaps[k] < 0.4 * s[-1] or s[k] > 0.3 * s[-1]:
        return every
    return [t for t in every if score[t] > s[k]]


def consistent(v: np.ndarray, axis: int) -> np.ndarray:
    """Median gradients that the frames agree on, zero elsewhere; shape of a frame."""
    m, d = mad(np.diff(v, axis=axis + 1))
    top = np.abs(m).max(-1)
    keep = (top > TAU_GRADIENT) & (top > K_CONSISTENT * d.mean(-1))
    out = np.zeros(v.shape[1:])
    out[tuple(slice(0, s) for s in m.shape)] = np.where(keep[..., None], m, 0)
    return out


def divergence(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    d = gx + gy
    d[:, 1:] -= gx[:, :-1]
    d[1:] -= gy[:-1]
    return d


def local_range(x: np.ndarray, r: int) -> np.ndarray:
    stack = [np.pad(x, r, mode="edge")[r + dy : r + dy + x.shape[0], r + dx : r + dx + x.shape[1]] for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    return np.max(stack, axis=0) - np.min(stack, axis=0)


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    labels = label_mask(mask)
    return mask & (np.bincount(labels.ravel())[labels] >= least)


def scene(v: np.ndarray, layer: Layer) -> np.ndarray:
    """Frames with the translucent pixels un-blended; fills as they are."""
    a = np.minimum(layer.alpha, INVERT)[..., None]
    return np.where(layer.fill[..., None], v, np.clip((v - layer.colour) / (1 - a), 0, 1))


def energy(v: np.ndarray) -> np.ndarray:
    out = np.zeros(v.shape[1:3])
    for axis in (0, 1):
        s = (consistent(v, axis) ** 2).sum(-1)
        out += s
        if axis == 0:
            out[1:] += s[:-1]
        else:
            out[:, 1:] += s[:, :-1]
    return out


def exposure_motion(v: np.ndarray, median: np.ndarray) -> float:
    """Median temporal spread of the ring once each frame's gain and offset are taken out."""
    ring = ~inner(median.shape[:2])
    x = median[ring].ravel()
    residual = []
    for frame in v:
        y = frame[ring].ravel()
        var = x.var()
        gain = np.clip(((x * y).mean() - x.mean() * y.mean()) / var, 0.3, 3) if var > 1e-5 else 1.0
        residual.append((y - (gain * x + y.mean() - gain * x.mean())).reshape(-1, 3))
    return float(np.median(mad(np.array(residual))[1].mean(-1)))


def relief_mask(relief: np.ndarray) -> np.ndarray:
    top = np.abs(relief).max(-1)
    inside = inner(top.shape)
    tau = TAU_RELIEF
    if (top[inside] > tau).mean() > OVERMASK:
        tau = max(tau, rank(top[inside], OVERMASK_KEEP))
    mask = without_small((top > tau) & (local_range(top, 2) > TAU_RANGE), MIN_COMPONENT)
    return solvers.dilate(solvers.fill_holes(mask)) & inside


def spread_mask(spread: np.ndarray, below: float, least: float = 0.0) -> np.ndarray:
    """Inner pixels that vary much less than the region does; none where the region itself varies less than ``least``."""
    inside = inner(spread.shape)
    med = rank(spread[inside], 0.5)
    return without_small((spread < 0.65 * med) & (spread < med - below) & inside, MIN_COMPONENT) if med >= least else np.zeros_like(inside)


def joined_blocks(labels: np.ndarray) -> bool:
    """Whether a mask is two large blocks side by side, likely one overlay whose middle the gradients missed."""
    if labels.max() != 2 or np.bincount(labels.ravel())[1:].min() < BLOCK_LEAST:
        return False
    (y0, x0, y1, x1), (v0, u0, v1, u1) = (_box(labels == k) for k in (1, 2))
    heights = (y1 - y0 + 1, v1 - v0 + 1)
    return BLOCK_GAP[0] <= max(x0 - u1, u0 - x1) <= BLOCK_GAP[1] and min(y1, v1) - max(y0, v0) > BLOCK_ROWS and max(heights) / min(heights) < BLOCK_HEIGHTS


def _box(mask: np.ndarray) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column)."""
    ys, xs = np.nonzero(mask)
    return int(ys.min()), int(xs.min()), int(ys.max()), int(xs.max())


def with_spread(mask: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """A mask of two blocks, with the pixels that vary little where these join the blocks or fill a hole of theirs."""
    labels = label_mask(mask)
    still = spread_mask(spread, 0.015) if joined_blocks(labels) else np.zeros_like(mask)
    if not still.any():
        return mask
    union = solvers.fill_holes(without_small(mask | still, MIN_COMPONENT)) & inner(mask.shape)
    before, after = int(mask.sum()), int(union.sum())
    fits = before < after < min(UNION_SHARE * mask.size, UNION_MOST * before)
    return union if fits and (label_mask(union).max() < labels.max() or after > before * UNION_GROWS) else mask


def masked_median(x: np.ndarray) -> np.ndarray:
    """3 x 3 medians of the values from 0 up; -1 where fewer than three of them or the value itself are."""
    p = np.pad(np.where(x >= 0, x, np.nan), 1, constant_values=np.nan)
    stack = np.stack([p[1 + dy : 1 + dy + x.shape[0], 1 + dx : 1 + dx + x.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    enough = (x >= 0) & (np.isfinite(stack).sum(0) >= 3)
    out = np.full(x.shape, -1.0)
    out[enough] = np.nanmedian(stack[:, enough], axis=0)
    return out


def _slope_opacity(ground: np.ndarray, seen: np.ndarray) -> float:
    """1 - slope of what is seen on the ground; 0.5 where the ground hardly varies."""
    x, y = ground.ravel(), seen.ravel()
    return 1 - float(np.clip(((x * y).mean() - x.mean() * y.mean()) / x.var(), 0, 1)) if x.var() >= 0.003 else 0.5


def opacities(labels, median, spread, relief, strength):
    """Opacity, colour and fill of every pixel from the relief and from how much less it varies than its surroundings;
    colour and opacity of every component (index 0 is no component)."""
    mask = labels > 0
    ground = solvers.harmonic_fill(median, mask)
    around = solvers.harmonic_fill(spread[..., None], mask)[..., 0]
    damped = np.clip(1 - spread / np.maximum(around, 1e-4), 0, 1)
    smooth = masked_median(np.where(mask & (around > 0.02), damped, -1.0))
    alpha, colour, fill = np.zeros(mask.shape), np.zeros((*mask.shape, 3)), np.zeros(mask.shape, bool)
    own, opacity = np.zeros((labels.max() + 1, 3)), np.zeros(labels.max() + 1)
    for k in range(1, labels.max() + 1):
        part = labels == k
        core = part & (strength >= 0.5 * rank(strength[part], 0.9))
        a = float(np.median(damped[core])) if np.median(around[core]) > 0.02 else _slope_opacity(ground[core], median[core])
        opacity[k] = a = min(1.0, max(0.05, a))
        own[k] = np.clip(np.median(ground[core] + relief[core] / a, axis=0), 0, 1)
        d = own[k] - ground[part]
        den = (d * d).sum(-1)
        projected = np.where(den > 0.01, np.clip((relief[part] * d).sum(-1) / np.maximum(den, 1e-9), 0, 1), a)
        trust = np.where(smooth[part] >= 0, np.clip((around[part] - 0.02) / 0.05, 0, 1), 0)
        each = np.clip((projected + trust * smooth[part]) / (1 + trust), 0, min(1.0, a + 0.15))
        opaque = each > INVERT
        fill[part] = opaque
        alpha[part] = np.where(opaque, 0, each)
        colour[part] = np.where(opaque[:, None], 0, np.clip(relief[part] + each[:, None] * ground[part], 0, 1))
    return alpha, colour, fill, own, opacity


def one_pass(v: np.ndarray) -> Layer | None:
    n_all, h, w, _ = v.shape
    present = present_frames(v)
    v = v[present]
    n = len(v)
    if n < MIN_PRESENT:
        return None
    median, spread3 = mad(v)
    spread = spread3.mean(-1)
    motion = exposure_motion(v, median)
    empty = Layer(np.zeros((h, w, 3)), np.zeros((h, w)), np.zeros((h, w), bool), "static", n_all, present, motion)
    if motion < MIN_MOTION:
        return empty
    f = divergence(consistent(v, 1), consistent(v, 0))
    relief = np.stack([solvers.poisson(f[..., c]) for c in range(3)], -1)
    mask = relief_mask(relief)
    if mask.any():
        mask = with_spread(mask, spread)
    elif n >= 12:
        mask = solvers.dilate(solvers.fill_holes(spread_mask(spread, 0.02, 0.18))) & inner(mask.shape)
        mask &= spread_mask(spread, 0.02, 0.18).any()
    if not mask.any():
        empty.reason = "no overlay"
        return empty
    labels = label_mask(mask)
    count = int(labels.max())
    strength = np.abs(relief).max(-1)
    alpha, colour, fill, own, opacity = opacities(labels, median, spread, relief, strength)
    found = labels
    labels = refine.soft_edges(median, labels, strength, alpha, colour, fill, own, opacity, INVERT)
    refine.regress(v, labels, alpha, colour, fill, INVERT)
    layer = Layer(colour, alpha, fill, "ok", n_all, present, motion, count)
    remove_ghost(v, layer, labels > 0)
    before, after = energy(v), energy(scene(v, layer))
    for k in range(1, count + 1):
        part = (labels == k) & ~layer.fill
        if before[part].sum() > 0 and after[part].sum() > 0.6 * before[part].sum():
            layer.fill |= found == k  # the band around keeps its faint opacity
    layer.alpha[layer.fill] = 0
    layer.colour[layer.fill] = 0
    return layer


def remove_ghost(v: np.ndarray, layer: Layer, mask: np.ndarray) -> None:
    """What still stands still in the un-blended frames is integrated and folded back into the colour."""
    invert = mask & ~layer.fill
    if not invert.any():
        return
    near = solvers.dilate(invert)
    for _ in range(REFINE_PASSES):
        u = scene(v, layer)
        gradient = []
        for axis in (1, 0):
            m, d = mad(np.diff(u, axis=axis + 1))
            keep = np.abs(m).max(-1) > 2 * 1.25 / np.sqrt(len(u)) * d.mean(-1)
            g = np.zeros(v.shape[1:])
            g[tuple(slice(0, s) for s in m.shape)] = np.where(keep[..., None], m, 0)
            g[~near] = 0
            gradient.append(g)
        ghost = solvers.masked_poisson(divergence(*gradient), invert)
        step = REFINE_GAIN * ghost
        wanted = (layer.colour + step * (1 - layer.alpha)[..., None]).max(-1)
        # More colour than the opacity allows means that the opacity was taken too low.
        short = invert & (wanted > layer.alpha + GHOST_SLACK) & (layer.alpha < INVERT - 0.01)
        layer.alpha = np.where(short, np.minimum(INVERT, layer.alpha + REFINE_GAIN * (wanted - COLOUR_SLACK - layer.alpha)), layer.alpha)
        bound = np.minimum(1, layer.alpha + COLOUR_SLACK)[..., None]
        layer.colour = np.where(invert[..., None], np.clip(layer.colour + step * (1 - layer.alpha)[..., None], 0, bound), layer.colour)


def static_box(contrast: np.ndarray, limit: float) -> tuple[int, int, int, int] | None:
    """(y0, x0, y1, x1) of the heaviest contrast components of the inner area, of those near the heaviest, and of the
    smaller ones beside them; None without any."""
    labels = label_mask((contrast > limit) & inner(contrast.shape))
    parts = []
    for k in range(1, labels.max() + 1):
        part = labels == k
        y0, x0, y1, x1 = _box(part)
        parts.append((float((contrast[part] - limit).sum()), int(part.sum()), (y0, x0, y1, x1)))
    ranked = sorted((p for p in parts if p[1] >= STATIC_SIZE and p[0] > 0), key=lambda p: -p[0])
    if not ranked:
        return None
    heaviest, _, home = ranked[0]
    near = lambda box: sum(abs(a - b) for a, b in zip(box, home)) <= 4 * STATIC_CLUSTER
    kept = [box for mass, _, box in ranked[:STATIC_MOST] if mass >= STATIC_SHARE * heaviest and near(box)]
    y0, x0, y1, x1 = (f(b[i] for b in kept) for i, f in enumerate((min, min, max, max)))
    beside = [(b, a, d, c, mass) for mass, size, (a, b, c, d) in parts if size >= STATIC_SIZE]
    x0, y0, x1, y1 = recruit(beside, (x0, y0, x1, y1), heaviest, STATIC_CLUSTER, STATIC_RECRUIT)
    return y0, x0, y1, x1


def static_layer(v: np.ndarray, motion: float) -> Layer | None:
    """In a scene that stands still an overlay is told by its contrast alone. The box around it is all fill; where it
    would cover most of the inner area, or nothing stands out, the whole inner area is."""
    median = np.median(v, axis=0)
    inside = inner(median.shape[:2])
    h, w = inside.shape
    if h - 2 * RING < 4 or w - 2 * RING < 4:
        return None
    contrast = local_range(median.mean(-1), 1)
    typical = rank(contrast[inside], 0.5)
    box = static_box(contrast, max(STATIC_CONTRAST, typical + STATIC_SPREADS * float(np.abs(contrast[inside] - typical).mean())))
    fill = inside.copy()
    if box:
        y0, x0, y1, x1 = box
        grown = np.zeros_like(inside)
        grown[max(RING, y0 - STATIC_GROW) : min(h - RING, y1 + STATIC_GROW + 1), max(RING, x0 - STATIC_GROW) : min(w - RING, x1 + STATIC_GROW + 1)] = True
        if grown.sum() <= STATIC_COVER * inside.sum():
            fill = solvers.dilate(solvers.dilate(grown))
    return Layer(np.zeros_like(median), np.zeros((h, w)), fill, "static-fill", len(v), list(range(len(v))), motion, 1, tracking.build_template(v, fill, fill))


def chunk_ranges(n: int, size: int = CHUNK, step: int = CHUNK_STEP, least: int = MIN_FRAMES) -> list[tuple[int, int]]:
    return [(s, min(s + size, n)) for s in range(0, n, step) if s + least <= n and (s == 0 or s + least - 1 < n)]


def residual(v: np.ndarray, layer: Layer) -> float:
    """Energy of what still stands still under the mask once the layer is taken out."""
    return float(energy(scene(v, layer))[layer.mask].sum())


def realigned(v: np.ndarray, base: Layer) -> Layer | None:
    """The analysis of the frames shifted onto the place of ``base``, where the frames tell that they were shifted, and
    the mask is about as complete and explains them better; None elsewhere. Only layers that are mostly translucent
    can be located by their edges."""
    if (base.alpha > 0).sum() < ALIGN_INVERTED * max(1, base.mask.sum()):
        return None
    taps = tracking.border_taps(base.colour, base.alpha, base.mask)
    if not len(taps):
        return None
    offsets = [tracking.tap_offset(taps, frame) for frame in v]
    if not np.any(offsets):
        return None
    aligned = np.stack([tracking.shift(frame, d) for frame, d in zip(v, offsets)])
    found = one_pass(aligned)
    if found is None or found.mask.sum() < ALIGN_LEAST * base.mask.sum():
        return None
    return found if residual(aligned, found) < ALIGN_RESIDUAL * residual(v, base) else None


def best_chunk(v: np.ndarray) -> tuple[Layer, int, int] | None:
    """Of the layers of runs of frames, among those with a large mask the one that is filled most."""
    found = [(one_pass(v[a:z]), a, z) for a, z in chunk_ranges(len(v))]
    found = [(x, a, z) for x, a, z in found if x is not None and x.mask.any()]
    most = max((x.mask.sum() for x, _, _ in found), default=0)
    return max((c for c in found if c[0].mask.sum() >= CHUNK_LEAST * most), key=lambda c: (c[0].fill_share, c[0].mask.sum()), default=None)


def taken_over(v: np.ndarray, chunk: Layer, a: int, z: int, direct: Layer | None) -> Layer | None:
    """The chunk's layer, all fill, with a template to follow it by: where it is opaque, about as complete as the direct
    layer, which isn't opaque itself, and its template is found again in frames outside the chunk."""
    size = chunk.mask.sum()
    if chunk.fill_share < CHUNK_FILLED or direct is not None and size < CHUNK_TAKEOVER * direct.mask.sum():
        return None
    if direct is not None and direct.fill_share >= FILLED and direct.mask.sum() >= DIRECT_COMPLETE * size:
        return None
    template = tracking.build_template(v[a:z], chunk.mask, chunk.fill)
    if template is None:
        return None
    places = [(np.zeros(2, int), 1.0) if a <= t < z else tracking.template_offset(template, frame) for t, frame in enumerate(v)]
    verified = sum(score >= tracking.TEMPLATE_SCORE for t, (_, score) in enumerate(places) if not a <= t < z)
    if verified < min(VERIFIED, len(v) - (z - a)):
        return None
    # Aligned, all frames show the whole overlay standing still, its thin strokes included.
    aligned = np.stack([tracking.shift(frame, d) for frame, (d, _) in zip(v, places)])
    whole = tracking.build_template(aligned, chunk.mask, chunk.mask)
    if whole is not None and whole.support.sum() > template.support.sum():
        template = whole
    return replace(chunk, colour=np.zeros_like(chunk.colour), alpha=np.zeros_like(chunk.alpha), fill=chunk.mask, frames=len(v), template=template)


def estimate(frames: np.ndarray) -> Layer | None:
    """frames (n, h, w, 3) of bytes -> layer, or None with too few frames, too small a region, or over ``MAX_PIXELS``."""
    n, h, w, _ = frames.shape
    if n < MIN_FRAMES or min(h, w) < 2 * RING + 4 or h * w > MAX_PIXELS:
        return None
    v = frames.astype(float) / 255
    direct = one_pass(v)
    candidate = (realigned(v, direct) or direct) if direct is not None and direct.mask.any() else None
    chunk = best_chunk(v)
    if chunk is not None:
        over = taken_over(v, *chunk, candidate)
        if over is not None:
            return over
    if candidate is not None:
        if candidate.fill_share >= FILLED:
            candidate.template = tracking.build_template(v, candidate.mask, candidate.fill)
        return candidate
    if chunk is not None:
        return realigned(v, chunk[0]) or chunk[0]
    if direct is not None and direct.reason == "static":
        return static_layer(v, direct.motion) or direct
    return direct


def _grid(pdf, names: list[str]) -> np.ndarray:
    """Rows (y, x, names..) of one region as an array (h, w, len(names))."""
    out = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1, len(names)))
    out[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf[names].to_numpy()
    return out


LAYER_DDL = "y int, x int, cr double, cg double, cb double, alpha double, fill boolean, dl int, dr int, du int, dd int, reason string, present int, motion double, components int"


def estimate_layers(frames, keys: list[str]):
    """frames (keys, t, w, h, rgb: one binary frame a row, row-major and interleaved) -> a row per pixel of every
    region's layer. A region's sampled frames are bounded (24 frames of ``MAX_PIXELS`` pixels at most, 58 MB), so one
    fits one worker; regions of another size than their first frame's, and those without a layer, give no rows."""
    import pandas as pd

    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        h, w = int(pdf.h.iloc[0]), int(pdf.w.iloc[0])
        if (pdf.rgb.str.len() != h * w * 3).any():
            return pd.DataFrame()
        layer = estimate(np.stack([np.frombuffer(x, np.uint8).reshape(h, w, 3) for x in pdf.rgb]))
        if layer is None:
            return pd.DataFrame()
        y, x = np.mgrid[0:h, 0:w]
        d = fill_distances(layer.fill)
        cells = {"y": y, "x": x, "cr": layer.colour[..., 0], "cg": layer.colour[..., 1], "cb": layer.colour[..., 2], "alpha": layer.alpha, "fill": layer.fill, "dl": d[0], "dr": d[1], "du": d[2], "dd": d[3]}
        out = pd.DataFrame({k: np.ravel(v) for k, v in cells.items()})
        return out.assign(**dict(zip(keys, key)), reason=layer.reason, present=len(layer.present), motion=layer.motion, components=layer.components)[[*keys, *(c.split()[0] for c in LAYER_DDL.split(", "))]]

    return frames.select(*keys, "t", "w", "h", "rgb").groupBy(*keys).applyInPandas(run, f"{kinds}, {LAYER_DDL}")


def map_regions(rows, keys: list[str], kernel, names: tuple[str, ...] = ("v",)):
    """Applies kernel(array of the named columns) -> array (h, w) to every region: keys, y, x, v."""
    import pandas as pd

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = kernel(*np.moveaxis(_grid(pdf, list(names)), -1, 0))
        y, x = np.mgrid[0 : got.shape[0], 0 : got.shape[1]]
        return pd.DataFrame({**{k: [v] * y.size for k, v in zip(keys, key)}, "y": y.ravel(), "x": x.ravel(), "v": got.ravel().astype(float)})

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, y int, x int, v double")
