"""Second looks at an estimated layer: its faint fringe, and its opacity from how much it damps the scene."""

from __future__ import annotations

import numpy as np

from . import solvers
from .components import label_mask

# Limits of the fringe and of the temporal regression.
BAND, FRINGE, LEAST_ALPHA, SPECK = 3, 0.2, 0.02, 3
MIN_FRAMES, MAX_DISTANCE, MIN_GAMMA, MIN_VARIANCE, PAIRS = 8, 12, 0.55, 4e-4, 48
MIN_PIXELS, EVIDENCE, MAX_SCALE, SMALL_SCALE, FRINGE_GAIN, MAX_DRIFT, SMALL_DRIFT = 12, 24.0, 0.25, 0.02, 0.6, 0.15, 0.005


def band_labels(labels: np.ndarray, width: int = BAND) -> np.ndarray:
    """Labels of the pixels within so many 4-connected steps outside, each from a neighbour one step nearer; 0 elsewhere."""
    now = labels.copy()
    for _ in range(width):
        p = np.pad(now, 1)
        near = np.max([p[1:-1, :-2], p[1:-1, 2:], p[:-2, 1:-1], p[2:, 1:-1]], axis=0)
        now = np.where(now > 0, now, near)
    return np.where(labels > 0, 0, now)


def soft_edges(median, labels, strength, alpha, colour, fill, own, opacity, most: float) -> np.ndarray:
    """Faint pixels of the mask and a band around it get their opacity from the projection of the median on the
    direction of their component's colour. Changes alpha, colour and fill; returns the labels with the band's
    accepted pixels."""
    mask = labels > 0
    band = band_labels(labels)
    target = (mask & (strength < FRINGE)) | (band > 0)
    whose = np.where(mask, labels, band)
    ground = solvers.harmonic_fill(median, mask | (band > 0))
    k = whose[target]
    d = own[k] - ground[target]
    den = (d * d).sum(-1)
    a = np.where(den > 0.01, ((median[target] - ground[target]) * d).sum(-1) / np.maximum(den, 1e-9), -1)
    found = np.full(mask.shape, -1.0)
    found[target] = np.where(a < 0, a, np.minimum(a, np.minimum(most, opacity[k] + 0.05)))
    taken = found >= LEAST_ALPHA
    pieces = label_mask(taken)
    taken &= np.bincount(pieces.ravel())[pieces] >= SPECK
    gone = mask & target & ~taken & ~fill
    taken &= ~(fill & (found >= most - 0.05))  # nearly opaque fills stay fills
    fill &= ~taken
    alpha[taken] = found[taken]
    colour[taken] = np.clip(found[taken][:, None] * own[whose[taken]], 0, np.minimum(1, found[taken] + 0.02)[:, None])
    alpha[gone] = 0
    colour[gone] = 0
    return np.where(taken & ~mask, band, labels)


def _references(mask: np.ndarray) -> np.ndarray:
    """Flat indices (5, pixels) of the clean pixels left, right, above, below and nearest; -1 where there is none."""
    h, w = mask.shape
    out = np.full((5, h, w), -1)
    flat = np.arange(h * w).reshape(h, w)
    for k, (axis, back) in enumerate(((1, False), (1, True), (0, False), (0, True))):
        m = np.flip(mask, axis) if back else mask
        place = np.arange(m.shape[axis]).reshape((-1, 1) if axis == 0 else (1, -1))
        last = np.maximum.accumulate(np.where(m, -1, place), axis=axis)
        last = np.flip(last, axis) if back else last
        last = np.where(last >= 0, m.shape[axis] - 1 - last if back else last, -1)
        there = flat[last, np.arange(w)[None, :]] if axis == 0 else flat[np.arange(h)[:, None], last]
        out[k] = np.where(last >= 0, there, -1)
    out[4] = solvers.nearest_clean(mask).reshape(h, w)
    return out.reshape(5, -1)


def _moments(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances and covariance over the first axis."""
    ma, mb = a.mean(0), b.mean(0)
    return (a * a).mean(0) - ma * ma, (b * b).mean(0) - mb * mb, (a * b).mean(0) - ma * mb


def pair_correlations(v: np.ndarray, mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of every offset (dy, dx): the median correlation in time of clean pixels that far apart, per channel. Pairs
    are drawn by a hash of place and offset."""
    h, w = mask.shape
    clean = ~mask
    pixels = v.reshape(len(v), -1, 3)
    out = np.zeros((len(offsets), 3))
    for k, (dy, dx) in enumerate(offsets.tolist()):
        y0, y1, x0, x1 = max(0, -dy), h - max(0, dy), max(0, -dx), w - max(0, dx)
        if y0 >= y1 or x0 >= x1:
            continue
        both = clean[y0:y1, x0:x1] & clean[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
        ys, xs = np.nonzero(both)
        if len(ys) > PAIRS:
            mark = (ys * 92821 + xs * 68917 + dy * 31 + dx * 7) * np.int64(2654435761) & 0xFFFFFFFF
            pick = np.argpartition(mark, PAIRS)[:PAIRS]
            ys, xs = ys[pick], xs[pick]
        first = (ys + y0) * w + xs + x0
        va, vb, cov = _moments(pixels[:, first], pixels[:, first + dy * w + dx])
        for c in range(3):
            ok = (va[:, c] >= MIN_VARIANCE) & (vb[:, c] >= MIN_VARIANCE)
            if ok.sum() >= 4:
                out[k, c] = np.clip(np.median(cov[ok, c] / np.sqrt(va[ok, c] * vb[ok, c])), 0, 1)
    return out


def damping(v: np.ndarray, mask: np.ndarray, invert: np.ndarray) -> np.ndarray:
    """Opacity of the inverted pixels from the slope of their values on clean references, over the correlation that
    clean pixels so far apart have; -1 where no reference tells."""
    h, w = mask.shape
    p = np.flatnonzero(invert.ravel())
    refs = _references(mask)[:, p]
    pixels = v.reshape(len(v), -1, 3)
    dy, dx = p // w - refs // w, p % w - refs % w
    used = (refs >= 0) & (refs != p) & (dy * dy + dx * dx <= MAX_DISTANCE**2)
    keys, inverse = np.unique(np.stack([dy[used], dx[used]], -1), axis=0, return_inverse=True) if used.any() else (np.zeros((0, 2), int), np.zeros(0, int))
    gamma = np.zeros((*refs.shape, 3))
    gamma[used] = pair_correlations(v, mask, keys)[inverse.ravel()] if len(keys) else 0
    num, den = np.zeros(len(p)), np.zeros(len(p))
    for k in range(5):
        ix = np.flatnonzero(used[k])
        var, _, cov = _moments(pixels[:, refs[k, ix]], pixels[:, p[ix]])
        g = gamma[k, ix]
        ok = (g >= MIN_GAMMA) & (var >= MIN_VARIANCE)
        weight = np.where(ok, g * g * var, 0)
        a = np.clip(1 - np.where(ok, cov / np.where(ok, var * g, 1), 1), 0, 1)
        num[ix] += (a * weight).sum(-1)
        den[ix] += weight.sum(-1)
    out = np.full(h * w, -1.0)
    out[p] = np.where(den > 0, num / np.maximum(den, 1e-12), -1)
    return out.reshape(h, w)


def regress(v, labels, alpha, colour, fill, most: float) -> None:
    """Rescales each component's opacity by the damping of its core, and moves its fringe pixels towards their own."""
    mask = labels > 0
    if len(v) < MIN_FRAMES or (~mask).sum() < 4 * MAX_DISTANCE:
        return
    usable = mask & ~fill & (alpha > 0)
    if not usable.any():
        return
    seen = damping(v, mask, usable)

    def move(where: np.ndarray, to: np.ndarray) -> None:
        ratio = to / alpha[where]
        colour[where] = np.clip(colour[where] * ratio[:, None], 0, (to + 0.02)[:, None])
        alpha[where] = to

    fringe = np.full(labels.max() + 1, np.inf)
    for k in range(1, labels.max() + 1):
        part = usable & (labels == k)
        if part.sum() < MIN_PIXELS:
            continue
        ordered = np.sort(alpha[part])
        fringe[k] = max(0.5 * ordered[min(len(ordered) - 1, int(len(ordered) * 0.9))], 0.12)
        core = part & (seen >= 0) & (alpha >= fringe[k])
        if core.sum() < MIN_PIXELS // 2:
            continue
        share = core.sum() / (core.sum() + EVIDENCE)
        scale = 1 + share * np.clip(np.median(seen[core] / alpha[core]) - 1, -MAX_SCALE, MAX_SCALE)
        if abs(scale - 1) >= SMALL_SCALE:
            move(part, np.clip(alpha[part] * scale, 0.02, most))
    faint = usable & (seen >= 0) & (alpha < fringe[labels])
    to = np.clip(alpha + FRINGE_GAIN * np.clip(seen - alpha, -MAX_DRIFT, MAX_DRIFT), 0.02, most)
    faint &= np.abs(to - alpha) >= SMALL_DRIFT
    move(faint, to[faint])
