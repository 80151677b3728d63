"""Numeric kernels for one bounded image region: Poisson and Laplace solvers, floods, patch synthesis.

They run inside grouped functions; sweeps are red-black, so they are whole-array operations and don't
depend on a pixel order.
"""

from __future__ import annotations

import numpy as np


def sine_basis(n: int) -> np.ndarray:
    k = np.arange(1, n + 1)
    return np.sin(np.pi * np.outer(k, k) / (n + 1))


def poisson(f: np.ndarray) -> np.ndarray:
    """Exact u with lap(u) = f and u = 0 beyond the border, by sine transforms of rows and columns."""
    h, w = f.shape
    rows, cols = sine_basis(h), sine_basis(w)
    lam = (2 * np.cos(np.pi * np.arange(1, h + 1) / (h + 1)) - 2)[:, None] + (2 * np.cos(np.pi * np.arange(1, w + 1) / (w + 1)) - 2)[None, :]
    return rows @ ((rows @ f @ cols) / lam) @ cols * 4 / ((h + 1) * (w + 1))


def _neighbours(u: np.ndarray, mode: str) -> np.ndarray:
    p = np.pad(u, [(1, 1), (1, 1)] + [(0, 0)] * (u.ndim - 2), mode=mode)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]


def _relax(u: np.ndarray, mask: np.ndarray, rhs: np.ndarray, mode: str, sweeps: int, tolerance: float) -> np.ndarray:
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return u
    h, w = mask.shape
    box = slice(max(0, ys.min() - 1), min(h, ys.max() + 2)), slice(max(0, xs.min() - 1), min(w, xs.max() + 2))
    if (box[0].stop - box[0].start, box[1].stop - box[1].start) != (h, w):  # beyond, nothing is read or changed
        if mode == "edge" or not (ys.min() == 0 or xs.min() == 0 or ys.max() == h - 1 or xs.max() == w - 1):
            out = u.copy()
            out[box] = _relax(u[box], mask[box], rhs[box], mode, sweeps, tolerance)
            return out
    extent = max(ys.max() - ys.min(), xs.max() - xs.min()) + 1
    omega = 2 / (1 + np.sin(np.pi / (extent + 1)))
    parity = np.add.outer(np.arange(u.shape[0]), np.arange(u.shape[1])) % 2
    shape = mask.shape + (1,) * (u.ndim - 2)
    colours = [(mask & (parity == k)).reshape(shape) for k in (0, 1)]
    for _ in range(sweeps):
        most = 0.0
        for colour in colours:
            step = np.where(colour, omega * ((_neighbours(u, mode) - rhs) / 4 - u), 0)
            u = u + step
            most = max(most, float(np.abs(step).max()))
        if most < tolerance:
            break
    return u


def masked_poisson(f: np.ndarray, mask: np.ndarray, sweeps: int = 900, tolerance: float = 1e-5) -> np.ndarray:
    """lap(u) = f on the mask, u = 0 off it."""
    return _relax(np.zeros_like(f, float), mask, np.where(mask.reshape(mask.shape + (1,) * (f.ndim - 2)), f, 0), "constant", sweeps, tolerance)


def harmonic_fill(data: np.ndarray, mask: np.ndarray, sweeps: int = 900, tolerance: float = 1e-4) -> np.ndarray:
    """data with the masked pixels interpolated harmonically from the others; the border is replicated."""
    out = data.astype(float).copy()
    clean = ~mask
    out[mask] = out[clean].mean(axis=0) if clean.any() else 0
    return _relax(out, mask, np.zeros_like(out), "edge", sweeps, tolerance)


def flood(open_: np.ndarray, seeds: np.ndarray, steps: int | None = None) -> np.ndarray:
    """Pixels of open_ that 4-connected paths from the seeds reach, in a number of steps at most."""
    reached = seeds & open_
    k = 0
    while steps is None or k < steps:
        grown = reached.copy()
        grown[1:] |= reached[:-1]
        grown[:-1] |= reached[1:]
        grown[:, 1:] |= reached[:, :-1]
        grown[:, :-1] |= reached[:, 1:]
        grown &= open_
        if (grown == reached).all():
            break
        reached, k = grown, k + 1
    return reached


def fill_holes(mask: np.ndarray) -> np.ndarray:
    border = np.zeros_like(mask)
    border[[0, -1]] = True
    border[:, [0, -1]] = True
    return ~flood(~mask, border)


def dilate(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    return np.any([p[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)


def fill_distances(fill: np.ndarray) -> np.ndarray:
    """Steps left, right, up and down to the first pixel that isn't fill; 255 at most, 0 off the fill."""
    out = np.zeros((4, *fill.shape), np.int32)
    for k, (axis, back) in enumerate(((1, False), (1, True), (0, False), (0, True))):
        f = np.flip(fill, axis) if back else fill
        place = np.arange(f.shape[axis]).reshape((-1, 1) if axis == 0 else (1, -1))
        last = np.maximum.accumulate(np.where(f, -1, place), axis=axis)
        d = np.where(f, np.where(last >= 0, np.minimum(place - last, 255), 255), 0)
        out[k] = np.flip(d, axis) if back else d
    return out


def soft_band(mask: np.ndarray, width: int = 3) -> np.ndarray:
    """Pixels within so many 4-connected steps outside the mask."""
    return flood(np.ones_like(mask), mask, width) & ~mask


def nearest_clean(mask: np.ndarray) -> np.ndarray:
    """Flat index of the nearest unmasked pixel by 4-connected steps; its own where all are masked. Among equally
    near ones the one counts whose wave arrives first: waves start in raster order and spread left, right, up, down."""
    h, w = mask.shape
    out = np.arange(h * w)
    if mask.all():
        return out
    seen = ~mask.ravel()
    front = np.flatnonzero(seen)
    while len(front):
        y, x = np.divmod(front, w)
        to = np.stack([np.where(x > 0, front - 1, -1), np.where(x < w - 1, front + 1, -1), np.where(y > 0, front - w, -1), np.where(y < h - 1, front + w, -1)], -1).ravel()
        origin = np.repeat(out[front], 4)
        open_ = (to >= 0) & ~seen[np.maximum(to, 0)]
        to, origin = to[open_], origin[open_]
        _, first = np.unique(to, return_index=True)
        first.sort()
        front = to[first]
        out[front] = origin[first]
        seen[front] = True
    return out


def _draws(p: int, n: int, below: int) -> np.ndarray:
    """n numbers under ``below`` that depend on p alone."""
    x = (np.uint64(p * n) + np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(below)).astype(int)


def patch_fill(image: np.ndarray, hole: np.ndarray, radius: int = 3, grid: int = 96, drawn: int = 20, least: int = 18, shift: float = 0.35, base: np.ndarray | None = None) -> np.ndarray:
    """Edge-first synthesis: hole pixels, in the order of their least distance to the border of the hole in a row or
    column, copy the donor whose known
    surroundings differ least from theirs. Donors are the neighbours' donors, a fixed grid over all clean
    pixels and some drawn by hash for each pixel; one too far from the harmonic colour (or from ``base``) is not taken."""
    h, w = hole.shape
    base = harmonic_fill(image, hole) if base is None else base
    out, known = base.copy(), ~hole
    clean = np.flatnonzero((~hole).ravel())
    step = max(1, len(clean) // grid)
    donors = clean[::step]
    source = np.full(h * w, -1)
    depth = fill_distances(hole).min(axis=0).ravel()
    oy, ox = (o.ravel() for o in np.mgrid[-radius : radius + 1, -radius : radius + 1])
    for p in sorted(np.flatnonzero(hole.ravel()).tolist(), key=lambda p: (depth[p], p)):
        y, x = divmod(p, w)
        near = [source[q] + p - q for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0)) if 0 <= y + dy < h and 0 <= x + dx < w and source[q := (y + dy) * w + x + dx] >= 0]
        tried = np.concatenate([np.array(near, int), donors, clean[_draws(p, drawn, len(clean))] if len(clean) else clean])
        tried = tried[(tried >= 0) & (tried < h * w)]
        tried = tried[~hole.ravel()[tried]]
        ty, tx = y + oy, x + ox
        seen = (ty >= 0) & (ty < h) & (tx >= 0) & (tx < w)
        seen[seen] = known[ty[seen], tx[seen]]
        sy, sx = (tried // w)[:, None] + oy[seen], (tried % w)[:, None] + ox[seen]
        ok = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
        sy, sx = np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)
        ok &= ~hole[sy, sx]
        n = ok.sum(axis=1)
        d = np.abs(out[ty[seen], tx[seen]] - image[sy, sx]).mean(axis=-1)
        cost = np.where(n >= least, np.where(ok, d, 0).sum(axis=1) / np.maximum(n, 1), np.inf)
        best = int(tried[cost.argmin()]) if len(cost) and np.isfinite(cost.min()) else -1
        if best >= 0 and np.abs(image[divmod(best, w)] - base[y, x]).max() <= shift:
            out[y, x] = image[divmod(best, w)]
            source[p] = best
        known[y, x] = True
    return out


def mirror_fill(image: np.ndarray, zone: tuple[int, int, int, int]) -> np.ndarray:
    """Rectangle (y0, x0, y1, x1; ends excluded) from copies mirrored at its four edges, each weighted by the
    inverse square of the distance to its edge; edges at the border of the image give none."""
    h, w = image.shape[:2]
    y0, x0, y1, x1 = zone
    y, x = np.mgrid[y0:y1, x0:x1]
    total, weight = np.zeros((y1 - y0, x1 - x0, *image.shape[2:])), np.zeros(y.shape)
    for sy, sx, d in ((2 * y0 - 1 - y, x, y - y0 + 1), (2 * y1 - 1 - y, x, y1 - y), (y, 2 * x0 - 1 - x, x - x0 + 1), (y, 2 * x1 - 1 - x, x1 - x)):
        ok = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
        k = np.where(ok, 1.0 / d**2, 0.0)
        total += image[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)] * k.reshape(k.shape + (1,) * (image.ndim - 2))
        weight += k
    out = image.astype(float).copy()
    there = weight > 0
    filled = total / np.maximum(weight, 1e-12).reshape(weight.shape + (1,) * (image.ndim - 2))
    out[y0:y1, x0:x1][there] = filled[there]
    return out
