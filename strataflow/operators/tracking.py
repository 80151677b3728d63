"""Where an overlay sits in a frame: regression on the pairs of pixels across its edges, or a match of its
opaque pixels and the ring around them. Offsets (dy, dx) are those at which the frame has to be read so that the
overlay comes to lie where it was analysed; reads beyond the border don't count and never wrap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .solvers import dilate, nearest_clean

# Caps and weights of the template score; search range, least scores and margins of the analysis.
CAP, TAU, CORE_WEIGHT, LEAST_RING = 0.25, 0.10, 0.6, 8
TEMPLATE_MAD, TEMPLATE_LEAST = 0.06, 40
REACH, TAP_SCORE, TAP_MARGIN, TAP_ALPHA, TAP_STEP = 16, 0.45, 0.15, 0.15, 0.02
TEMPLATE_SCORE, TEMPLATE_MARGIN = 0.45, 0.08
#: Points that the whole window is searched with; the best offsets are scored again with all of them.
THIN, AGAIN = 300, 16


def median_mad(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and scaled median deviation over the first axis."""
    m = np.median(x, axis=0)
    return m, np.median(np.abs(x - m), axis=0) * 1.4826


@dataclass
class Template:
    values: np.ndarray  # (h, w, 3), meant where support is
    support: np.ndarray
    ring: np.ndarray

    def __post_init__(self) -> None:
        self.core_mean = self.values[self.support].mean(axis=0)
        self._core, self._ring = np.argwhere(self.support), np.argwhere(self.ring)

    def scores(self, image: np.ndarray, offsets: np.ndarray, thin: int = 1) -> np.ndarray:
        """Score of each offset: agreement of the core, and how the ring differs from the core's mean colour."""
        core, ring = self._core[::thin], self._ring[::thin]
        cost, n = _capped_cost(image, core, self.values[core[:, 0], core[:, 1]], offsets)
        agreement = 1 - cost / TAU
        score = np.clip(agreement, -1, 1)
        cost, around = _capped_cost(image, ring, np.broadcast_to(self.core_mean, (len(ring), 3)), offsets)
        with_ring = CORE_WEIGHT * score + (1 - CORE_WEIGHT) * np.clip(cost / TAU, 0, 1)
        score = np.where(around * thin >= LEAST_RING, with_ring, score)
        return np.where(n >= len(core) // 2, score, -1.0)

    def thin(self) -> int:
        return max(1, len(self._core) // THIN)


def _capped_cost(image: np.ndarray, points: np.ndarray, want: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean capped difference and count of the points that fall into the image, for every offset."""
    h, w = image.shape[:2]
    cost, count = np.ones(len(offsets)), np.zeros(len(offsets), np.int64)
    step = max(1, 400_000 // max(1, len(points)))
    for lo in range(0, len(offsets), step):
        at = points[None] + offsets[lo : lo + step, None]
        ok = (at >= 0).all(-1) & (at[..., 0] < h) & (at[..., 1] < w)
        flat = np.clip(at[..., 0], 0, h - 1) * w + np.clip(at[..., 1], 0, w - 1)
        d = np.minimum(np.abs(image.reshape(-1, 3)[flat] - want).sum(-1) / 3, CAP)
        count[lo : lo + step] = ok.sum(1)
        cost[lo : lo + step] = np.where(ok, d, 0).sum(1) / np.maximum(1, ok.sum(1))
    return cost, count


def build_template(v: np.ndarray, mask: np.ndarray, fill: np.ndarray) -> Template | None:
    """Median colours of the fill pixels that hardly change, and the ring just outside the mask; None with too few."""
    values = np.zeros((*fill.shape, 3))
    support = np.zeros(fill.shape, bool)
    if fill.any():
        values[fill], spread = median_mad(v[:, fill])
        support[fill] = spread.max(-1) <= TEMPLATE_MAD
    return Template(values, support, dilate(mask) & ~mask) if support.sum() >= TEMPLATE_LEAST else None


@dataclass
class Taps:
    """Pairs of neighbours p, q with what the overlay adds between them, and a clean pixel n that stands for the scene."""

    p: np.ndarray
    q: np.ndarray
    n: np.ndarray
    da: np.ndarray
    dc: np.ndarray

    def __len__(self) -> int:
        return len(self.da)

    def of(self, keep: np.ndarray) -> Taps:
        return Taps(self.p[keep], self.q[keep], self.n[keep], self.da[keep], self.dc[keep])

    def sums(self, image: np.ndarray, offsets: np.ndarray, flat_taps: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of observed x expected, expected squared and observed squared differences for every offset."""
        h, w = image.shape[:2]
        pixels = image.reshape(-1, 3)
        out = np.zeros((3, len(offsets)))
        step = max(1, 200_000 // max(1, len(self)))
        for lo in range(0, len(offsets), step):
            places, ok = [], np.ones((len(offsets[lo : lo + step]), len(self)), bool)
            for points in (self.p, self.q, self.n):
                at = points[None] + offsets[lo : lo + step, None]
                ok &= (at >= 0).all(-1) & (at[..., 0] < h) & (at[..., 1] < w)
                places.append(np.clip(at[..., 0], 0, h - 1) * w + np.clip(at[..., 1], 0, w - 1))
            if not flat_taps:
                ok &= self.da != 0
            expected = (self.dc - pixels[places[2]] * self.da[:, None]) * ok[..., None]
            observed = (pixels[places[1]] - pixels[places[0]]) * ok[..., None]
            out[:, lo : lo + step] = (observed * expected).sum((1, 2)), (expected**2).sum((1, 2)), (observed**2).sum((1, 2))
        return out[0], out[1], out[2]

    def presence(self, image: np.ndarray) -> float:
        """About 1 with the overlay and 0 without."""
        num, den, _ = self.sums(image, np.zeros((1, 2), int), flat_taps=True)
        return float(np.clip(num[0] / den[0], -1, 2)) if den[0] > 1e-3 else 1.0

    def regression(self, image: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        num, den, _ = self.sums(image, offsets)
        return np.where(den > 1e-3, num / np.maximum(den, 1e-3), -1.0)

    def correlation(self, image: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        num, den, seen = self.sums(image, offsets)
        return np.where(den * seen > 1e-4, num / np.sqrt(np.maximum(den * seen, 1e-4)), -1.0)


def _pairs(colour: np.ndarray, alpha: np.ndarray, mask: np.ndarray) -> Taps:
    """Every pair of horizontal and vertical neighbours."""
    h, w = mask.shape
    flat = np.arange(h * w).reshape(h, w)
    p = np.concatenate([flat[:, :-1].ravel(), flat[:-1].ravel()])
    q = np.concatenate([flat[:, 1:].ravel(), flat[1:].ravel()])
    a, c = alpha.ravel(), colour.reshape(-1, 3)
    n = nearest_clean(mask)[np.where(a[p] >= a[q], p, q)]
    places = [np.stack(np.divmod(x, w), -1) for x in (p, q, n)]
    return Taps(*places, a[q] - a[p], c[q] - c[p])


def presence_taps(colour: np.ndarray, alpha: np.ndarray, mask: np.ndarray, most: int = 3000, least: float = 0.01) -> Taps:
    """The pairs that the overlay makes differ most."""
    taps = _pairs(colour, alpha, mask)
    size = np.abs(taps.dc - 0.5 * taps.da[:, None]).max(-1)
    touches = mask[tuple(taps.p.T)] | mask[tuple(taps.q.T)]
    order = np.argsort(-size, kind="stable")
    return taps.of(order[(touches & (size >= least))[order]][:most])


def border_taps(colour: np.ndarray, alpha: np.ndarray, mask: np.ndarray) -> Taps:
    """Pairs across the overlay's border where it is strong."""
    taps = _pairs(colour, alpha, mask)
    ap, aq = alpha[tuple(taps.p.T)], alpha[tuple(taps.q.T)]
    across = mask[tuple(taps.p.T)] != mask[tuple(taps.q.T)]
    strong = (np.maximum(ap, aq) >= TAP_ALPHA) & (np.abs(taps.da) >= TAP_ALPHA * 0.5) & (np.abs(taps.dc).max(-1) >= TAP_STEP)
    return taps.of(np.flatnonzero(across & strong))


def window(reach: int) -> np.ndarray:
    """All offsets within reach, the nearest first, so that ties go to the smaller one."""
    d = np.stack(np.mgrid[-reach : reach + 1, -reach : reach + 1], -1).reshape(-1, 2)
    return d[np.lexsort((d[:, 1], d[:, 0], np.abs(d).sum(1)))]


def search(scores: Callable[[np.ndarray, int], np.ndarray], reach: int, thin: int) -> tuple[np.ndarray, float]:
    """The best offset of the window and its score: all offsets thinned out, the best of them again whole."""
    offsets = window(reach)
    got = scores(offsets, thin)
    if thin > 1:
        offsets = offsets[np.sort(np.argsort(-got, kind="stable")[:AGAIN])]
        got = scores(offsets, 1)
    k = int(got.argmax())
    return offsets[k], float(got[k])


def tap_offset(taps: Taps, image: np.ndarray) -> np.ndarray:
    """Offset of the overlay in a frame; zero where nothing scores, at the edge of the window, or without a clear gain."""
    thin = max(1, len(taps) // THIN)
    score = lambda d, k: taps.of(np.arange(0, len(taps), k)).correlation(image, d)
    best, top = search(score, REACH, thin)
    zero = float(score(np.zeros((1, 2), int), 1)[0])
    found = top >= TAP_SCORE and np.abs(best).max() < REACH and (not best.any() or top > zero + TAP_MARGIN)
    return best if found else np.zeros(2, int)


def template_offset(t: Template, image: np.ndarray) -> tuple[np.ndarray, float]:
    """Offset and score of a template in a frame; zero and 0 where it isn't found."""
    best, top = search(lambda d, k: t.scores(image, d, k), REACH, t.thin())
    zero = float(t.scores(image, np.zeros((1, 2), int))[0])
    found = top >= TEMPLATE_SCORE and np.abs(best).max() < REACH and (not best.any() or top > zero + TEMPLATE_MARGIN)
    return (best, top) if found else (np.zeros(2, int), 0.0)


def shift(image: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The frame read at (y + dy, x + dx), clamped at each border."""
    h, w = image.shape[:2]
    return image[np.clip(np.arange(h) + offset[0], 0, h - 1)][:, np.clip(np.arange(w) + offset[1], 0, w - 1)]
