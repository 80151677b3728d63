"""Frame-by-frame restoration with bounded state, in presentation order.

Of every frame the overlay's place is found first (by the pairs across its edges, or by a template where it is
opaque) and the frame shifted, so that the overlay lies where it was analysed. Translucent pixels are un-blended,
fills start from a harmonic surface kept warm between frames. Then uncertain pixels take what is known better: the
previous restored frame carried along the scene's motion, which also teaches what the un-blending gets wrong; a ring
of earlier pictures; a synthesis from the region itself in scenes that never move; and the texture of the nearest
clean pixels. Each value has a confidence, the inverse of its variance.

A key's state is one binary value of bounded size. A picture enters the ring once the scene has moved
``PUSH_TRAVEL`` pixels on an axis since the last one or after ``PUSH_GAP`` frames, so that slow scenes are
remembered far back. The same core serves batches (rows in order of key and time) and streams (a keyed stateful
operator). A frame older than the last one starts a new clip: all but the learned error is cleared, nothing is
dropped or buffered.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import solvers, tracking
from ..operators.layers import INVERT, Layer

# Confidences, search ranges and limits of the restoration.
NOISE, HOP, CLEAN, FILL, MOST, SYNTHESIS, TEXTURE = 0.02, 0.012, 10_000.0, 1 / 0.12**2, 8_000.0, 100.0, 250.0
SEARCH, MAX_ERROR, LEAST_TEMPLATE, SAMPLE, REFINE_DELTA = 24, 0.06, 60, 2500, 1.5
SOURCE, STRONG, DONE = 600.0, 2_600.0, 3_000.0
LEARN_FROM, LEARN_LEAST, LEARN_MOST, LEARN_CAP = 2_000.0, 2_500.0, 200_000.0, 0.3
TAP_REACH, TAP_ALPHA, TAPS_LEAST, TAP_SHARE, TAP_SCORE = 16, 0.08, 6, 0.50, 0.45
TEMPLATE_REACH, TEMPLATE_SCORE, TEMPLATE_LEAST, TEMPLATE_SPAN, MARGIN, JUMP = 24, 0.55, 150, 0.5, 0.08, 2
PUSH_TRAVEL, PUSH_GAP, STILL = 2.5, 24, 8.0
SWEEPS_COLD, SWEEPS_WARM, TEXTURE_RANGE, TEXTURE_CAP = 26, 18, 0.30, 0.12
TONES, TONE_VARIANCE = (0.6, 1.6), 1e-4


def depth_for(pixels: int) -> int:
    return 14 if pixels <= 40_000 else 10 if pixels <= 100_000 else 6


def encode_weight(w: np.ndarray) -> np.ndarray:
    """Confidence as a byte on a logarithmic scale."""
    return np.where(w <= 1, 0, np.clip(np.floor(32 * np.log10(np.maximum(w, 1)) + 0.5), 1, 255)).astype(np.uint8)


DECODED = np.where(np.arange(256) == 0, 0, 10 ** (np.arange(256) / 32))


def _fast(n: int) -> int:
    """The next size whose factors are 2, 3 and 5."""
    while True:
        m = n
        for f in (2, 3, 5):
            while m % f == 0:
                m //= f
        if m == 1:
            return n
        n += 1


class Matcher:
    """Deviation of the luminance difference of two frames at every shift within ``SEARCH``, over pixels that are
    clean in both, by Fourier transforms of the masked values and squares."""

    def __init__(self, clean: np.ndarray) -> None:
        self.clean = clean.astype(float)
        h, w = clean.shape
        self.size = _fast(h + SEARCH + 1), _fast(w + SEARCH + 1)
        self.mask = np.fft.rfft2(self.clean, self.size)
        self.count = self._window(np.fft.irfft2(self.mask * np.conj(self.mask), self.size))
        self.least = max(self.clean.sum() / 3, LEAST_TEMPLATE / 2)

    def _window(self, full: np.ndarray) -> np.ndarray:
        ix = np.arange(-SEARCH, SEARCH + 1)
        return full[np.ix_(ix % self.size[0], ix % self.size[1])]

    def ready(self, lum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (lum - 0.5) * self.clean
        return np.fft.rfft2(x, self.size), np.fft.rfft2(x * x, self.size)

    def errors(self, now: tuple[np.ndarray, np.ndarray], base: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Index (SEARCH + dy, SEARCH + dx): now(y, x) against base(y - dy, x - dx); infinite with too few pixels."""
        m = np.conj(self.mask)
        one = self._window(np.fft.irfft2(now[0] * m - self.mask * np.conj(base[0]), self.size))
        two = self._window(np.fft.irfft2(now[1] * m - 2 * now[0] * np.conj(base[0]) + self.mask * np.conj(base[1]), self.size))
        n = np.maximum(self.count, 1)
        error = np.sqrt(np.maximum(two / n - (one / n) ** 2, 0))
        return np.where(self.count >= self.least, error, np.inf)


def _peak(a: float, e: float, b: float) -> float:
    d = a - 2 * e + b
    return float(np.clip(0.5 * (a - b) / d, -0.5, 0.5)) if np.isfinite(d) and d > 1e-6 else 0.0


def best_shift(errors: np.ndarray, limit: float = MAX_ERROR) -> tuple[np.ndarray, float] | None:
    """(dy, dx) of the least error to fractions of a pixel, and the error; None above the limit."""
    y, x = np.mgrid[-SEARCH : SEARCH + 1, -SEARCH : SEARCH + 1]
    k = np.lexsort(((np.abs(y) + np.abs(x)).ravel(), np.round(errors, 9).ravel()))[0]
    i, j = np.unravel_index(k, errors.shape)
    e = float(errors[i, j])
    if not e <= limit:
        return None
    at = np.pad(errors, 1, constant_values=np.inf)
    return np.array([i - SEARCH + _peak(at[i, j + 1], e, at[i + 2, j + 1]), j - SEARCH + _peak(at[i + 1, j], e, at[i + 1, j + 2])]), e


class _Samples:
    """Bilinear reads at fractional places (flat pixel indices minus a shift) that lie in the image."""

    def __init__(self, pixels: np.ndarray, shape: tuple[int, int], shift: np.ndarray) -> None:
        h, w = shape
        y, x = pixels // w - shift[0], pixels % w - shift[1]
        self.ok = (y >= 0) & (x >= 0) & (y <= h - 1) & (x <= w - 1)
        y, x = y[self.ok], x[self.ok]
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        fy, fx = y - y0, x - x0
        y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
        self.at = np.stack([y0 * w + x0, y0 * w + x1, y1 * w + x0, y1 * w + x1])
        self.share = np.stack([(1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx])

    def read(self, flat: np.ndarray, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Values at the places, or at some of them."""
        out = 0
        for at, share in zip(self.at, self.share):
            share = share[of]
            out = out + flat[at[of]] * (share if flat.ndim == 1 else share[:, None])
        return out


class Restorer:
    def __init__(self, layer: Layer) -> None:
        self.layer = layer
        self.shape = h, w = layer.alpha.shape
        self.mask = layer.mask
        self.masked = np.flatnonzero(self.mask.ravel())
        clean = np.flatnonzero(~self.mask.ravel())
        self.sample = clean[:: max(1, -(-len(clean) // SAMPLE))]
        self.translucent = self.mask & ~layer.fill & (layer.alpha > 0)
        self.filled = np.flatnonzero((self.mask & layer.fill).ravel())
        self.depth = depth_for(layer.alpha.size)
        self.taps = tracking.presence_taps(layer.colour, layer.alpha, self.mask) if self.mask.any() else None
        strong = (np.abs(self.taps.da) >= TAP_ALPHA).sum() if self.taps else 0
        self.by_taps = bool((layer.alpha > 0).sum() >= TAP_SHARE * self.mask.sum() and strong >= TAPS_LEAST)
        self.by_template = not self.by_taps and self._distinct()
        self.matcher = Matcher(~self.mask) if (~self.mask).sum() >= LEAST_TEMPLATE else None
        if len(self.filled):
            y, x = np.divmod(self.filled, w)
            near = [np.where(x > 0, -1, 0), np.where(x < w - 1, 1, 0), np.where(y > 0, -w, 0), np.where(y < h - 1, w, 0)]
            self.around = np.stack([self.filled + d for d in near])
            self.colours = [np.flatnonzero((y + x) % 2 == k) for k in (0, 1)]
            self.far = solvers.fill_distances(layer.fill).reshape(4, -1)[:, self.filled]
            self.donors = self.filled + np.array([-1, 1, -w, w])[:, None] * self.far
        self.error_sum, self.error_weight = np.zeros((h * w, 3)), np.zeros(h * w)
        self.reset()

    def _distinct(self) -> bool:
        """Whether the template is large enough, and spans enough of the mask, to be told from other places."""
        t = self.layer.template
        if t is None or t.support.sum() < TEMPLATE_LEAST:
            return False
        span = lambda m: np.ptp(np.argwhere(m), axis=0) + 1
        return bool((span(t.support) >= TEMPLATE_SPAN * span(self.mask)).all())

    def reset(self) -> None:
        """Forgets all pictures; the learned error stays."""
        self.last_pts: int | None = None
        self.offset = np.zeros(2, int)
        self.present, self.presence = True, 1.0
        self.motion: np.ndarray | None = None
        self.travel = np.zeros(2)
        self.number = 0
        self.seen: list[np.ndarray] = []  # luminance of the last three frames, newest last
        self._ready: list[tuple[np.ndarray, np.ndarray]] = []
        self.previous: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # input, output, confidence
        self.surface: np.ndarray | None = None
        self.mean = np.full(3, 0.5)
        self.clear_history()

    def clear_history(self) -> None:
        self.ring: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = []
        self.synthesis: tuple[np.ndarray, np.ndarray] | None = None

    def process(self, pts: int, frame: np.ndarray, flip: bool = False) -> np.ndarray:
        """frame (h, w, 3 or 4) of bytes, bottom row first where ``flip`` -> restored bytes, top row first."""
        if self.last_pts is not None and pts < self.last_pts:
            self.reset()
        self.last_pts = pts
        frame = frame[::-1] if flip else frame
        v = frame[..., :3].astype(float) / 255
        before = self.offset
        self._locate(v)
        if np.abs(self.offset - before).max() >= JUMP:  # the overlay was rendered anew: another clip
            self.clear_history()
        v = tracking.shift(v, self.offset) if self.offset.any() else v
        if not self.mask.all():
            self.mean = v[~self.mask].mean(axis=0)
        strength = self._strength(v)
        self._move(v, before)
        out, weight, base = self._unblend(v, strength)
        if strength > 0:
            self._fill(out, weight)
            if self.motion is not None:
                self._propagate(out, weight, base, v)
            self._recall(out, weight)
            self._synthesise(out, weight)
            self._texture(out, weight)
        self.previous = (v, out.copy(), weight.copy())
        self._push(out, weight)
        shown = tracking.shift(out.reshape(*self.shape, 3), -self.offset)
        shown = np.floor(np.clip(shown, 0, 1) * 255 + 0.5).astype(np.uint8)
        return np.concatenate([shown, np.full((*self.shape, 1), 255, np.uint8)], -1) if frame.shape[-1] == 4 else shown

    def _locate(self, v: np.ndarray) -> None:
        """Moves the offset where another one scores clearly better, or the present one is lost."""
        if self.by_taps:
            scores, reach, least = lambda d, k: self.taps.of(np.arange(0, len(self.taps), k)).regression(v, d), TAP_REACH, TAP_SCORE
            thin, edge = max(1, len(self.taps) // tracking.THIN), False
        elif self.by_template:
            scores, reach, least = lambda d, k: self.layer.template.scores(v, d, k), TEMPLATE_REACH, TEMPLATE_SCORE
            thin, edge = self.layer.template.thin(), True
        else:
            return
        now = float(scores(self.offset[None], 1)[0])
        if now >= 1 - MARGIN:  # no other place can be clearly better than a whole match
            return
        best, top = tracking.search(scores, reach, thin)
        if top < least or edge and np.abs(best).max() >= reach:
            return
        if top > now + MARGIN or now < least:
            self.offset = best

    def _strength(self, v: np.ndarray) -> float:
        """0 without the overlay, 1 with it, in between while it fades; an overlay that was there needs a clear drop to go."""
        if not self.layer.gated:
            return 1.0
        self.presence = self.taps.presence(v) if self.taps else 1.0
        s = float(np.clip((self.presence - (0.10 if self.present else 0.35)) / 0.20, 0, 1))
        self.present = s >= 0.5
        return s

    def _move(self, v: np.ndarray, before: np.ndarray) -> None:
        """The scene's motion since the previous frame; slow motion is measured over three frames."""
        self.motion = None
        if self.matcher is None:
            return
        lum = v.mean(-1)
        now = self.matcher.ready(lum)
        if self.seen:
            one = best_shift(self.matcher.errors(now, self._ready[-1]))
            if one is not None:
                self.motion = one[0]
                if len(self.seen) == 3 and np.abs(self.motion).max() * 3 <= SEARCH:
                    three = best_shift(self.matcher.errors(now, self._ready[0]), MAX_ERROR * 1.5)
                    if three is not None and np.abs(three[0] / 3 - self.motion).max() <= REFINE_DELTA:
                        self.motion = three[0] / 3
                self.travel = self.travel + self.motion + (self.offset - before)
            else:
                self.clear_history()
        self.seen, self._ready = [*self.seen, lum][-3:], [*self._ready, now][-3:]

    def _unblend(self, v: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values and confidences before anything is known from elsewhere, and the un-blended values without what was learned."""
        out, weight = v.reshape(-1, 3).copy(), np.full(self.mask.size, CLEAN)
        base = out.copy()
        if s > 0:
            weight[self.masked] = 0
            t = self.translucent.ravel()
            a = np.minimum(self.layer.alpha.ravel()[t] * s, INVERT)
            base[t] = np.clip((out[t] - self.layer.colour.reshape(-1, 3)[t] * s) / (1 - a)[:, None], 0, 1)
            known = self.error_weight[t]
            learned = np.where((known >= LEARN_LEAST)[:, None], s * self.error_sum[t] / np.maximum(known, 1)[:, None], 0)
            out[t] = np.clip(base[t] - learned, 0, 1)
            weight[t] = ((1 - a) / NOISE) ** 2
        return out, weight, base

    def _fill(self, out: np.ndarray, weight: np.ndarray) -> None:
        """Harmonic surface over the fills, started from the nearest pixels of each row and column, then kept warm."""
        if not len(self.filled):
            return
        cold = self.surface is None
        if cold:
            usable = (self.far > 0) & (self.far < 255)
            share = np.where(usable, 1 / np.maximum(self.far, 1) ** 2.0, 0)
            total = share.sum(0)
            near = (out[np.where(usable, self.donors, 0)] * share[..., None]).sum(0)
            self.surface = np.where((total > 0)[:, None], near / np.maximum(total, 1e-12)[:, None], self.mean)
        out[self.filled] = self.surface
        for _ in range(SWEEPS_COLD if cold else SWEEPS_WARM):
            for ix in self.colours:
                a, b, c, d = self.around[:, ix]
                out[self.filled[ix]] = 0.25 * (out[a] + out[b] + out[c] + out[d])
        self.surface = out[self.filled].copy()
        weight[self.filled] = FILL

    def _tone(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain and offset of each channel against the previous frame, along the motion, over clean pixels."""
        dy, dx = np.floor(self.motion + 0.5).astype(int)
        h, w = self.shape
        py, px = self.sample // w - dy, self.sample % w - dx
        ok = (py >= 0) & (px >= 0) & (py < h) & (px < w)
        q = py[ok] * w + px[ok]
        here, there = self.sample[ok][~self.mask.ravel()[q]], q[~self.mask.ravel()[q]]
        if len(here) < LEAST_TEMPLATE / 2:
            return np.ones(3), np.zeros(3)
        x, y = self.previous[0].reshape(-1, 3)[there], v.reshape(-1, 3)[here]
        var = x.var(0)
        gain = np.where(var > TONE_VARIANCE, ((x * y).mean(0) - x.mean(0) * y.mean(0)) / np.maximum(var, 1e-12), 1)
        gain = np.clip(gain, *TONES)
        return gain, y.mean(0) - gain * x.mean(0)

    def _propagate(self, out: np.ndarray, weight: np.ndarray, base: np.ndarray, v: np.ndarray) -> None:
        """Blends in the previous restored frame where it agrees, and learns the error of the un-blending from it."""
        _, was, sure = self.previous
        got = _Samples(self.masked, self.shape, self.motion)
        p, source = self.masked[got.ok], sure[got.at].min(axis=0)
        trust = 1 / (1 / np.maximum(source, 1e-9) + HOP**2)
        gain, offset = self._tone(v)
        t = np.clip(got.read(was) * gain + offset, 0, 1)
        mine = weight[p]
        agrees = np.abs(t - out[p]).max(-1) <= 3 * np.sqrt(1 / trust + 1 / np.maximum(mine, 1)) + 0.02
        use = (source > 0) & agrees
        p, t, trust, mine = p[use], t[use], trust[use], mine[use]
        learn = (trust >= LEARN_FROM) & self.translucent.ravel()[p]
        q = p[learn]
        self.error_sum[q] += np.clip(base[q] - t[learn], -LEARN_CAP, LEARN_CAP) * trust[learn, None]
        self.error_weight[q] += trust[learn]
        forget = np.minimum(1, LEARN_MOST / np.maximum(self.error_weight[q], 1))
        self.error_sum[q] *= forget[:, None]
        self.error_weight[q] *= forget
        _blend(out, weight, p, t, trust, mine)

    def _recall(self, out: np.ndarray, weight: np.ndarray) -> None:
        """Uncertain pixels take what the ring's pictures saw there, each the picture that is surest of it."""
        p = self.masked[weight[self.masked] < DONE]
        best, value, age_of = np.zeros(len(p)), np.zeros((len(p), 3)), np.ones(len(p))
        open_ = np.arange(len(p))
        for picture, confidence, mean, at, offset, number in reversed(self.ring):
            if not len(open_):
                break
            age = max(1, self.number - number)
            got = _Samples(p[open_], self.shape, self.travel - at - (self.offset - offset))
            ix = open_[got.ok]
            source = got.read(DECODED[confidence])
            trust = 1 / (1 / np.maximum(source, 1e-9) + HOP**2 * age + 1e-4)
            better = np.flatnonzero((source >= SOURCE) & (trust > best[ix]))
            tone = np.clip(self.mean / np.maximum(mean, 0.02), *TONES)
            to = ix[better]
            best[to], value[to], age_of[to] = trust[better], np.clip(got.read(picture, better) / 255 * tone, 0, 1), age
            open_ = open_[best[open_] < STRONG]
        found = best > 0
        p, value, best, age_of = p[found], value[found], best[found], age_of[found]
        mine = weight[p]
        limit = 3 * np.sqrt(1 / best + 1 / np.maximum(mine, 1)) + 0.02 + 0.01 * np.minimum(age_of, 20)
        use = np.abs(value - out[p]).max(-1) <= limit
        _blend(out, weight, p[use], value[use], best[use], mine[use])

    def _synthesise(self, out: np.ndarray, weight: np.ndarray) -> None:
        """In scenes that never move: patches of the region itself, computed once and following the exposure."""
        if self.layer.reason != "static-fill" or not len(self.filled) or np.abs(self.travel).max() > STILL:
            return
        if self.synthesis is None:
            image = out.reshape(*self.shape, 3)
            made = solvers.patch_fill(image, self.mask, base=image)
            self.synthesis = (made.reshape(-1, 3)[self.filled], self.mean.copy())
        made, mean = self.synthesis
        out[self.filled] = np.clip(made * np.clip(self.mean / np.maximum(mean, 0.02), *TONES), 0, 1)
        weight[self.filled] = SYNTHESIS

    def _texture(self, out: np.ndarray, weight: np.ndarray) -> None:
        """Fills that nothing has revealed take the detail of the nearest clean pixel that isn't on an edge."""
        bare = np.flatnonzero(weight[self.filled] <= FILL * 1.01) if len(self.filled) else []
        if not len(bare):
            return
        h, w = self.shape
        q = np.unique(self.donors[(self.far > 0) & (self.far < 255)])
        y, x = np.divmod(q, w)
        around = [((y + i >= 0) & (y + i < h) & (x + j >= 0) & (x + j < w), q + i * w + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        is_fill = self.layer.fill.ravel()
        count, mean, low, high = np.zeros(len(q)), np.zeros((len(q), 3)), np.ones(len(q)), np.zeros(len(q))
        for ok, at in around:
            at = np.where(ok, at, 0)
            ok = ok & ~is_fill[at]
            seen = out[at]
            count += ok
            mean += seen * ok[:, None]
            low, high = np.minimum(low, np.where(ok, seen[:, 0], 1)), np.maximum(high, np.where(ok, seen[:, 0], 0))
        fits, detail_of = np.zeros(h * w, bool), np.zeros((h * w, 3))
        fits[q] = (count >= 4) & (high - low <= TEXTURE_RANGE)
        detail_of[q] = np.clip(out[q] - mean / np.maximum(count, 1)[:, None], -TEXTURE_CAP, TEXTURE_CAP)
        far = np.where((self.far > 0) & (self.far < 255), self.far, 1 << 20)[:, bare]
        donors = np.where(far < 1 << 20, self.donors[:, bare], 0)
        cost = np.where((far < 1 << 20) & fits[donors], far, 1 << 20)
        nearest = cost.argmin(axis=0)  # of equally far ones the first of left, right, up, down
        there = cost[nearest, np.arange(len(bare))] < 1 << 20
        q = donors[nearest, np.arange(len(bare))][there]
        p = self.filled[bare][there]
        out[p] = np.clip(self.surface[bare][there] + detail_of[q], 0, 1)
        weight[p] = TEXTURE

    def _push(self, out: np.ndarray, weight: np.ndarray) -> None:
        last = self.ring[-1] if self.ring else None
        if last is None or self.number - last[5] >= PUSH_GAP or np.abs(self.travel - last[3]).max() >= PUSH_TRAVEL:
            picture = np.floor(np.clip(out, 0, 1) * 255 + 0.5).astype(np.uint8)
            self.ring = [*self.ring, (picture, encode_weight(weight), self.mean.copy(), self.travel.copy(), self.offset.copy(), self.number)][-self.depth :]
        self.number += 1

    def dump(self) -> bytes:
        small = [-1 if self.last_pts is None else self.last_pts, self.number, int(self.present), *self.offset]
        arrays = {"small": np.array(small, np.int64), "travel": self.travel, "mean": self.mean, "seen": np.array(self.seen, np.float32)}
        arrays |= {"error_sum": self.error_sum[self.masked].astype(np.float32), "error_weight": self.error_weight[self.masked].astype(np.float32)}
        if self.previous:
            arrays |= {f"previous{i}": x.astype(np.float32) for i, x in enumerate(self.previous)}
        if self.surface is not None:
            arrays["surface"] = self.surface.astype(np.float32)
        if self.synthesis:
            arrays |= {"synthesis": self.synthesis[0].astype(np.float32), "synthesis_mean": self.synthesis[1]}
        for i in range(6 if self.ring else 0):
            arrays[f"ring{i}"] = np.array([r[i] for r in self.ring])
        sink = io.BytesIO()
        np.savez(sink, **arrays)
        return sink.getvalue()

    def load(self, raw: bytes) -> None:
        got = np.load(io.BytesIO(raw))
        pts, self.number, present, *offset = got["small"].tolist()
        self.last_pts, self.present, self.offset = None if pts < 0 else pts, bool(present), np.array(offset)
        self.travel, self.mean = got["travel"], got["mean"]
        self.seen = [x.astype(float) for x in got["seen"]]
        self._ready = [self.matcher.ready(x) for x in self.seen] if self.matcher else []
        self.error_sum[self.masked], self.error_weight[self.masked] = got["error_sum"], got["error_weight"]
        self.previous = tuple(got[f"previous{i}"].astype(float) for i in range(3)) if "previous0" in got else None
        self.surface = got["surface"].astype(float) if "surface" in got else None
        self.synthesis = (got["synthesis"].astype(float), got["synthesis_mean"]) if "synthesis" in got else None
        self.ring = [(*(x[:5]), int(x[5])) for x in zip(*(got[f"ring{i}"] for i in range(6)))] if "ring0" in got else []


def _blend(out: np.ndarray, weight: np.ndarray, p: np.ndarray, value: np.ndarray, trust: np.ndarray, mine: np.ndarray) -> None:
    total = mine + trust
    out[p] = (out[p] * mine[:, None] + value * trust[:, None]) / total[:, None]
    weight[p] = np.minimum(total, MOST)


OUT = "video_id string, pts_us long, rgb binary"


def restore_batch(frames: DataFrame, layer: Layer) -> DataFrame:
    """frames (video_id, pts_us, rgb) restored in order of time. Clips are dealt whole and sorted within their task,
    and one frame after the other is restored as it arrives, so a long clip costs no more memory than a short one."""
    shape = layer.alpha.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, key = Restorer(layer), None
        for b in batches:
            names, times, pictures = (b.column(c) for c in ("video_id", "pts_us", "rgb"))
            for i in range(len(b)):
                if restorer.last_pts is None or names[i].as_py() != key:
                    restorer, key = Restorer(layer), names[i].as_py()
                frame = np.frombuffer(pictures[i].as_py(), np.uint8).reshape(*shape, 3)
                done = restorer.process(times[i].as_py(), frame).tobytes()
                yield pa.RecordBatch.from_arrays([names.slice(i, 1), times.slice(i, 1), pa.array([done], pa.binary())], names=["video_id", "pts_us", "rgb"])

    rows = frames.select(F.col("video_id").cast("string").alias("video_id"), F.col("pts_us").cast("long").alias("pts_us"), "rgb").where("pts_us is not null and rgb is not null")
    return rows.repartition("video_id").sortWithinPartitions("video_id", "pts_us").mapInArrow(run, OUT)


def restore_stream(frames: DataFrame, layer: Layer) -> DataFrame:
    """The same over a stream: rows of a micro-batch are put in order, state carries over."""
    shape = layer.alpha.shape

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        restorer = Restorer(layer)
        if state.exists:
            restorer.load(state.get[0])
        rows = pd.concat(list(batches)).sort_values("pts_us")
        done = [(key[0], int(r.pts_us), restorer.process(int(r.pts_us), np.frombuffer(r.rgb, np.uint8).reshape(*shape, 3)).tobytes()) for r in rows.itertuples()]
        yield pd.DataFrame(done, columns=["video_id", "pts_us", "rgb"])
        state.update((restorer.dump(),))

    return frames.groupBy("video_id").applyInPandasWithState(run, OUT, "blob binary", "append", GroupStateTimeout.NoTimeout)


def frame_motion(lum: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, dx, dy, error: the whole-pixel motion of the scene since the frame before, of lum(keys, t, y, x, lum,
    clean) with frames numbered one by one; null where no shift matches. Each pair of frames is one bounded group."""
    kinds = ", ".join(f"{k} {lum.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((2, pdf.y.max() + 1, pdf.x.max() + 1))
        clean = np.zeros(grid.shape[1:], bool)
        grid[pdf.side, pdf.y, pdf.x] = pdf.lum
        clean[pdf.y, pdf.x] = pdf.clean
        if pdf.side.nunique() < 2:
            return pd.DataFrame()
        matcher = Matcher(clean)
        errors = matcher.errors(matcher.ready(grid[1]), matcher.ready(grid[0]))
        y, x = np.mgrid[-SEARCH : SEARCH + 1, -SEARCH : SEARCH + 1]
        best = np.lexsort((x.ravel(), y.ravel(), (np.abs(y) + np.abs(x)).ravel(), np.round(errors, 9).ravel()))[0]
        found = errors.ravel()[best] <= MAX_ERROR
        return pd.DataFrame([[*key, int(x.ravel()[best]) if found else None, int(y.ravel()[best]) if found else None, float(errors.ravel()[best])]], columns=[*keys, "t", "dx", "dy", "error"])

    rows = lum.select(*keys, "t", "y", "x", "lum", "clean", F.explode(F.array(F.struct(F.col("t").alias("pair"), F.lit(1).alias("side")), F.struct((F.col("t") + 1).alias("pair"), F.lit(0).alias("side")))).alias("s"))
    rows = rows.select(*keys, F.col("s.pair").cast("int").alias("t"), "s.side", "y", "x", "lum", "clean")
    return rows.groupBy(*keys, "t").applyInPandas(run, f"{kinds}{', ' if kinds else ''}t int, dx int, dy int, error double")
