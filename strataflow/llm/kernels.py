"""Vectorised numpy kernels over Arrow string columns.

Texts stay in Arrow's own UTF-8 buffer; words, windows and their hashes are found with array
operations over that buffer, so no Python object is made per word. ``slices`` cuts a record batch
into runs of whole documents of bounded size, which bounds the memory of every kernel (a single
longer document forms a run of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one kernel call takes at most, but for a single longer document.
RUN_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_C = [0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]

WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``most`` bytes each, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.p = self.q = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n:
            n = max(n, RUN_BYTES + 1)
            for name, base in (("p", _P), ("q", _PINV)):
                out = np.ones(n, U64)
                done = 1
                while done < n:  # doubling: base^(i + done) = base^i * base^done
                    m = min(done, n - done)
                    out[done : done + m] = out[:m] * U64(pow(base, done, 1 << 64))
                    done += m
                setattr(self, name, out)
        return self.p, self.q


POWERS = Powers()


class RangeHash:
    """64-bit polynomial hashes of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray) -> None:
        p, self.q = POWERS.upto(len(data) + 1)
        self.h = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=self.h[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.h[end] - self.h[start]) * self.q[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of bytes that aren't ASCII white space) and, per row, the
    index of its first word (n + 1 entries). Words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~WS[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words, and per row the index of its first window. A row with
    1 to k - 1 words has its whole sequence as its one window; a row without words has none."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    row = np.repeat(np.arange(len(n)), count)
    pos = np.arange(at[-1]) - at[row] + first[row]
    width = np.minimum(n[row], k)
    out = width.astype(U64) * U64(0x632BE59BD9B4E019)
    for j in range(k):
        here = np.minimum(pos + j, len(h) - 1)
        part = h[here] * U64(_C[j % 5] + 2 * (j // 5) * 0x9E3779B9)
        out += np.where(j < width, part, U64(0)) if len(out) else part
    return mix(out), at


def run_lengths(at: np.ndarray) -> np.ndarray:
    """Row index of each element of ragged rows with offsets ``at``."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for length[i] entries, one row after the other."""
    total = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=total[1:])
    return np.arange(total[-1]) + np.repeat(start - total[:-1], length)
