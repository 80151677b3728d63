"""Arrays in one binary value, so that an exchange moves few rows and stays outside row encoding."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa


def frame(*arrays: np.ndarray) -> bytes:
    out = [struct.pack("<B", len(arrays))]
    out += [struct.pack("<cBQ", a.dtype.kind.encode(), a.dtype.itemsize, len(a)) for a in arrays]
    return b"".join(out + [np.ascontiguousarray(a).tobytes() for a in arrays])


def unframe(raw: bytes) -> list[np.ndarray]:
    n, at, heads = raw[0], 1, []
    for _ in range(n):
        heads.append(struct.unpack_from("<cBQ", raw, at))
        at += struct.calcsize("<cBQ")
    out = []
    for kind, width, count in heads:
        out.append(np.frombuffer(raw, np.dtype(f"{kind.decode()}{width}"), count, at))
        at += width * count
    return out


def gathered(blobs: Iterable[bytes]) -> list[np.ndarray]:
    """The arrays of all blobs, each joined in order."""
    parts = [unframe(b) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts)]


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        names=["part", "kind", "blob"],
    )


BLOB_DDL = "part long, kind int, blob binary"
