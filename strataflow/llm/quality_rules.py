"""Quality rules with compression bands.

Every whole text is compressed once as a whole and once in fixed chunks with zstandard. Redundant
text compresses far below, noise far above what prose of its length does; since short texts
compress worse, each length class has its own band of allowed ratios. A document is kept if it
passes the base rules, its whole ratio lies in its band, and not more than ``MAX_BAD_CHUNKS`` of its
chunks lie outside the chunk band.

Defined cases: null or empty texts have 0 words, fail the base rules and are not kept; their ratio
is null. Repeated rows get equal rows, ties cannot arise, extra columns pass through
``filter_documents`` untouched, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import kernels as K
from .shared import bounded_batches, map_rows

#: Bytes of a fixed chunk; a tail under half of it belongs to the chunk before.
CHUNK = 2048
LEVEL = 3
#: (bytes below which the row holds, least ratio, most ratio) of compressed to whole size. The least
#: ratios stand 1 to 3 % under what prose of the length was seen to need at this level; the most
#: ratios lie between prose of any script and base-64 noise. Pass other tables for other levels.
BANDS = [
    (128, 0.60, 1.50), (192, 0.66, 1.05), (256, 0.61, 1.00), (384, 0.565, 0.92), (512, 0.55, 0.88),
    (768, 0.505, 0.80), (1024, 0.48, 0.76), (1536, 0.465, 0.74), (2048, 0.45, 0.72), (3072, 0.443, 0.70),
    (4096, 0.437, 0.70), (6144, 0.425, 0.68), (8192, 0.417, 0.68), (12288, 0.408, 0.66), (16384, 0.402, 0.66),
    (32768, 0.392, 0.66), (65536, 0.382, 0.66), (131072, 0.365, 0.66), (1 << 20, 0.33, 0.66), (1 << 62, 0.28, 0.66),
]
CHUNK_BAND = (0.45, 0.75)
MAX_BAD_CHUNKS = 0.25
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = b"#*$%&|<>"

FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
    ("kept", pa.bool_()), ("zstd_ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()),
]
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_bad_chunks long"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _per_row(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each row that lie in 5-word windows found twice or more in the row."""
    n = np.diff(first)
    windows, at = K.shingles(h, first)
    row = K.run_lengths(at)
    key = windows ^ K.mix(row.astype(K.U64) + K.U64(1))
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hits = np.flatnonzero(twice)
    start = hits - at[row[hits]] + first[row[hits]]
    step = np.zeros(first[-1] + 6, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + np.minimum(5, n[row[hits]]), -1)
    return _per_row(np.cumsum(step)[: first[-1]] > 0, first)


def _dup_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return dup


def chunk_bounds(n: int) -> list[tuple[int, int]]:
    cuts = list(range(0, max(1, n), CHUNK))
    if len(cuts) > 1 and n - cuts[-1] < CHUNK // 2:
        cuts.pop()
    return list(zip(cuts, [*cuts[1:], n]))


def band_verdict(n_bytes: int, ratio: float, bad: int, chunks: int) -> bool:
    lo, hi = next((lo, hi) for below, lo, hi in BANDS if n_bytes < below)
    return lo <= ratio <= hi and bad <= MAX_BAD_CHUNKS * chunks


def measure(column: pa.Array) -> list[np.ndarray]:
    """One array per entry of FIELDS."""
    data, at = K.texts(column)
    parts: list[list[np.ndarray]] = []
    squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    for lo, hi in K.slices(at):
        b, o = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        start, end, first = K.words(b, o)
        n_words = np.diff(first)
        chars = _per_row(~K.WS[b] & ((b & 0xC0) != 0x80), o)
        symbols = _per_row(_IS_SYMBOL[b], o)
        repeat = repeat_words(K.RangeHash(b).of(start, end), first)
        base = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        n = hi - lo
        dup, ratio, chunks, bad, kept = (np.zeros(n, t) for t in (np.int64, np.float64, np.int64, np.int64, bool))
        raw = b.tobytes()
        for i in range(n):
            s, e = int(o[i]), int(o[i + 1])
            text = raw[s:e]
            dup[i] = _dup_lines(text)
            if e == s:
                ratio[i] = np.nan
                continue
            ratio[i] = len(squeeze.compress(text)) / (e - s)
            bounds = chunk_bounds(e - s)
            chunks[i] = len(bounds)
            if len(bounds) > 1:
                r = [len(squeeze.compress(text[x:y])) / (y - x) for x, y in bounds]
                bad[i] = sum(not CHUNK_BAND[0] <= x <= CHUNK_BAND[1] for x in r)
            kept[i] = not base[i] and band_verdict(e - s, ratio[i], int(bad[i]), len(bounds))
        parts.append([n_words, chars, symbols, dup, repeat, base, kept, ratio, chunks, bad])
    if not parts:
        return [np.zeros(0, t.to_pandas_dtype()) for _, t in FIELDS]
    return [np.concatenate(x) for x in zip(*parts)]


def _columns(measured: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(x, t, from_pandas=True) for x, (_, t) in zip(measured, FIELDS)]


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the measures and verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_columns(measure(b.column("text")))], names=["doc_id", *(f for f, _ in FIELDS)])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DDL}")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is kept, with all their columns."""
    bounded_batches(docs.sparkSession)
    where = docs.columns.index("text")
    kept = [f for f, _ in FIELDS].index("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(measure(b.column(where))[kept]))

    return map_rows(docs, run, docs.columns)
