"""Best-fit packing with certified bin counts.

Pieces are dealt to packing partitions and packed there by best-fit decreasing. Dual feasible
functions give a lower bound on the bins that any packing of the partition's pieces needs; where
the count meets the bound, it is certified best. Partitions with a gap keep their full bins and give
up the pieces of all others; these are dealt anew, so that documents of different partitions meet,
and packed again, for ``ROUNDS`` rounds at most. The last packing of every piece is valid in any case.

Defined cases: null and empty texts hold the end id alone (one piece of length 1); a document of
exactly ``seq_len`` tokens is one piece; of longer ones the first piece takes the remainder, so all
others are full; repeated rows are packed as often as they occur; extra columns of ``pieces`` are
carried; an empty table gives an empty table. Ties in length go by arrival, which may change
between runs, but neither pieces nor validity do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import columns_of, numbered, written
from .tokens import Encoder

PART_ROWS = 200_000
ROUNDS = 4
OUTPUTS = ("sequence_id", "offset", "certified")


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    if n <= seq_len:
        return [(0, n)]
    head = n % seq_len or seq_len
    return [(0, head), *((s, seq_len) for s in range(head, n, seq_len))]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 0, seq_len: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, u32 LE) of every whole text, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.at(tokenizer)
        for b in batches:
            text = b.column("text")
            for lo, hi in K.slices(K.texts(text)[1]):
                ids, at = coder.encode(text.slice(lo, hi - lo))
                n = np.diff(at)
                if end_id is not None:
                    ids, n = np.insert(ids, at[1:], np.uint32(end_id)), n + 1
                cuts = [cut(x, seq_len) for x in n.tolist()]
                count = np.fromiter(map(len, cuts), np.int64, len(cuts))
                length = np.fromiter((x for c in cuts for _, x in c), np.int64)
                where = np.concatenate([[0], np.cumsum(length)])
                row = np.repeat(np.arange(len(cuts)), count)
                raw = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((where * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, hi - lo).take(pa.array(row)),
                        pa.array(K.ragged(np.zeros(len(cuts), np.int64), count), pa.int32()),
                        pa.array(np.fromiter((s for c in cuts for s, _ in c), np.int64)),
                        pa.array(length),
                        raw,
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def lower_bound(length: np.ndarray, seq_len: int) -> int:
    """Most of the bounds that dual feasible functions give: the thresholds f_e (items over C - e
    count whole, those under e not at all) for every e, and the roundings u_k for k = 1 .. 20."""
    if not len(length):
        return 0
    n = np.bincount(length, minlength=seq_len + 1).astype(np.int64)
    size = np.arange(seq_len + 1)
    count_to, sum_to = np.cumsum(n), np.cumsum(n * size)
    e = np.arange(1, seq_len // 2 + 1)
    big = count_to[seq_len] - count_to[seq_len - e]
    middle = sum_to[seq_len - e] - sum_to[e - 1]
    best = int(np.max(big + -(-middle // seq_len)))
    for k in range(1, 21):
        scaled, exact = (k + 1) * size // seq_len, (k + 1) * size % seq_len == 0
        # u_k(x) = x where (k + 1) x is whole, else floor((k + 1) x) / k; in units of 1 / (k C)
        value = np.where(exact, k * size, scaled * seq_len)
        best = max(best, -(-int((n * value).sum()) // (k * seq_len)))
    return best


def best_fit_decreasing(length: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in it of every item, and what is left free in each bin."""
    order = np.argsort(-length, kind="stable")
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    free: list[int] = []
    open_by_free: list[list[int]] = [[] for _ in range(seq_len + 1)]
    mask = 0
    for i, size in zip(order.tolist(), length[order].tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_by_free[room].pop()
            if not open_by_free[room]:
                mask ^= 1 << room
        else:
            b, room = len(free), seq_len
            free.append(seq_len)
        bins[i], offset[i] = b, seq_len - room
        free[b] = room = room - size
        if room:
            open_by_free[room].append(b)
            mask |= 1 << room
    return bins, offset, np.array(free, np.int64)


def _packer(size: str, turn: int, last: bool, seq_len: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        length = t.column(size).to_numpy()
        bins, offset, free = best_fit_decreasing(length, seq_len)
        proven = len(free) <= lower_bound(length, seq_len)
        stays = np.ones(len(length), bool) if last or proven else free[bins] == 0
        number = (turn << 56) + (key[0].as_py() << 32) + bins
        out = t.drop_columns(["part"])
        out = out.append_column("sequence_id", pa.array(np.where(stays, number, -1), pa.int64()))
        out = out.append_column("offset", pa.array(offset, pa.int64()))
        return out.append_column("certified", pa.array(np.full(len(length), proven)))

    return run


def pack(pieces: DataFrame, seq_len: int = 2048, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """pieces (with a column length of 1 to seq_len) and their sequence_id, offset, and certified:
    whether the bins of the partition that packed the piece last are proven as few as can be."""
    pieces = pieces.select(*(c for c, name in zip(columns_of(pieces), pieces.columns) if name.lower() not in OUTPUTS))
    plain = numbered(pieces)
    size = plain.columns[pieces.columns.index("length")]
    kept = T.StructType([*plain.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("certified", T.BooleanType())])
    left, placed = written(plain, "pieces"), []
    rows = left.count()
    for turn in range(rounds):
        parts = max(1, -(-rows // part_rows))
        last = turn + 1 == rounds or parts == 1
        dealt = left.withColumn("part", (F.pmod(F.xxhash64(F.lit(turn), F.monotonically_increasing_id()), F.lit(parts))).cast("long"))
        done = written(dealt.groupBy("part").applyInArrow(_packer(size, turn, last, seq_len), kept), f"packed{turn}")
        placed.append(done.where("sequence_id >= 0"))
        if last:
            break
        left = done.where("sequence_id < 0").select(*plain.columns)
        rows = left.count()
        if not rows:
            break
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.toDF(*pieces.columns, *OUTPUTS)
