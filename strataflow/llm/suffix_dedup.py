"""Exact removal of byte strings that occur twice, by column-wise suffix construction.

A window of ``LENGTH`` bytes is repeated if the same bytes start anywhere else in the corpus. A
suffix array of the whole corpus, built one symbol per document and round, needs as many passes over all of
it as the longest document has bytes; here the construction runs where it can decide
anything, on short strings around anchors:

1. Every window is owned by its anchor, the ``SEED``-byte substring in it with the least hash. Equal
   windows have equal anchors at equal places, so a window can only repeat among the
   windows of anchors that repeat. The windows of one anchor occurrence form a block of bytes.
2. Fragments of the hash space find the anchors that occur twice, and collapse equal blocks: all
   windows of a block that occurs twice are repeated.
3. Different blocks of one anchor form a multi-document collection. It is built column by column: in
   each round one symbol of every block is added, going outwards from the anchor on either side,
   and ranks are renewed from the ranks of the round before. The round in which a block
   parts from all others is its longest common extension (LCP). Windows whose left and right extensions
   both fit, and whose pair of ranks occurs twice, are repeated.
4. Bytes covered by repeated windows go, judged on the input.

An (anchor, block) pair that one batch holds twice is settled there, and its task sends it once. Where
an anchor has over ``HOT_GROUP`` different blocks, no collection gathers them: their windows are dealt by
their own hashes, and those that one batch holds twice are settled there and sent once by their task, so
a passage that a third of all documents share costs a task of the exchange one row per task before it.
Hashes have 64 bits; documents are found again by a 64-bit key of id and text.

Defined cases: null texts are empty; texts under ``LENGTH`` bytes lose nothing; repeated rows are
repeats of each other; matches never cross documents; extra columns pass through, whatever their names; an
empty table gives an empty table. Bytes that remain after a cut inside a UTF-8 character are kept as they are
in the result's bytes, and replaced by U+FFFD where ``dedup_documents`` has to return text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .blobs import BLOB_DDL, blob_batch, frame, gathered
from .shared import bounded_batches, dealt, doc_key, even_parts, fits_hash, free_names, map_rows, tasks_for, written

LENGTH, SEED, HOT_GROUP, COLLECTION = 200, 100, 20_000, 20_000
SIDE = LENGTH - SEED
#: Bytes of text whose anchors are found at once, but for a longer document.
RUN = 1 << 19
#: Repeated hashes that a task remembers (8 bytes each); beyond, it may send one again.
KNOWN = 1 << 16


def anchors(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every anchor occurrence: row, anchor hash, block hash, place of the anchor, first and last
    window start (places within the row)."""
    empty = np.zeros(0, np.int64)
    if len(b) < LENGTH:
        return empty, empty.astype(K.U64), empty.astype(K.U64), empty, empty, empty
    hashes = K.RangeHash(b)
    at = np.arange(len(b) - SEED + 1)
    g = hashes.of(at, at + SEED)
    bits = max(22, len(b).bit_length())
    least = (g >> K.U64(bits) << K.U64(bits)) | at.astype(K.U64)
    width = 1
    while width * 2 <= SIDE + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SIDE + 1 - width
    least = np.minimum(least[:-rest], least[rest:]) if rest else least
    row = np.repeat(np.arange(len(o) - 1), np.diff(o))[: len(least)]
    start = np.arange(len(least))
    valid = start + LENGTH <= o[row + 1]
    start, row = start[valid], row[valid]
    own = (least[valid] & K.U64((1 << bits) - 1)).astype(np.int64)
    first = np.ones(len(start), bool)
    first[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(start)) - 1 if len(lo) else lo
    s0, s1, m, row = start[lo], start[hi], own[lo], row[lo]
    block = K.mix(hashes.of(s0, s1 + LENGTH) + (m - s0).astype(K.U64) * K.U64(1000003) + (s1 - s0).astype(K.U64))
    base = o[row]
    return row, g[m], block, m - base, s0 - base, s1 - base


def merged(key: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts of each key, joined where they touch or overlap."""
    if not len(key):
        return key, s0, s1
    order = np.lexsort((s0, key))
    key, s0, s1 = key[order], s0[order], s1[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    wide = np.int64(1) << np.int64(33)
    reach = np.maximum.accumulate(s1 + group * wide)
    new = np.ones(len(key), bool)
    new[1:] = s0[1:] + group[1:] * wide > reach[:-1] + 1
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(key)) - 1
    return key[lo], s0[lo], reach[hi] - group[hi] * wide


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    for ix in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        yield int(part[ix[0]]), ix


def _runs(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: first place and length of each run."""
    lo = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    return lo, np.diff(np.append(lo, len(block)))


class _Sent:
    """Hashes that a task has settled as repeated and sent, so that it needn't send them again."""

    def __init__(self) -> None:
        self.known = np.zeros(0, np.uint64)

    def split(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the hashes that this batch holds twice or the task has met twice before, and of one
        occurrence of each that is still to send, with whether it is repeated."""
        order = np.argsort(h, kind="stable")
        lo, n = _runs(h[order])
        before = np.isin(h[order[lo]], self.known)
        many = (n > 1) | before
        if len(self.known) < KNOWN:
            self.known = np.union1d(self.known, h[order[lo[n > 1]]])
        return order[np.repeat(many, n)], order[lo[~before]], (n[~before] > 1).astype(np.uint8)


def _deal(fragments: int, owners: int, number: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Sent()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            data, at = K.texts(batch.column("text"))
            parts = []
            for lo, hi in K.slices(at, RUN):
                row, h, block, m, s0, s1 = anchors(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                parts.append((keys[lo + row], h, block, m, s0, s1))
            if not parts:
                continue
            key, h, block, m, s0, s1 = (np.concatenate(x) for x in zip(*parts))
            settled, sent, multi = memory.split(block)
            rows = []
            k, a, z = merged(key[settled], s0[settled], s1[settled])
            for g, ix in _by_part((k.view(np.uint64) % np.uint64(owners)).astype(np.int64)):
                rows.append((fragments + g, 0, frame(k[ix], a[ix].astype(np.uint32), z[ix].astype(np.uint32))))
            for f, ix in _by_part((h[sent] % np.uint64(fragments)).astype(np.int64)):
                i = sent[ix]
                rows.append((f, 1, frame(h[i], block[i], key[i], m[i].astype(np.uint32), (m[i] - s0[i]).astype(np.uint8), (s1[i] - s0[i]).astype(np.uint8), multi[ix])))
            yield blob_batch([(int(number[p]), kind, blob) for p, kind, blob in rows])

    return run


def _settle(fragments: int, owners: int, number: np.ndarray, home: np.ndarray) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """One fragment: windows of blocks that occur twice (kind 0), and blocks whose bytes are needed (kind 1)."""

    def run(key_: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        part, blobs = int(np.searchsorted(number, key_[0].as_py())), t.column("blob").to_pylist()
        if part >= fragments:
            return pa.Table.from_batches([blob_batch([(int(home[part - fragments]), 0, b) for b in blobs])])
        h, block, key, m, left, span, multi = gathered(blobs)
        order = np.lexsort((multi, block, h))
        h, block, key, m, left, span, multi = (x[order] for x in (h, block, key, m, left, span, multi))
        first = np.ones(len(h), bool)
        first[1:] = (block[1:] != block[:-1]) | (h[1:] != h[:-1])
        lo = np.flatnonzero(first)
        n = np.diff(np.append(lo, len(h)))
        twice = (n > 1) | (multi[lo + n - 1] > 0)
        group_lo, blocks = _runs(h[lo])
        open_ = np.add.reduceat(~twice, group_lo) > 0 if len(lo) else np.zeros(0, bool)
        needed = np.repeat((blocks > 1) & open_, blocks)
        hot = np.repeat(blocks > HOT_GROUP, blocks)
        rows = []
        s0 = m.astype(np.int64) - left
        full = np.flatnonzero(np.repeat(twice, n) & (multi == 0))
        k, a, z = merged(key[full], s0[full], s0[full] + span[full])
        for g, ix in _by_part((k.view(np.uint64) % np.uint64(owners)).astype(np.int64)):
            rows.append((int(home[g]), 0, frame(k[ix], a[ix].astype(np.uint32), z[ix].astype(np.uint32))))
        ask = lo[needed]
        for g, ix in _by_part((key[ask].view(np.uint64) % np.uint64(owners)).astype(np.int64)):
            i = ask[ix]
            rows.append((int(home[g]), 1, frame(key[i], h[i], m[i], left[i], span[i], twice[needed][ix], hot[needed][ix])))
        return pa.Table.from_batches([blob_batch(rows)])

    return run


_MARKS = pa.schema([("key", pa.int64()), ("spans", pa.binary()), ("needs", pa.binary()), ("n_needs", pa.int64())])
MARKS_DDL = "key long, spans binary, needs binary, n_needs long"


def _marks(t: pa.Table) -> pa.Table:
    """One owner: a row per document with settled windows or blocks to send."""
    kinds, blobs = t.column("kind").to_pylist(), t.column("blob").to_pylist()
    spans, needs, count = {}, {}, {}
    mine = [b for k, b in zip(kinds, blobs) if k == 0]
    if mine:
        k, a, z = gathered(mine)
        k, a, z = merged(k, a.astype(np.int64), z.astype(np.int64))
        lo, n = _runs(k)
        for i, c in zip(lo.tolist(), n.tolist()):
            spans[int(k[i])] = frame(a[i : i + c], z[i : i + c])
    mine = [b for k, b in zip(kinds, blobs) if k == 1]
    if mine:
        k, *rest = gathered(mine)
        order = np.argsort(k, kind="stable")
        k, rest = k[order], [x[order] for x in rest]
        lo, n = _runs(k)
        for i, c in zip(lo.tolist(), n.tolist()):
            needs[int(k[i])] = frame(*(x[i : i + c] for x in rest))
            count[int(k[i])] = c
    keys = sorted({*spans, *needs})
    return pa.Table.from_arrays([pa.array(keys, pa.int64()), pa.array([spans.get(k) for k in keys], pa.binary()), pa.array([needs.get(k) for k in keys], pa.binary()), pa.array([count.get(k, 0) for k in keys], pa.int64())], schema=_MARKS)


BLOCK_DDL = "part long, h long, key long, s0 long, anchor int, low int, high int, twice boolean, bytes binary"
_BLOCKS = pa.schema([("part", pa.int64()), ("h", pa.int64()), ("key", pa.int64()), ("s0", pa.int64()), ("anchor", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("twice", pa.bool_()), ("bytes", pa.binary())])
#: In place of an anchor: bytes hold windows to count, or windows that are settled.
_TO_COUNT, _SETTLED = -1, -2


def _blocks(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bytes of the asked blocks. low to high: how far left of the anchor its windows begin. Windows of hot
    anchors go by their own hashes instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .blobs import unframe

        memory = _Sent()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            data, at = K.texts(batch.column("text"))
            out, hot_windows = [], []
            for i, raw in enumerate(batch.column("needs").to_pylist()):
                b = data[at[i] : at[i + 1]]
                text = b.tobytes()
                h, m, left, span, twice, hot = unframe(raw)
                hot = hot.astype(bool)
                for hh, mm, ll, ss, tt in zip(*(x[~hot].tolist() for x in (h, m, left, span, twice))):
                    s0 = mm - ll
                    out.append((hh % parts, hh, int(keys[i]), s0, ll, ll - ss, ll, bool(tt), text[s0 : s0 + ss + LENGTH]))
                open_ = hot & ~twice.astype(bool)
                if hot.any():
                    first, count = m[hot].astype(np.int64) - left[hot], span[hot].astype(np.int64) + 1
                    start = K.ragged(first, count)
                    h_of = K.RangeHash(b).of(start, start + LENGTH)
                    hot_windows.append((h_of, np.full(len(start), keys[i]), start, np.repeat(open_[hot], count)))
            if hot_windows:
                window, key, start, wanted = (np.concatenate(x) for x in zip(*hot_windows))
                settled, sent, multi = memory.split(window)
                settled = settled[wanted[settled]]
                if len(settled):
                    k, a, z = merged(key[settled], start[settled], start[settled])
                    out.append((int(k[0]) % parts, 0, 0, 0, _SETTLED, 0, 0, False, frame(k, a, z)))
                for g, ix in _by_part((window[sent] % np.uint64(parts)).astype(np.int64)):
                    i = sent[ix]
                    out.append((g, 0, 0, 0, _TO_COUNT, 0, 0, False, frame(window[i], key[i], start[i], multi[ix])))
            for lo in range(0, len(out), 20_000):
                part, h, *rest = zip(*out[lo : lo + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64)), *(pa.array(x, f.type) for x, f in zip(rest, list(_BLOCKS)[2:]))], schema=_BLOCKS)

    return run


def _ranks(base: np.ndarray, symbols: np.ndarray, extent: np.ndarray) -> np.ndarray:
    """Column-wise construction on one side. symbols[:, j] is the symbol that round j + 1 adds.
    Gives ranks[j, i], the rank of block i among all after j rounds, -1 once it stands alone."""
    rounds = symbols.shape[1]
    ranks = np.full((rounds + 1, len(base)), -1, np.int32)
    alive = np.arange(len(base))
    rank = base
    for j in range(rounds + 1):
        if j:
            more = extent[alive] >= j
            alive, rank = alive[more], rank[more]
            rank = rank.astype(np.int64) * 256 + symbols[alive, j - 1]
        _, rank, count = np.unique(rank, return_inverse=True, return_counts=True)
        paired = count[rank] > 1
        alive, rank = alive[paired], rank[paired]
        if not len(alive):
            break
        ranks[j, alive] = rank
    return ranks


_SPANS = pa.schema([("key", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])


def repeated_windows(h: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """found[i, l]: whether the window of block i that begins l bytes before its anchor occurs in
    another block with the same h."""
    n = len(h)
    left, right = np.zeros((n, SIDE), np.uint8), np.zeros((n, SIDE), np.uint8)
    after = np.zeros(n, np.int64)
    for i, (text, a) in enumerate(zip(texts, anchor.tolist())):
        x = np.frombuffer(text, np.uint8)
        left[i, :a] = x[:a][::-1]
        y = x[a + SEED :][:SIDE]
        right[i, : len(y)] = y
        after[i] = len(y)
    _, base = np.unique(h, return_inverse=True)
    to_left, to_right = _ranks(base, left, anchor), _ranks(base, right, after)
    found = np.zeros((n, SIDE + 1), bool)
    for l in range(SIDE + 1):
        ix = np.flatnonzero((to_left[l] >= 0) & (to_right[SIDE - l] >= 0) & (low <= l) & (l <= high))
        if len(ix) > 1:
            pair = to_left[l, ix].astype(np.int64) << 32 | to_right[SIDE - l, ix]
            _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
            found[ix, l] = count[inverse] > 1
    return found


def _repeated_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key and start of the windows whose hash occurs twice."""
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    window, key, start, multi = gathered(blobs)
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = (count > 1) | (np.bincount(inverse, multi, len(count)) > 0)
    # What its batch held twice is settled there.
    found = twice[inverse] & (multi == 0)
    return key[found], start[found]


def _collection(t: pa.Table) -> pa.Table:
    """One part of the collections: windows of blocks not settled yet that occur in another block."""
    kind = t.column("anchor").to_numpy()
    blobs = lambda k: [x for x, a in zip(t.column("bytes").to_pylist(), kind.tolist()) if a == k]
    counted, settled = blobs(_TO_COUNT), blobs(_SETTLED)
    t = t.filter(pa.array(kind >= 0))
    h, key, s0 = (t.column(c).to_numpy() for c in ("h", "key", "s0"))
    anchor, low, high = (t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "low", "high"))
    found = repeated_windows(h, anchor, low, high, t.column("bytes").to_pylist())
    found[t.column("twice").to_numpy(zero_copy_only=False)] = False
    i, l = np.nonzero(found)
    start = s0[i] + anchor[i] - l
    more_key, more_start = _repeated_hashes(counted)
    parts = [(key[i], start, start), (more_key, more_start, more_start), *([tuple(gathered(settled))] if settled else [])]
    k, a, z = merged(*(np.concatenate(x) for x in zip(*parts)))
    return pa.Table.from_arrays([pa.array(k), pa.array(a), pa.array(z)], schema=_SPANS)


def repeats(docs: DataFrame) -> tuple[DataFrame, int]:
    """key and spans (frame of first and last window starts) of the documents with repeated windows, and about
    how many bytes that table holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tasks = tasks_for(docs)
    fragments = owners = max(16, tasks)
    rows = docs.select("text", doc_key().alias("key"))
    number, home = even_parts(fragments + owners, tasks), even_parts(owners, tasks)
    found = rows.mapInArrow(_deal(fragments, owners, number), BLOB_DDL)
    settled = dealt(found, tasks).groupBy("part").applyInArrow(_settle(fragments, owners, number, home), BLOB_DDL)
    marks = written(dealt(settled, tasks).groupBy("part").applyInArrow(_marks, MARKS_DDL), "marks")
    total, needs, spans = (x or 0 for x in marks.agg(F.sum("n_needs"), F.sum(F.octet_length("needs")), F.sum(F.octet_length("spans"))).first())
    collections = max(16, -(-total // COLLECTION))
    asked = marks.where("n_needs > 0").select("key", "needs")
    once = rows.join(fits_hash(asked, needs), "key").select("key", "text", "needs")
    blocks = dealt(once.mapInArrow(_blocks(collections), BLOCK_DDL), collections)
    pairs = blocks.groupBy("part").applyInArrow(_collection, "key long, s0 long, s1 long").groupBy("key").agg(F.collect_list(F.struct("s0", "s1")).alias("more"))
    return written(marks.select("key", "spans").join(pairs, "key", "full"), "repeats"), spans + needs


def covered(size: int, spans: bytes | None, more: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes to remove."""
    from .blobs import unframe

    a, z = unframe(spans) if spans else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    pairs = [*zip(a.tolist(), z.tolist()), *((x["s0"], x["s1"]) for x in more or [])]
    out: list[tuple[int, int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e + LENGTH))
        else:
            out.append((s, e + LENGTH))
    return out


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs, with all their columns, beside two more of the returned names: settled and further spans of their text."""
    key, spans, more = free_names(docs, "_key", "_spans", "_more")
    found, size = repeats(docs)
    found = found.select(F.col("key").alias(key), F.col("spans").alias(spans), F.col("more").alias(more))
    return docs.withColumn(key, doc_key()).join(fits_hash(found, size), key, "left").drop(key), spans, more


def _kept(text: pa.Array, spans: pa.Array, more: pa.Array) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """The whole bytes and the runs to remove of each row."""
    data, at = K.texts(text)
    for i, (s, m) in enumerate(zip(spans.to_pylist(), more.to_pylist())):
        text = data[at[i] : at[i + 1]].tobytes()
        yield text, covered(len(text), s, m)


def _rest(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in runs:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans [(start, end)]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_kept(b.column("text"), b.column(spans), b.column(more)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(t) for t, _ in rows], pa.int64()),
                    pa.array([sum(e - s for s, e in r) for _, r in rows], pa.int64()),
                    pa.array([len(r) for _, r in rows], pa.int64()),
                    pa.array([_rest(t, r) for t, r in rows], pa.binary()),
                    pa.array([[{"start": s, "end": e} for s, e in r] for _, r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined, spans, more = _with_spans(docs.select("doc_id", "text"))
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes gone from their texts; null texts stay null, all else as it was."""
    columns = docs.columns
    where, n = columns.index("text"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [_rest(t, r).decode("utf-8", "replace") for t, r in _kept(b.column(where), b.column(n), b.column(n + 1))]
            null = np.asarray(b.column(where).is_null())
            text = pa.array(kept, pa.string(), mask=null)
            yield pa.RecordBatch.from_arrays([text if i == where else b.column(i) for i in range(n)], names=b.schema.names[:n])

    joined, spans, more = _with_spans(docs)
    return map_rows(joined, run, columns)
