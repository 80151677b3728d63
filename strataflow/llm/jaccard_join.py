"""Exact n-gram Jaccard join by vertical partitioning.

1. Every document becomes the set of its word 5-gram hashes. The hash space is cut into fragments;
   a fragment counts the document frequency of its own n-grams, without seeing any whole set.
2. Frequencies give the global order (rarest first, then by hash). N-grams of one document only
   can't overlap: a document with under 80 % shared n-grams links with nothing and drops out.
   Equal sets collapse into one node with a weight.
3. Linked sets share an n-gram of their prefixes (the first n - ceil(0.8 n) + 1 in the order), and the smaller
   has 80 % of the larger one's size at least. For each prefix n-gram the smallest node that has it is the
   pivot; its block holds all nodes that share such an n-gram, so both ends of every link meet in a block. N-grams
   of nodes of too different sizes have a pivot for each class of sizes with the class below, so a digest of many
   documents travels to blocks of its own size only. Blocks over ``TILE`` nodes are dealt in pairs of tiles.
4. In a block the global order is cut into fragments again; partial overlaps of all pairs are counted
   fragment by fragment and summed per pair. A block returns a spanning forest of its links and the
   number of links it owns (a pair in several blocks belongs to the smallest pivot), never the pairs.
5. Components come from the forests by hooking and pointer jumping over DataFrames.

An n-gram that ``HOT`` documents of one batch share is counted once for the batch and ordered last;
its occurrences go straight to their documents' partitions, so no fragment gathers them.

Fragments and exchanges follow the size of the table. N-grams are identified by 64-bit hashes, of which
exchanges keep the fragment number and 48 bits.

Defined cases: null and wordless texts have size 0, link with nothing and are their own component;
1 to 4 words form one n-gram; repeated rows link with each other; null ids take part, and count as
larger than any id; extra columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .blobs import BLOB_DDL, blob_batch, frame, gathered
from .shared import bounded_batches, dealt, doc_key, drop_written, even_parts, tasks_for, written

HOT, TILE, CHUNK_BYTES = 64, 384, 1 << 20
FRAGMENT_COLUMNS = 4096
#: Most fragments of the hash space.
MOST_FRAGMENTS = 1 << 20
_LAST = np.uint32(0xFFFFFFFF)

SETS_DDL = "key long, doc_id long, n int, node long, u int, grams binary"


def gram_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word hashes of each row, and n + 1 offsets."""
    data, at = K.texts(column)
    b = K.LOWER[data]
    start, end, first = K.words(b, at)
    h, where = K.shingles(K.RangeHash(b).of(start, end), first, k)
    row = K.run_lengths(where)
    order = np.lexsort((h, row))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    out = np.zeros(len(at), np.int64)
    np.cumsum(np.bincount(row[new], minlength=len(at) - 1), out=out[1:])
    return h[new], out


def _groups(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for ix in np.split(order, cuts) if len(order) else []:
        yield int(part[ix[0]]), ix


def _gram(bits: int, part: np.ndarray | int, tail: np.ndarray) -> np.ndarray:
    """One number of a fragment and the 48 bits of the hash behind its bits."""
    if bits <= 16:
        return (np.uint64(part) << np.uint64(48)) | tail
    return (np.uint64(part) << np.uint64(64 - bits)) | (tail >> np.uint64(bits - 16))


def _deal(k: int, fragments: int, owners: int, parts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of documents -> blobs for fragments (parts 0 ..) and owners (parts fragments ..)."""
    bits = fragments.bit_length() - 1

    def one(ids: pa.Array, keys: np.ndarray, text: pa.Array) -> list[tuple[int, int, bytes]]:
        h, at = gram_sets(text, k)
        n = np.diff(at)
        frag = (h >> np.uint64(64 - bits)).astype(np.int64)
        tail = ((h << np.uint64(bits)) >> np.uint64(16)).astype(np.uint64)
        row = K.run_lengths(at)
        gram, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        hot = count >= HOT
        rows = []
        owner = (keys.view(np.uint64) % np.uint64(owners)).astype(np.int64)
        null = np.asarray(ids.is_null())
        named = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for g, ix in _groups(owner):
            rows.append((fragments + g, 0, frame(keys[ix], named[ix], null[ix], n[ix].astype(np.int32))))
        is_hot = hot[inverse]
        for g, ix in _groups(np.where(is_hot, owner[row], -1)):
            if g >= 0:
                rows.append((fragments + g, 1, frame(keys[row[ix]], _gram(bits, frag[ix].astype(np.uint64), tail[ix]), np.full(len(ix), _LAST))))
        for f, ix in _groups(np.where(is_hot, -1, frag)):
            if f >= 0:
                doc, count_in = np.unique(row[ix], return_counts=True)
                rows.append((f, 2, frame(keys[doc], count_in.astype(np.uint32), (tail[ix] >> np.uint64(16)).astype(np.uint32), (tail[ix] & np.uint64(0xFFFF)).astype(np.uint16))))
        for f, ix in _groups((gram[hot] >> np.uint64(64 - bits)).astype(np.int64)):
            t = (gram[hot][ix] << np.uint64(bits)) >> np.uint64(16)
            rows.append((f, 3, frame(t)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, keys = b.column("text"), b.column("key").to_numpy()
            ids = b.column("doc_id")
            for lo, hi in K.slices(K.texts(text)[1], CHUNK_BYTES):
                yield blob_batch([(int(parts[p]), kind, blob) for p, kind, blob in one(ids.slice(lo, hi - lo), keys[lo:hi], text.slice(lo, hi - lo))])

    return run


def _count(fragments: int, owners: int, parts: np.ndarray, home: np.ndarray) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """One fragment: shared n-grams with their document frequency, dealt to the documents' owners."""
    bits = fragments.bit_length() - 1

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        part = int(np.searchsorted(parts, key[0].as_py()))
        kinds, blobs = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        if part >= fragments:
            return pa.Table.from_batches([blob_batch([(int(home[part - fragments]), k, b) for k, b in zip(kinds, blobs)])])
        mine = [b for k, b in zip(kinds, blobs) if k == 2]
        hot = np.unique(np.concatenate([np.zeros(0, np.uint64), *(gathered([b])[0] for k, b in zip(kinds, blobs) if k == 3)]))
        if not mine:
            return pa.Table.from_batches([blob_batch([])])
        keys, count, high, low = gathered(mine)
        owner_of = np.repeat(keys, count)
        gram = (high.astype(np.uint64) << np.uint64(16)) | low
        order = np.argsort(gram)
        gram, owner_of = gram[order], owner_of[order]
        edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]]))
        df = np.repeat(np.diff(edge), np.diff(edge)).astype(np.uint32)
        if len(hot):
            df[np.isin(gram, hot)] = _LAST
        shared = df > 1
        gram, owner_of, df = gram[shared], owner_of[shared], df[shared]
        gram = _gram(bits, part, gram)
        rows = [(int(home[g]), 1, frame(owner_of[ix], gram[ix], df[ix])) for g, ix in _groups((owner_of.view(np.uint64) % np.uint64(owners)).astype(np.int64))]
        return pa.Table.from_batches([blob_batch(rows)])

    return run


_SETS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("u", pa.int32()), ("grams", pa.binary())])


def _assemble(percent: int) -> Callable[[pa.Table], pa.Table]:
    """One owner: a row per document; those with enough shared n-grams get a node and their n-grams
    in the global order."""

    def run(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        docs = [b for k, b in zip(kinds, blobs) if k == 0]
        if not docs:
            return _SETS.empty_table()
        keys, ids, null, n = gathered(docs)
        pieces = [b for k, b in zip(kinds, blobs) if k == 1]
        node, u, grams = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32), [None] * len(keys)
        if pieces:
            owner, gram, df = gathered(pieces)
            order = np.lexsort((gram, df, owner))
            owner, gram = owner[order], gram[order]
            new = np.ones(len(owner), bool)  # a repeated row sends the same n-gram twice
            new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
            owner, gram = owner[new], gram[new]
            lo, hi = np.searchsorted(owner, keys), np.searchsorted(owner, keys, "right")
            mixed = np.concatenate([[0], np.cumsum(K.mix(gram))]).astype(np.uint64)
            for i in np.flatnonzero((n > 0) & (100 * (hi - lo) >= percent * n.astype(np.int64))).tolist():
                part = gram[lo[i] : hi[i]]
                u[i] = n[i] - len(part)
                mark = mixed[hi[i] : hi[i] + 1] - mixed[lo[i] : lo[i] + 1] + n[i : i + 1].astype(np.uint64)  # wraps
                if u[i]:
                    mark ^= K.mix(keys[i : i + 1].view(np.uint64))
                node[i] = K.mix(mark).view(np.int64)[0]
                grams[i] = part.tobytes()
        return pa.Table.from_arrays(
            [pa.array(keys), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(n, pa.int32()), pa.array(node), pa.array(u, pa.int32()), pa.array(grams, pa.binary())],
            schema=_SETS,
        )

    return run


def fragment_count(tasks: int) -> int:
    """A power of two, so that a fragment is the first bits of a hash."""
    return min(MOST_FRAGMENTS, max(32, 1 << (tasks - 1).bit_length()))


def document_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """key, doc_id, n (set size); node, u and grams where the document can link at all."""
    bounded_batches(docs.sparkSession)
    tasks = tasks_for(docs)
    fragments, owners = fragment_count(tasks), max(16, tasks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", doc_key().alias("key"))
    parts, home = even_parts(fragments + owners, tasks), even_parts(owners, tasks)
    found = rows.mapInArrow(_deal(k, fragments, owners, parts), BLOB_DDL)
    counted = dealt(found, tasks).groupBy("part").applyInArrow(_count(fragments, owners, parts, home), BLOB_DDL)
    return dealt(counted, tasks).groupBy("part").applyInArrow(_assemble(percent), SETS_DDL)


def _prefixes(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, u = b.column("n").to_numpy().astype(np.int64), b.column("u").to_numpy()
            most = np.maximum(0, n - (percent * n + 99) // 100 + 1 - u)
            data, at = K.texts(b.column("grams"))
            gram = np.frombuffer(data.tobytes(), np.int64)
            take = np.minimum(most, np.diff(at) // 8)
            ix = K.ragged(at[:-1] // 8, take)
            row = np.repeat(np.arange(len(n)), take)
            yield pa.RecordBatch.from_arrays([pa.array(gram[ix]), b.column("node").take(pa.array(row)), pa.array(n[row], pa.int32())], names=["gram", "node", "n"])

    return run


def overlaps(grams: list[np.ndarray], columns: int = FRAGMENT_COLUMNS) -> np.ndarray:
    """Overlap of every pair: counted within fragments of the n-gram order, summed over fragments."""
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    row = np.repeat(np.arange(len(grams)), size)
    values, at, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    common = count > 1
    place = np.cumsum(common) - 1
    keep = common[at]
    row, at = row[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total = np.zeros((len(grams), len(grams)), np.float32)
    for lo in range(0, int(common.sum()), columns):
        s, e = np.searchsorted(at, [lo, lo + columns])
        here, local = np.unique(row[s:e], return_inverse=True)
        part = np.zeros((len(here), columns), np.float32)
        part[local, at[s:e] - lo] = 1
        total[np.ix_(here, here)] += part @ part.T
    return total.astype(np.int64)


_LINKS = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("links", pa.int64())])


def _verify(percent: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        pivot, a, b = (x.as_py() for x in key)
        node, n, w, tile = (t.column(c).to_numpy() for c in ("node", "n", "w", "tile"))
        n = n.astype(np.int64)
        grams = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
        both = overlaps(grams)
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(linked, False)
        if a != b:
            linked &= tile[:, None] != tile[None, :]
        # A pair is counted where its smallest common pivot is.
        lists = t.column("pivots").combine_chunks()
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        smaller = flat < pivot
        values, col = np.unique(flat[smaller], return_inverse=True)
        has = np.zeros((len(node), len(values)), np.float32)
        has[K.run_lengths(at)[smaller], col] = 1
        owned = linked & (has @ has.T == 0) if len(values) else linked
        links = owned @ w
        label = node.copy()
        while True:
            best = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
            step = np.minimum(label, best)
            if (step == label).all():
                break
            label = step
        keep = (links > 0) | (label != node)
        return pa.Table.from_arrays([pa.array(node[keep]), pa.array(label[keep]), pa.array(links[keep].astype(np.int64))], schema=_LINKS)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of all nodes of edges(a, b), by repeated hooking to the
    smallest neighbour's label and pointer jumping."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("top"))
        after = written(hooked.join(up, "low").select("node", F.least("low", "top").alias("label"), (F.least("low", "top") < F.col("label")).alias("moved")), "labels")
        moved = after.where("moved").limit(1).count()
        drop_written(labels)
        labels = after.select("node", "label")
        if not moved:
            return labels


def _stars(prefix: DataFrame, percent: int) -> DataFrame:
    """node, pivot: the blocks of every node. Of an n-gram whose nodes are of sizes that can all link, the smallest
    node is the pivot. Of the others, the nodes of each class of sizes, each ``100 / percent`` times
    the one below (a little more, against rounding), meet those of the class below at a pivot of their own."""
    smallest = F.min(F.struct("n", "node"))
    pivots = prefix.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), smallest.alias("pivot"), F.max("n").alias("most")).where("c > 1")
    wide = F.col("most") * percent > F.col("pivot.n").cast("long") * 100
    pivots = pivots.where(~wide | (F.col("c") > 2)).select("gram", F.col("pivot.node").alias("pivot"), wide.alias("wide"))
    met = prefix.join(pivots, "gram").select("node", "n", F.when(~F.col("wide"), F.col("pivot")).alias("pivot"), F.when(F.col("wide"), F.col("gram")).alias("gram"))
    met = written(met.distinct(), "met")
    narrow = met.where("gram is null").select("node", "pivot")
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(101 / percent))
    classes = met.where("gram is not null").select("gram", "node", "n", F.explode(F.array(F.struct(size.alias("size"), F.lit(1).alias("own")), F.struct((size + 1).alias("size"), F.lit(0).alias("own")))).alias("s"))
    classes = classes.select("gram", "node", "n", "s.size", "s.own")
    of_class = classes.groupBy("gram", "size").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("own"), smallest.alias("pivot")).where("c > 1 and own = 1")
    meeting = classes.join(of_class.select("gram", "size", F.col("pivot.node").alias("pivot")), ["gram", "size"]).select("node", "pivot")
    return narrow.union(meeting).distinct()


def join_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """key, doc_id, n_shingles, component_id (smallest linked doc_id), n_links, group (a number that
    linked documents share; null for those that link with nothing) of every document."""
    sets = written(document_sets(docs, k, percent), "sets")
    active = sets.where("grams is not null")
    nodes = written(active.groupBy("node").agg(F.count(F.lit(1)).alias("w"), F.first("n").alias("n"), F.first("u").alias("u"), F.first("grams").alias("grams")), "nodes")
    prefix = nodes.select("node", "n", "u", "grams").mapInArrow(_prefixes(percent), "gram long, node long, n int")
    star = written(_stars(prefix, percent), "star")
    sizes = star.groupBy("pivot").agg(F.count(F.lit(1)).alias("c"))
    tiles = F.ceil(F.col("c") / TILE).cast("int")
    lists = star.groupBy("node").agg(F.collect_list("pivot").alias("pivots"))
    placed = star.join(sizes.where("c > 1"), "pivot").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("node", "pivot", "tile", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    full = placed.join(lists, "node").join(nodes.select("node", "w", "n", "grams"), "node")
    found = written(full.groupBy("pivot", "a", "b").applyInArrow(_verify(percent), "node long, label long, links long"), "links")
    label = components(found.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = nodes.select("node", "w").join(label, "node", "left").join(links, "node", "left")
    of_node = of_node.select("node", "w", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    least = active.groupBy("node").agg(F.min("doc_id").alias("low")).join(of_node, "node")
    by_label = least.groupBy("label").agg(F.min("low").alias("component_id"))
    links_of = F.col("w") - 1 + F.col("links")
    of_node = written(least.join(by_label, "label").select("node", "component_id", links_of.alias("n_links"), F.when(links_of > 0, F.col("label")).alias("group")), "node-components")
    return sets.withColumn("node", F.when(F.col("grams").isNotNull(), F.col("node"))).join(of_node, "node", "left").select(
        "key", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "group"
    )
