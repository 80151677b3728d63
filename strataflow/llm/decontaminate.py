"""Benchmark decontamination by SimHash with multi-index Hamming search.

Every benchmark item of n words is compared with the n-word windows of every document (with the
whole document where that is shorter). Windows and items are multisets of 5-word n-grams; their
128-bit SimHash adds one +-1 vector per n-gram occurrence. The fingerprints are cut into 16 blocks
of 8 bits: of two fingerprints within ``RADIUS`` bits, some block differs in RADIUS // 16 bits at
most, so looking up every block among the items' block neighbourhoods misses none. Pairs within
the radius are verified by their exact weighted Jaccard similarity, sum of least over sum of most
counts. At the threshold of 0.8 and without repeated n-grams the expected distance is 19 bits; RADIUS
stands four standard deviations above. Few or repeated n-grams spread wider, so items of less than ``FEW``
n-grams or with a repeated one, and windows with a repeated one, are verified with every item of
that size that shares an n-gram, whatever their distance.

Only windows that can reach the threshold are fingerprinted: the shared occurrences must make up
p / (1 + p) of both sizes together, so a window with fewer occurrences of any benchmark n-gram is
out. This count is exact and drops no match.

The benchmark is collected in blocks of ``BLOCK_CHARS`` at most, with one pass over the documents
for each block, so neither driver nor executors ever hold more.

Defined cases: null or wordless texts and items match nothing; items of 1 to 4 words match that
very word sequence; repeated documents and items match each on its own; of several windows with
equal similarity the first is reported; extra columns pass through ``clean_documents``; empty tables
give empty tables or leave the documents as they are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import bounded_batches, map_rows

WORDS, PERCENT, RADIUS, BLOCKS, FEW = 5, 80, 36, 16, 16
BLOCK_CHARS = 4 << 20
DDL = "item_id long, similarity double, start_word long, n_words long, distance int"
_BITS = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def fingerprints(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """16 bytes per window [start, start + size) of the n-gram hashes h."""
    two = np.stack([K.mix(h), K.mix(h ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    bits = np.unpackbits(two.view(np.uint8).reshape(len(h), 16), axis=1)
    ones = np.zeros((len(h) + 1, 128), np.int32)
    np.cumsum(bits, axis=0, out=ones[1:])
    return np.packbits(2 * (ones[start + size] - ones[start]) > size[:, None], axis=1)


class Items:
    """One block of the benchmark, ready for look-ups."""

    def __init__(self, ids: list[int], texts: list[str | None], percent: int = PERCENT, radius: int = RADIUS) -> None:
        self.percent, self.radius = percent, radius
        data, at = K.texts(pa.array(texts, pa.string()))
        b = K.LOWER[data]
        start, end, first = K.words(b, at)
        h = K.RangeHash(b).of(start, end)
        self.ids, self.n_words, self.grams = [], [], []
        for i, name in enumerate(ids):
            n = int(first[i + 1] - first[i])
            if n:
                grams, _ = K.shingles(h[first[i] : first[i + 1]], np.array([0, n]), min(n, WORDS))
                self.ids.append(name)
                self.n_words.append(n)
                self.grams.append(grams)
        self.counts = [Counter(g.tolist()) for g in self.grams]
        #: By n-gram width: sorted n-grams, and the sizes (in n-grams) of the items that hold each.
        self.known: dict[int, np.ndarray] = {}
        self.sizes: dict[int, dict[int, set[int]]] = {}
        groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, g in enumerate(self.grams):
            k = min(self.n_words[i], WORDS)
            groups[k, len(g)].append(i)
            for x in self.counts[i]:
                self.sizes.setdefault(k, {}).setdefault(x, set()).add(len(g))
        for k, of in self.sizes.items():
            self.known[k] = np.array(sorted(of), np.uint64)
        self.index = {key: _BlockIndex([self.grams[i] for i in members], radius) for key, members in groups.items()}
        self.groups = dict(groups)
        #: By group and n-gram: places of the items that hold it; and by group the places that the radius may miss.
        self.holders: dict[tuple[int, int], dict[int, set[int]]] = {}
        self.wide: dict[tuple[int, int], set[int]] = {}
        for key, members in groups.items():
            holders = self.holders.setdefault(key, defaultdict(set))
            for p, i in enumerate(members):
                for x in self.counts[i]:
                    holders[x].add(p)
            self.wide[key] = {p for p, i in enumerate(members) if key[1] < FEW or len(self.counts[i]) < key[1]}

    def need(self, a: int, b: int) -> int:
        """Least shared occurrences of two multisets of a and b n-grams at the threshold."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, item place, similarity, first word, words, distance), the best window of each pair."""
        data, at = K.texts(column)
        for lo, hi in K.slices(at):
            b = K.LOWER[data[at[lo] : at[hi]]]
            start, end, first = K.words(b, at[lo : hi + 1] - at[lo])
            h = K.RangeHash(b).of(start, end)
            for k, known in self.known.items():
                grams, where = K.shingles(h, first, k)
                spot = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                hit = known[spot] == grams
                total = np.concatenate([[0], np.cumsum(hit)])
                for row in np.flatnonzero(total[where[1:]] > total[where[:-1]]).tolist():
                    s, e = int(where[row]), int(where[row + 1])
                    for found in self._row(k, grams[s:e], hit[s:e]):
                        yield (lo + row, *found)

    def _row(self, k: int, grams: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, float, int, int, int]]:
        sizes = set().union(*(self.sizes[k][x] for x in set(grams[hit].tolist())))
        total = np.concatenate([[0], np.cumsum(hit)])
        windows: list[tuple[int, np.ndarray, int]] = []
        for size in sorted(sizes):
            width = min(size, len(grams))
            begin = np.flatnonzero(total[width:] - total[: len(total) - width] >= self.need(size, width))
            if len(begin):
                windows.append((size, begin, width))
        if not windows:
            return
        lo = min(int(b[0]) for _, b, _ in windows)
        hi = max(int(b[-1]) + w for _, b, w in windows)
        marks = fingerprints(grams[lo:hi], np.concatenate([b for _, b, _ in windows]) - lo, np.concatenate([np.full(len(b), w) for _, b, w in windows]))
        at = 0
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, begin, width in windows:
            w, place, distance = self._also(k, size, grams, begin, width, marks[at : at + len(begin)])
            at += len(begin)
            for i, p, d in zip(w.tolist(), place.tolist(), distance.tolist()):
                item, s = self.groups[k, size][p], int(begin[i])
                mine, theirs = Counter(grams[s : s + width].tolist()), self.counts[item]
                both = sum(min(c, theirs[x]) for x, c in mine.items() if x in theirs)
                union = width + size - both
                if 100 * both >= self.percent * union and (item not in best or (-both / union, s) < (-best[item][0], best[item][1])):
                    best[item] = (both / union, s, width + k - 1, d)
        for item, found in sorted(best.items()):
            yield (item, *found)

    def _also(self, k: int, size: int, grams: np.ndarray, begin: np.ndarray, width: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, item and distance of the pairs within the radius and of those that the radius may miss."""
        index, holders, wide = self.index[k, size], self.holders[k, size], self.wide[k, size]
        w, place, distance = index.near(marks)
        pairs = set(zip(w.tolist(), place.tolist()))
        more = set()
        for i, s in enumerate(begin.tolist()):
            mine = set(grams[s : s + width].tolist())
            shared = set().union(*(holders[x] for x in mine if x in holders))
            more |= {(i, p) for p in (shared if len(mine) < width else shared & wide)}
        more = np.array(sorted(more - pairs), np.int64).reshape(-1, 2)
        far = _BITS[marks[more[:, 0]] ^ index.marks[more[:, 1]]].sum(axis=1)
        return np.concatenate([w, more[:, 0]]), np.concatenate([place, more[:, 1]]), np.concatenate([distance, far])


class _BlockIndex:
    """Multi-index Hamming search over fingerprints of items of one size."""

    def __init__(self, grams: list[np.ndarray], radius: int) -> None:
        self.radius = radius
        self.marks = np.concatenate([fingerprints(g, np.zeros(1, np.int64), np.array([len(g)])) for g in grams])
        step = radius // BLOCKS
        value = np.arange(256)
        self.lists = []
        for block in range(BLOCKS):
            near = _BITS[value[:, None] ^ self.marks[:, block][None, :]] <= step
            v, item = np.nonzero(near)
            self.lists.append((np.searchsorted(v, np.arange(257)), item))

    def near(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, item and distance of every pair within the radius."""
        pairs = []
        for block, (at, item) in enumerate(self.lists):
            v = marks[:, block].astype(np.int64)
            n = at[v + 1] - at[v]
            pairs.append(np.repeat(np.arange(len(marks)), n) * len(self.marks) + item[K.ragged(at[v], n)])
        pair = np.unique(np.concatenate(pairs))
        w, i = pair // len(self.marks), pair % len(self.marks)
        distance = _BITS[marks[w] ^ self.marks[i]].sum(axis=1)
        close = distance <= self.radius
        return w[close], i[close], distance[close]


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """The benchmark in blocks of about ``chars`` characters, one after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // chars))
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = mine.orderBy("item_id", "text").collect()
        if rows:
            yield Items([r[0] for r in rows], [r[1] for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words, distance of the best window of every
    document and item that match."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for items in item_blocks(benchmark):
        found = docs.select("doc_id", "text").mapInArrow(_leak_rows(items), f"doc_id {kind}, {DDL}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.select("doc_id").where("false").selectExpr("doc_id", *(f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in DDL.split(", ")))
    return out


def _leak_rows(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(items.matches(b.column("text")))
            if not found:
                continue
            row, item, similarity, start, n, distance = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(similarity, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(distance, pa.int32())],
                names=["doc_id", "item_id", "similarity", "start_word", "n_words", "distance"],
            )

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with all their columns."""
    bounded_batches(docs.sparkSession)
    where = docs.columns.index("text")

    def keeper(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(len(b), bool)
                for found in items.matches(b.column(where)):
                    keep[found[0]] = False
                yield b.filter(pa.array(keep))

        return run

    for items in item_blocks(benchmark):
        docs = map_rows(docs, keeper(items), docs.columns)
    return docs
