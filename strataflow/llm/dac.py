"""Directly addressable codes for token ids.

A segment cuts every id into 8-bit chunks, low chunk first. Level l holds chunk l of all ids that
have one; a continuation bitmap beside it marks the ids that go on in level l + 1, and a rank
directory (ones before every 512th bit) turns a place in level l into its place in level l + 1. So
any token is read in as many steps as it has chunks, and no block is decoded.

Layout, little-endian: ``DAC1``, level count u32, then per level: length u64, chunk bytes, bitmap
(LSB first, whole bytes), directory of u32. The last level has neither bitmap nor directory.

Token files are Parquet containers of such segments, written by Spark's own committer, so a lost
executor or a task that runs twice leaves no half file. Segments hold whole documents in ascending
(doc_id, text hash) order; nulls come first. The container neither compresses nor dictionary-encodes, and a
page holds one row, so the file's own page index tells where each segment's bytes lie: ``read_token``
gets one id of one document by ranged reads of a few dozen bytes a level, through any file system
that Spark knows.

Defined cases: null and empty texts hold the end id alone; repeated rows are written as often as they occur;
of several documents with one id, ``read_token`` takes the first in file order; a place outside the document is
an IndexError, an unknown document a KeyError; extra columns aren't read; an empty table gives an empty file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import bounded_batches, shared_dir, tasks_for
from .tokens import Encoder

BITS, BLOCK = 8, 512
#: A segment is closed once it holds so many tokens; documents aren't cut.
SEGMENT_TOKENS = 1 << 20
#: Segment starts (three numbers each) are broadcast up to this count and joined by shuffle beyond.
BROADCAST_SEGMENTS = 200_000
FILE_DDL = "part int, segment int, n_tokens long, first_doc long, last_doc long, n_bytes long, doc_ids array<long>, doc_tokens array<long>, codes binary"
#: Bytes stay as they are, one row a page, so that they can be addressed in the file.
CONTAINER = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "1", "parquet.block.size.row.check.min": "1"}
_LONGS = pa.list_(pa.int64())
_ROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_bytes", pa.int64()), ("doc_ids", _LONGS), ("doc_tokens", _LONGS), ("codes", pa.binary())])
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def encode(ids: np.ndarray) -> bytes:
    out, rest = [], ids.astype(np.uint32)
    levels = max(1, -(-int(rest.max()).bit_length() // BITS)) if len(rest) else 1
    for level in range(levels):
        out.append(struct.pack("<Q", len(rest)))
        out.append((rest & 255).astype(np.uint8).tobytes())
        if level + 1 < levels:
            more = rest > 255
            out.append(np.packbits(more, bitorder="little").tobytes())
            ones = np.concatenate([[0], np.cumsum(more, dtype=np.uint32)])
            out.append(ones[:-1:BLOCK].astype("<u4").tobytes() if len(rest) else b"")
            rest = rest[more] >> BITS
    return b"DAC1" + struct.pack("<I", levels) + b"".join(out)


class Segment:
    """Reader of one segment's bytes."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != b"DAC1":
            raise ValueError("not a DAC1 segment")
        (count,) = struct.unpack_from("<I", raw, 4)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 8
        for level in range(count):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            chunks = np.frombuffer(raw, np.uint8, n, at)
            at += n
            bits, ranks = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
            if level + 1 < count:
                bits = np.frombuffer(raw, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(raw, "<u4", -(-n // BLOCK), at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def access(self, i: int) -> int:
        """The id at place i, by one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << BITS * level
            if level + 1 == len(self.levels) or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            part = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(part[: i - block * BLOCK].sum())
        return value

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at many places, by the rank directories; nothing else is decoded."""
        out = np.zeros(len(places), np.uint32)
        alive, at = np.arange(len(places)), places.astype(np.int64)
        inner = np.arange(BLOCK // 8)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[alive] |= chunks[at].astype(np.uint32) << np.uint32(BITS * level)
            if level + 1 == len(self.levels):
                break
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            alive, at = alive[more], at[more]
            byte = (at // BLOCK * (BLOCK // 8))[:, None] + inner
            word = np.where(byte < (at >> 3)[:, None], bits[np.minimum(byte, max(0, len(bits) - 1))], 0) if len(at) else np.zeros((0, 1), np.uint8)
            rest = bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
            at = ranks[at // BLOCK].astype(np.int64) + _ONES[word].sum(axis=1, dtype=np.int64) + _ONES[rest]
        return out

    def decode(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint32)
        place = np.arange(len(self))
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[place] |= chunks.astype(np.uint32) << np.uint32(BITS * level)
            if level + 1 < len(self.levels):
                place = place[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


def access(read: Callable[[int, int], bytes], i: int) -> int:
    """The id at place i of a segment of which read(place, size) gives bytes: of each level its length, one
    chunk, and where the id goes on one directory entry and the bitmap from there to the id."""
    magic, count = struct.unpack("<4sI", read(0, 8))
    if magic != b"DAC1":
        raise ValueError("not a DAC1 segment")
    at, value = 8, 0
    for level in range(count):
        (n,) = struct.unpack("<Q", read(at, 8))
        if level == 0 and not 0 <= i < n:
            raise IndexError(i)
        value |= read(at + 8 + i, 1)[0] << BITS * level
        if level + 1 == count:
            break
        bitmap = at + 8 + n
        directory = bitmap + -(-n // 8)
        block = i // BLOCK
        part = np.frombuffer(read(bitmap + block * BLOCK // 8, (i >> 3) + 1 - block * BLOCK // 8), np.uint8)
        if not part[-1] >> (i & 7) & 1:
            break
        (ones,) = struct.unpack("<I", read(directory + 4 * block, 4))
        i = ones + int(np.unpackbits(part, bitorder="little")[: i - block * BLOCK].sum())
        at = directory + 4 * -(-n // BLOCK)
    return value


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes the token file ``path``.

    Rows are dealt by range of (doc_id, text hash), so equal ids of repeated rows don't gather in
    one task. An empty table gives an empty file. Extra columns aren't read."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, segment = Encoder.at(tokenizer), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        total = 0

        def close() -> pa.RecordBatch:
            n = np.concatenate(sizes)
            docs, codes = pa.concat_arrays(names), encode(np.concatenate(held))
            known = docs.drop_null()
            row = {
                "part": [part], "segment": [segment], "n_tokens": [total],
                "first_doc": [known[0].as_py() if len(known) else None], "last_doc": [known[-1].as_py() if len(known) else None],
                "n_bytes": [len(codes)], "doc_ids": [docs.to_pylist()], "doc_tokens": [n.tolist()], "codes": [codes],
            }
            return pa.RecordBatch.from_pydict(row, schema=_ROW)

        for b in batches:
            text = b.column("text")
            for lo, hi in K.slices(K.texts(text)[1]):
                ids, at = coder.encode(text.slice(lo, hi - lo))
                n = np.diff(at)
                if end_id is not None:
                    ids = np.insert(ids, at[1:], np.uint32(end_id))
                    n = n + 1
                held.append(ids)
                names.append(b.column("doc_id").slice(lo, hi - lo).cast(pa.int64()))
                sizes.append(n)
                total += len(ids)
                if total >= segment_tokens:
                    yield close()
                    segment, total, held, names, sizes = segment + 1, 0, [], [], []
        if sizes:
            yield close()

    order = ["doc_id", "_h"]
    bounded_batches(spark)
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    rows = rows.repartitionByRange(tasks_for(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(run, FILE_DDL).write.options(**CONTAINER).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids (binary, u32 LE), first_id and last_id (null for
    a document without tokens) of a file. The two last come by random access, all ids by decoding the segment.

    Parts are as many as the writer's partitions, so the running totals of parts are small; those of
    a part's segments are summed within the part."""
    file = spark.read.schema(FILE_DDL).parquet(path)
    in_part = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    heads = file.select("part", "segment", "n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    starts = heads.select("part", "segment", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("seg_start")).join(before, "part")

    if heads.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    placed = file.drop("n_tokens").join(starts, ["part", "segment"]).select((F.col("part_start") + F.col("seg_start")).alias("start"), "doc_ids", "doc_tokens", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                segment = Segment(b.column("codes")[i].as_py())
                ids = segment.decode()
                n = b.column("doc_tokens")[i].values.to_numpy()
                at = np.concatenate([[0], np.cumsum(n)])
                empty = n == 0
                edges = [pa.array(segment.take(np.where(empty, 0, x)) if len(segment) else np.zeros(len(n), np.uint32), pa.uint32(), mask=empty).cast(pa.int64()) for x in (at[:-1], at[1:] - 1)]
                names, first = b.column("doc_ids")[i].values, b.column("start")[i].as_py()
                for lo, hi in K.slices(at * 4, 8 << 20):
                    where = pa.py_buffer(((at[lo : hi + 1] - at[lo]) * 4).astype(np.int32))
                    raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, where, pa.py_buffer(ids[at[lo] : at[hi]].astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), pa.array(first + at[lo:hi]), pa.array(n[lo:hi]), raw, *(x.slice(lo, hi - lo) for x in edges)], names=["doc_id", "start", "n_tokens", "ids", "first_id", "last_id"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, first_id long, last_id long")


class RangedFile:
    """Ranged reads of one file through Spark's file systems, with a count of the bytes that were read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        self._stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
        self.bytes_read = 0

    def read(self, at: int, size: int) -> bytes:
        self._stream.seek(at)
        self.bytes_read += size
        return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._stream, size))

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_: object) -> None:
        self._stream.close()


def _codes_end(spark: SparkSession, path: str, row: int) -> int:
    """Where the codes of a row of one Parquet file end, told by the file's page index."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), hadoop))
    try:
        for block in reader.getFooter().getBlocks():
            if row < block.getRowCount():
                column = next(c for c in block.getColumns() if c.getPath().toDotString() == "codes")
                index = reader.readOffsetIndex(column)
                return index.getOffset(row) + index.getCompressedPageSize(row)
            row -= block.getRowCount()
    finally:
        reader.close()
    raise IndexError(row)


def open_document(spark: SparkSession, path: str, doc_id: int) -> tuple[str, int, int, int]:
    """(file, place of the segment's bytes in it, the document's first place in the segment, its tokens)."""
    file = spark.read.schema(FILE_DDL).parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    place = F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int")
    found = file.select("part", "segment", F.col("_metadata.file_path").alias("path"), "n_bytes", place.alias("k"), "doc_tokens").where("k > 0")
    head = F.aggregate(F.slice("doc_tokens", F.lit(1), F.col("k") - 1), F.lit(0).cast("long"), lambda a, x: a + x)
    first = found.orderBy("part", "segment").select("path", "n_bytes", "segment", head.alias("head"), F.get("doc_tokens", F.col("k") - 1).alias("n")).first()
    if first is None:
        raise KeyError(doc_id)
    # A file holds the segments of one part in order.
    return first["path"], _codes_end(spark, first["path"], first["segment"]) - first["n_bytes"], first["head"], first["n"]


def read_token(spark: SparkSession, path: str, doc_id: int, i: int) -> int:
    """Id i of one document of a token file, by ranged reads of its segment."""
    file, at, head, n = open_document(spark, path, doc_id)
    if not 0 <= i < n:
        raise IndexError(i)
    with RangedFile(spark, file) as source:
        return access(lambda place, size: source.read(at + place, size), head + i)


def token_file(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tokens-{name}-{uuid.uuid4().hex}"
