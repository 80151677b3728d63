"""Session helpers: the shared folder for cut lineage, record batch size, stable row keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Compressed bytes of a table per task of an exchange over its texts.
TASK_BYTES = 8 << 20
#: Blocks of an exchange grow with the square of its tasks; beyond this count the tasks grow instead.
MOST_TASKS = 1 << 16
#: Bytes of a hashed join side that one task may hold.
HASH_SIDE = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session, which has no other
    executors, may name none; it gets a temporary one that goes when the process ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strataflow-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: lineage ends here, and lost
    executors cost no recomputation of what stands before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a frame of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def doc_key() -> Column:
    """A 64-bit key of a document row from its id and whole text. Repeated rows share it."""
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.coalesce(F.col("text"), F.lit("")))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names hold."""
    return [F.col("`{}`".format(c.replace("`", "``"))) for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..: functions over record batches can't take every name."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: list[str]) -> DataFrame:
    """mapInArrow for columns of any name. run sees the columns of df numbered, and yields the first len(names) of them."""
    plain = numbered(df)
    return plain.mapInArrow(run, T.StructType(plain.schema.fields[: len(names)])).toDF(*names)


def planned_bytes(df: DataFrame) -> int:
    """Size of the files behind df, as the optimizer knows them; nothing is read for it. Inputs of unknown size
    count as empty."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def tasks_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """How many tasks the exchanges over df's texts are dealt to: as many as the session says, and one for each
    ``task_bytes`` of compressed table at least, so that a task's share doesn't grow with the data."""
    return max(shuffle_parts(df.sparkSession), min(MOST_TASKS, -(-planned_bytes(df) // task_bytes)))


def dealt(df: DataFrame, tasks: int) -> DataFrame:
    """df with its column part dealt to so many tasks where the session's exchange would have fewer."""
    return df.repartition(tasks, "part") if tasks > shuffle_parts(df.sparkSession) else df


def _hash_place(ids: np.ndarray, tasks: int) -> np.ndarray:
    """The partition that Spark's exchange deals a 64-bit number to: Murmur3 of its two halves with seed 42."""
    u = np.uint32

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x << u(n)) | (x >> u(32 - n))

    h = np.full(len(ids), 42, u)
    for half in (ids & 0xFFFFFFFF, ids >> 32):
        h = turn(h ^ (turn(half.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> u(shift))) * u(factor)
    return (h ^ (h >> u(16))).view(np.int32) % tasks


def even_parts(count: int, tasks: int) -> np.ndarray:
    """Ascending numbers for the column part that an exchange deals to ``tasks`` tasks as evenly as can be, where
    the numbers 0, 1, .. would leave one task several parts and the next none."""
    most, taken, n = -(-count // tasks), np.zeros(0, np.int64), 4 * max(count, tasks)
    while len(taken) < count:
        ids = np.arange(n, dtype=np.int64)
        place = _hash_place(ids, tasks)
        order = np.argsort(place, kind="stable")
        rank = np.arange(n) - np.searchsorted(place[order], place[order])
        taken = ids[order[rank < most]]
        n *= 2
    return np.sort(taken[np.argsort(_rounds(taken, tasks), kind="stable")[:count]])


def _rounds(ids: np.ndarray, tasks: int) -> np.ndarray:
    """Of each number, how many before it go to the same task."""
    place = _hash_place(ids, tasks)
    order = np.argsort(place, kind="stable")
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids)) - np.searchsorted(place[order], place[order])
    return out


def fits_hash(df: DataFrame, size: int) -> DataFrame:
    """df, a join side of ``size`` bytes under evenly spread keys, with the hint to be hashed where a task's share of
    it is within ``HASH_SIDE``; beyond, the join sorts and spills."""
    return df.hint("shuffle_hash") if size // shuffle_parts(df.sparkSession) <= HASH_SIDE else df


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Record batches to Python hold so many rows at most from now on: whole texts are long, and a worker
    holds a batch beside what it makes of it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
