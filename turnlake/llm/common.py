"""What the operators share: scratch tables, checked broadcasts, word tables over Arrow text, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that join_small() broadcasts, in bytes of its rows.
BROADCAST_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package, and keep Arrow batches of texts small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set on a local master."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="turnlake-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


#: Tables that scratch() has written and nothing has deleted yet.
_TABLES: dict[str, None] = {}


#: Whether Spark deletes a query's shuffle files when the query ends, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, name: str, once: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors.

    once: nothing else computes df, so the files of its shuffles are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/turnlake/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true" if once else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _TABLES[path] = None
    return spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"turnlake_path": path})


def discard(df: DataFrame) -> None:
    """Delete the table behind a scratch() result that nothing will read again."""
    path = df.schema[df.columns[0]].metadata.get("turnlake_path")
    if path in _TABLES:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    del _TABLES[path]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cleaned(query):
    """A query that deletes the tables it has written on the way, but for those that its result reads."""

    @functools.wraps(query)
    def run(spark: SparkSession, *given) -> DataFrame:
        before = set(_TABLES)
        out = query(spark, *given)
        read = {file.rsplit("/", 2)[-2] for file in out.inputFiles()}
        for path in [p for p in _TABLES if p not in before and p.rsplit("/", 1)[-1] not in read]:
            _delete(spark, path)
        release()
        return out

    return run


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_small(df: DataFrame, side: DataFrame, on, how: str, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a written table: broadcast if its rows, counted, stay under limit bytes, else a shuffle join."""
    return df.join(F.broadcast(side) if side.count() * row_bytes <= limit else side, on, how)


_LIVE: dict = {}


def live(key, make):
    """What a worker process keeps between tasks, made on first use. It keeps one thing: another key, or release(), drops it."""
    if key not in _LIVE:
        release()
        _LIVE[key] = make()
    return _LIVE[key]


def release() -> None:
    """Drop what an earlier operator left in this worker, and give memory that is free back to the system."""
    _LIVE.clear()
    _POWERS[:] = [x[:1].copy() for x in _POWERS]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run):
    """A function of batches that leaves a worker as small as it can, before it begins and when it has ended."""

    def tidied(batches):
        release()
        yield from run(batches)
        release()

    return tidied


try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # glibc
except (AttributeError, OSError):
    _TRIM = None


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_MUL), -1, 1 << 64))
        for i, base in enumerate((_MUL, inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column, and the offsets of each text in them; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch of texts: starts and ends (byte offsets in data), first (index of each text's first word, and the end)."""

    def __init__(self, column: pa.Array, space: np.ndarray = SPACE, fold: np.ndarray | None = None):
        self.data, self.offsets = utf8(column)
        if fold is not None:
            self.data = fold[self.data]
        n = len(self.data)
        ink = ~space[self.data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:], after[-1], after[:-1] = False, ink[:-1], False, ink[1:]
            inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            before[inner], after[inner - 1] = False, False
        self.starts, self.ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every batch."""
        return self.spans()(self.starts, self.ends)

    def spans(self):
        """What gives a 64-bit hash of the bytes from starts to ends, the same in every batch."""
        up, down = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=total[1:])
        return lambda starts, ends: mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """Parts of a batch with about so many bytes of text each; a longer text is a part of its own."""
    sizes = np.diff(utf8(batch.column(column))[1])
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    if len(sizes) > start:
        yield batch.slice(start)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): (node, component), component the least node; alternating large and small stars.

    Every round is a written table; joins on a hub are plain equi-joins, which adaptive execution splits.
    Self-links and repeated links are allowed; no edges give no rows.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    links = scratch(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    sums = [F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))]
    state = links.agg(*sums).first()
    while state[0]:
        both = links.union(links.select("v", "u")).toDF("u", "v")
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u <> v").distinct()
        later = scratch(small, "links")
        now = later.agg(*sums).first()
        discard(links)
        links = later
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
