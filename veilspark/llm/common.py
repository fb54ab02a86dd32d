"""Shared pieces of the corpus operators: durable cuts, bounded samples, vectorised text kernels and connected components.

The kernels work on the UTF-8 buffer of an Arrow string column. A batch is cut into slices of about a megabyte, so that memory
is bounded by the longest text and never by the number of rows in a batch.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Base of the polynomial hashes, odd so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh local one is set only where the setting is missing, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame, what: str = "cut") -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, so a lost executor costs one task.

    Spark deletes the files when the session ends; `dropped` does so before that. What df was shuffled into is needed no more once it is
    written, and executors delete it as soon as the driver has collected its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of durable tables from which nothing will be read again: what came of them must be durable itself."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._durable_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def _release() -> None:
    """Gives memory that a task no longer uses back to the system: a worker serves many tasks beside others."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of a few megabytes, so that neither side of the pipe holds many long texts at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(tidy, schema)


def unclashing(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """docs with its columns under plain numbers, the new name of each, and the columns that restore the old ones.

    An operator that keeps all columns works between the two, so that no name of the caller's meets one of its own.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names, [F.col(n).alias(c) for c, n in names.items()]


def remainder(key: str, by: int):
    """crc32 of the key as text modulo `by`, the split rule of the learned operators; null keys count as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df at most, chosen by a hash of the key; all of them if df has fewer."""
    n = df.count()
    if n <= rows:
        return df
    share = int(rows / n * (1 << 32))
    return df.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 32)) < share)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; a null counts as an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that together hold about `most` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * SLICE_BYTES)
            steps = np.full(size, BASE, np.uint64), np.full(size, BASE_INVERSE, np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] == the hash of data[i:j] times BASE**i."""
    up, _ = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def words_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run without separator bytes, and the row it lies in. offsets are relative to data."""
    inside = ~separator[data]
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


#: The bytes x20 and x09 to x0D part words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): one row (node, root) per node, root the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014): every step is one pre-aggregated shuffle, never a group
    in one task's memory, and a long chain shrinks geometrically. Each round is cut durably.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        wide = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = wide.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = wide.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        edges = durable(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
