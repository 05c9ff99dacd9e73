"""Shared pieces: the cluster's shared folder, Arrow text access, word hashing on raw bytes.

Texts are read as UTF-8 bytes straight from Arrow buffers; a null text counts as the empty text everywhere.
Operators select only the columns they name, so extra columns never clash with theirs.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

pa.set_memory_pool(pa.system_memory_pool())  # its own pool would keep what a batch took for as long as the worker lives
BLOCK_BYTES = 1 << 20
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where the session names none, a local one sets its own, as in tests; a cluster must name one."""
    sc = spark.sparkContext
    name = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if name:
        return name.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; Spark removes them when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)
        self._path = jvm.org.apache.hadoop.fs.Path

    def table(self, df: DataFrame, name: str, *partition_by: str, compression: str | None = None) -> DataFrame:
        self.free()
        out = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        writer = writer.option("compression", compression) if compression else writer
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def free(self) -> None:
        """What was shuffled for the tables before isn't needed again; Spark's cleaner frees it once the JVM has dropped their plans."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


FILTER = 1 << 24  # bits of a filter: 64 a row, so 262,144 rows at most


def _marked(rows: DataFrame, wanted: DataFrame, column: str, how: str) -> DataFrame:
    bit = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER))
    one = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    words = wanted.select(bit.alias("_bit")).groupBy(F.expr("_bit div 64").alias("_word")).agg(F.bit_or(one).alias("_bits"))
    marked = rows.withColumn("_bit", bit).withColumn("_word", F.expr("_bit div 64")).join(F.broadcast(words), "_word", how)
    return marked.withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(one) != 0, F.lit(False)))


def likely(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose number in a column may be among those of another table's, the others filtered before any shuffle: by a bit of each number's hash.

    The filter has a fixed size and is broadcast; the more numbers, the more other rows it lets through. Any wanted row passes.
    """
    return _marked(rows, wanted, column, "inner").where("_hit").select(*(F.col(f"`{c}`") for c in rows.columns))


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The rows whose number in a column isn't among those of another table's same column: those that the filter rules out, and those it lets through by chance, which a join of the numbers alone finds."""
    names = [F.col(f"`{c}`") for c in rows.columns]
    clear = _marked(rows, gone, column, "left").where("not _hit").select(*names)
    chance = likely(rows.select(column), gone, column).join(gone, column, "left_anti").distinct()
    # An inner join: Catalyst would move a semi join below the filter, and shuffle all rows.
    return clear.unionByName(likely(rows, chance, column).join(chance, column).select(*names))


def released(run):
    """A function of batches that gives its worker's free memory back to the system once it has ended, as workers are used again."""

    @functools.wraps(run)
    def inner(batches):
        yield from run(batches)
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return inner


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string or binary column, without a copy where it has no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `most` bytes together; a longer text makes a block of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers: the same on every executor and in every run."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0x632BE59BD9B4E019 % 2**64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a block of texts, with letters A-Z in lower case: start, end, text and 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        if not len(self.start):
            self.hash = np.zeros(0, U64)
            return
        longest = int((self.end - self.start).max())
        which = np.cumsum(first, dtype=np.int32)
        which -= 1
        at = np.arange(n, dtype=np.int64) - self.start[which]
        at[~solid] = 0
        part = stream64(256, 1)[LOWER[data]] * stream64(longest, 2)[np.minimum(at, longest - 1)]
        part[~solid] = 0
        self.hash = mix64(np.add.reduceat(part, self.start) + (self.end - self.start).astype(U64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each distinct run of k words of each text; a text of fewer words gives its whole sequence as one, a text without words none."""
    h, doc, count = words.hash, words.doc, words.count
    if not len(h):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    place = np.arange(len(h)) - first[doc]
    number = count[doc]
    out = np.zeros(len(h), U64)
    factors = stream64(k, 3)
    for j in range(k):
        take = h[j:] if j else h
        part = mix64(take * factors[j] + U64(j))
        inside = (place + j < number)[: len(part)]
        out[: len(part)] += np.where(inside, part, U64(0))
    keep = (place + k <= number) | (place == 0)
    out = mix64(out + np.minimum(number, k).astype(U64))[keep]
    doc = doc[keep]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[fresh], doc[fresh]
