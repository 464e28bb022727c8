"""Helpers shared by the corpus operators: word layout on Arrow buffers, row keys, written tables.

Texts are handled as UTF-8 bytes in numpy arrays inside Arrow batches, cut into
slices of a few MB, so a task's memory does not follow its number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize as write_and_read
from ..session import ship_package

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4 << 20


def byte_table(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: The white space of the contracts: space, and \x09 to \x0D.
ASCII_WS = byte_table(b" \t\n\x0b\x0c\r")
ONLY_SPACE = byte_table(b" ")
#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 64
#: Odd multipliers, and masks of the lowest 0 to 8 bytes.
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: A-Z to a-z, all other bytes (also those of longer UTF-8 sequences) unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; other columns cannot clash afterwards."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``tkey``, which tells apart different texts under one repeated id."""
    return documents(docs).withColumn("tkey", F.hash("text"))


def shipped(spark: SparkSession) -> None:
    ship_package(spark)


#: Spark's own switch: shuffle files go when the execution that made them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; its shuffle files, not needed any more, are dropped."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return write_and_read(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about ``limit`` bytes of text (a longer text stands alone)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = np.cumsum(np.diff(text_bytes(b.column(column))[1]))
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets of each value) of a string or binary array without copies; null counts as empty."""
    large = pa.large_binary() if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else pa.large_string()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_large_binary(large) else "")
    arr = arr.cast(large)
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset: arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


class Words:
    """Words of consecutive texts: runs of bytes that are not separators.

    ``norm`` holds every word followed by one space; word i is
    ``norm[start[i]: start[i] + size[i]]``; text d has the words
    ``first[d]`` to ``first[d + 1] - 1``.
    """

    def __init__(self, arr: pa.Array, separators: np.ndarray = ASCII_WS, mapped: np.ndarray | None = None):
        data, offsets = text_bytes(arr)
        if mapped is not None:
            data = mapped[data]
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.origin = begin  # byte positions in the texts put end to end
        self.offsets = offsets
        self.size = end - begin
        self.start = np.cumsum(self.size + 1) - (self.size + 1)
        self.packed = data[inside]
        space = np.zeros(int(self.size.sum()) + len(self.size), bool)
        space[self.start + self.size] = True
        self.norm = np.full(len(space), 32, np.uint8)
        self.norm[~space] = self.packed
        self.first = np.searchsorted(begin, offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.size)

    def arrow(self) -> pa.Array:
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.size, out=offsets[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(self),
                                     [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.packed))])

    def encoded(self) -> tuple[np.ndarray, list[bytes]]:
        """(index of each word in the list, list of the different words)."""
        if not len(self):
            return np.zeros(0, np.int64), []
        d = self.arrow().dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every task: eight bytes of all words at a time, long words one by one."""
        h = self.size.astype(np.uint64) * _MIX[0]
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.norm, np.zeros(8, np.uint8)]), 8)
        live = np.arange(len(self))
        with np.errstate(over="ignore"):
            for at in range(0, LONG_WORD, 8):
                live = live[self.size[live] > at]
                if not len(live):
                    break
                part = eight[self.start[live] + at].view("<u8").ravel() & _LOW_BYTES[np.minimum(self.size[live] - at, 8)]
                x = (h[live] ^ part) * _MIX[1]
                h[live] = x ^ x >> np.uint64(29)
            h *= _MIX[2]
        h ^= h >> np.uint64(32)
        view = memoryview(self.norm)
        for i in np.flatnonzero(self.size > LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(view[self.start[i]: self.start[i] + self.size[i]])
        return h

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def binary_slices(norm: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary array of (overlapping) pieces of ``norm``."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(norm[at])]) \
        .cast(pa.binary())


def group_by_value(sorted_values: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
