"""Target-distribution importance resampling with segment deduplication.

Documents are drawn so that their hashed n-gram features resemble a target, the
benchmark. A text's words fall into lines at its line feeds. Most lines of a
corpus repeat, so each different line (as its words) has its features hashed once:
the table of lines holds a line's buckets and how often it occurs. The corpus
counts of a bucket are the lines' counts times their occurrences, plus the
n-grams that reach across line ends, which each document adds by itself. Both
parts together are all runs of 1 to 3 words of a text, as if it had never been cut.

A bucket's gain compares its share of the target with its share of the corpus.
The weight of a line is the sum of its buckets' gains, computed once; a document
is the sum over its lines and its own runs across lines. Drawing without
replacement is by Gumbel noise from a hash of the doc_id: the highest sums of
weight and noise are a sample by weight, the same in every run.

The crc32 of an n-gram is put together from the crc32 of its words, as a checksum
of bytes put end to end is linear in those of its parts.

Scale: texts are read twice, for the table of different lines (one shuffle of
normalised lines, counted before it) and for a short row of each document: digests
of its lines (128 bits of xxh3) and the buckets of runs across them. Lines meet
documents by digest; a line that a third of all documents hold is one row, and
Spark splits the other side. Driver and tasks hold numbers by bucket only. Ranks are numbered
within ranges of the order.

Defined cases: null and empty texts have no features, weight 0, and are never
drawn; a null doc_id has the noise of the text "42:" and comes last among ties;
rows that repeat a doc_id are separate; without a benchmark the target is uniform;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import global_rank
from .common import LOWER, ONLY_SPACE, Words, byte_table, documents, materialize, shipped, slices, text_bytes

BUCKETS = 10_000
MIN_WORDS = 20
DRAWN_PERCENT = 5
SEED = 42

#: ASCII characters that are no digit and no letter.
SEPARATORS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


# crc32 of n-grams --------------------------------------------------------------------------------------------------

def _after_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Tables that move a checksum past zero bytes, by the four bytes of the checksum: past 0 to 63, and past 64, 128, 256, ... bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    few = np.empty((64, 4, 256), np.uint32)
    few[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, 64):
        few[n] = table[few[n - 1] & 255] ^ (few[n - 1] >> 8)
    many = [table[few[63] & 255] ^ (few[63] >> 8)]
    for _ in range(25):
        many.append(_moved(many[-1], many[-1].ravel()).reshape(4, 256))
    return few, np.stack(many)


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_TABLES: list = []


def crc_joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of pairs of byte strings put together, from the crc32 of both and the size of the second."""
    if not _TABLES:
        _TABLES.extend(_after_bytes())
    few, many = _TABLES
    n = size & 63
    out = few[n, 0, first & 255] ^ few[n, 1, (first >> 8) & 255] ^ few[n, 2, (first >> 16) & 255] ^ few[n, 3, first >> 24]
    rest = size >> 6
    for k in range(int(rest.max(initial=0)).bit_length()):  # words of 64 bytes and more
        far = (rest >> k) & 1 == 1
        out[far] = _moved(many[k], out[far])
    return out ^ second


class Grams:
    """Checksums of all runs of one to three words of a slice of texts."""

    def __init__(self, words: Words):
        which, different = words.encoded()
        self.alone = np.fromiter((zlib.crc32(w) for w in different), np.uint32, len(different))[which]
        self.spaced = np.fromiter((zlib.crc32(b" " + w) for w in different), np.uint32, len(different))[which]
        self.size = words.size + 1

    def two(self, i: np.ndarray) -> np.ndarray:
        """Those of the words i and i + 1."""
        return crc_joined(self.alone[i], self.spaced[i + 1], self.size[i + 1])

    def three(self, i: np.ndarray) -> np.ndarray:
        return crc_joined(self.two(i), self.spaced[i + 2], self.size[i + 2])


def _packed(buckets: list[np.ndarray], owner: list[np.ndarray], n: int) -> pa.Array:
    """The buckets of each of ``n`` owners as uint16 in a binary value."""
    b, o = np.concatenate(buckets), np.concatenate(owner)
    b = b[np.argsort(o, kind="stable")].astype("<u2")
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(2 * np.bincount(o, minlength=n), out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(b)]).cast(pa.binary())


# lines and rows ----------------------------------------------------------------------------------------------------

def _segments(b: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, line number of each word, first words of the lines); lines without words have none."""
    words = Words(b.column("text"), SEPARATORS, LOWER)
    feeds = np.flatnonzero(text_bytes(b.column("text"))[0] == 10)
    line = np.searchsorted(feeds, words.origin) + words.text_of()  # grows with every line feed and every text
    return words, line, np.flatnonzero(np.diff(line, prepend=-1))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of the texts, each word followed by one space."""
    for b in slices(batches):
        words, _, first = _segments(b)
        offsets = np.append(words.start[first], len(words.norm)).astype(np.int64) if len(words) else np.zeros(1, np.int64)
        lines = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(words.norm)])
        yield pa.RecordBatch.from_pydict({"line": lines.cast(pa.binary())})


def _line_features(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Digest, occurrences and buckets of each different line."""
    for b in slices(batches, "line"):
        line = b.column("line")
        words = Words(line, ONLY_SPACE)
        grams, of = Grams(words), words.text_of()
        i = np.arange(len(words))
        two, three = i[:-1][of[:-1] == of[1:]], i[:-2][of[:-2] == of[2:]]
        found = [x % buckets for x in (grams.alone, grams.two(two), grams.three(three))]
        yield pa.RecordBatch.from_pydict({
            "key": pa.array([xxhash.xxh3_128_digest(x) for x in line.to_pylist()], pa.binary()), "times": b.column("times"),
            "buckets": _packed(found, [of, of[two], of[three]], len(line))})


def _row_features(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each text: its words, the digests of its lines and how often it has each, the buckets of runs across lines."""
    for b in slices(batches):
        words, line, first = _segments(b)
        grams, of, n = Grams(words), words.text_of(), b.num_rows
        i = np.arange(len(words))
        two = i[:-1][(of[:-1] == of[1:]) & (line[:-1] != line[1:])]
        three = i[:-2][(of[:-2] == of[2:]) & (line[:-2] != line[2:])]
        norm, ends = memoryview(words.norm), np.append(words.start[first], len(words.norm)).tolist()
        own: list[Counter] = [Counter() for _ in range(n)]
        for text, s, e in zip(of[first].tolist(), ends[:-1], ends[1:], strict=True):
            own[text][xxhash.xxh3_128_digest(norm[s:e])] += 1
        yield pa.RecordBatch.from_pydict({
            "row": b.column("row"), "doc_id": b.column("doc_id"), "n_words": pa.array(words.count, pa.int64()),
            "keys": pa.array([list(c) for c in own], pa.list_(pa.binary())), "times": pa.array([list(c.values()) for c in own], pa.list_(pa.int32())),
            "across": _packed([x % buckets for x in (grams.two(two), grams.three(three))], [of[two], of[three]], n)})


def _summed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts by bucket of all rows of the task, times their occurrences."""
    total = np.zeros(buckets, np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            b = whole.slice(at, 20_000)
            times, packed = b.column("times").to_numpy(), b.column("buckets")
            raw = np.frombuffer(b"".join(packed.to_pylist()), "<u2")
            size = pc.binary_length(packed).to_numpy() // 2
            # integers in doubles: exact, a batch is far below 2 ** 53
            total += np.bincount(raw, np.repeat(times, size), buckets).astype(np.int64)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "n": pa.array(total[found], pa.int64())})


class Features:
    """The different lines of a table (key, times, buckets) and a short row of each text (row, doc_id, n_words, keys, times, across)."""

    def __init__(self, docs: DataFrame, buckets: int = BUCKETS):
        if not 0 < buckets <= 1 << 16:
            raise ValueError("buckets must fit in 16 bits")
        shipped(docs.sparkSession)
        self.buckets = buckets
        texts = documents(docs)
        lines = texts.select("text").mapInArrow(_lines, "line binary").groupBy("line").agg(F.count(F.lit(1)).alias("times"))
        self.lines = materialize(lines.mapInArrow(lambda it: _line_features(it, buckets), "key binary, times long, buckets binary"), "lines")
        numbered = texts.withColumn("row", F.monotonically_increasing_id())
        self.rows = materialize(numbered.mapInArrow(
            lambda it: _row_features(it, buckets), "row long, doc_id long, n_words long, keys array<binary>, times array<int>, across binary"), "rows")

    def counts(self) -> np.ndarray:
        """Features of all texts by bucket."""
        n = self.buckets
        parts = self.lines.select("times", "buckets").unionByName(self.rows.select(F.lit(1).cast("long").alias("times"), F.col("across").alias("buckets")))
        summed = parts.mapInArrow(lambda it: _summed(it, n), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        out = np.zeros(n, np.int64)
        for r in summed.collect():  # one row a bucket
            out[r.bucket] = r.n
        return out


# weights and drawing -----------------------------------------------------------------------------------------------

def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, by bucket."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def _weighed(batches: Iterator[pa.RecordBatch], sent, column: str) -> Iterator[pa.RecordBatch]:
    """The rows with n_features and weight in place of their buckets."""
    gain = sent.value[1]
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            b = whole.slice(at, 20_000)
            packed = b.column(column)
            sums = np.concatenate(([0], np.cumsum(gain[np.frombuffer(b"".join(packed.to_pylist()), "<u2")])))
            size = pc.binary_length(packed).to_numpy().astype(np.int64) // 2
            to = np.cumsum(size)
            kept = [c for c in b.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(size), pa.array(sums[to] - sums[to - size])],
                                             names=[*kept, "n_features", "weight"])


def weights(features: Features, gain: np.ndarray) -> DataFrame:
    """Per text: row, doc_id, n_words, n_features, weight."""
    rows = features.rows
    sent = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, gain))
    lines = features.lines.select("key", "buckets").mapInArrow(lambda it: _weighed(it, sent, "buckets"), "key binary, n_features long, weight long")
    held = rows.select("row", F.inline(F.arrays_zip("keys", "times"))).withColumnsRenamed({"keys": "key"})
    inside = held.join(lines, "key").select("row", (F.col("n_features") * F.col("times")).alias("n_features"), (F.col("weight") * F.col("times")).alias("weight"))
    inside = inside.groupBy("row").agg(F.sum("n_features").alias("n_in"), F.sum("weight").alias("w_in"))
    across = rows.select("row", "doc_id", "n_words", "across").mapInArrow(
        lambda it: _weighed(it, sent, "across"), "row long, doc_id long, n_words long, n_features long, weight long")
    zero = F.lit(0).cast("long")
    return across.join(inside, "row", "left").select(
        "row", "doc_id", "n_words", (F.col("n_features") + F.coalesce("n_in", zero)).alias("n_features"),
        (F.col("weight") + F.coalesce("w_in", zero)).alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
             seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank (null: not drawn), n_words."""
    features = Features(docs, buckets)
    wanted = Features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    weighed = weights(features, gains(features.counts(), wanted.counts()))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= min_words).select("score", "doc_id", "row")
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranked = global_rank(able, ["score", "doc_id", "row"], order, unique=True, materialize_input=False)
    ranked = ranked.where(F.col("rank") <= drawn).select(F.col("row").alias("drawn_row"), "rank")
    return scored.join(ranked, F.col("row") == F.col("drawn_row"), "left").select("doc_id", "n_features", "weight", "score", "rank", "n_words")
