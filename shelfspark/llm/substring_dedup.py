"""Exact substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Each window belongs to the
bucket of its minimiser (least hash among its words, long words first); consecutive windows
that share it travel together as one packed string, so a word is shuffled about
three times instead of ``k`` times. Inside a bucket, sorting brings equal
windows together; equal hashes are compared word by word.

Before anything travels, equal strings of one slice of texts are put together:
only those of the smallest document go on, the others are ranges to remove
already. So a passage that fills a third of the corpus sends one string a slice.

Hot buckets. A count of super-k-mers by hashed minimiser over all documents
(a fixed number of slots) names the slots far above the mean. Their windows are
dealt one by one, by a hash of all their words. A bucket that outgrows a task's
buffer all the same hands its windows to an aggregate under their own 128-bit
key, combined map-side and joined back with salts, so no bucket is held whole.

Defined cases: null or empty texts have no words; a row whose doc_id is null
keeps all its words and never counts as a smaller document; rows that repeat a
doc_id are one document for the comparison, and each row is returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ONLY_SPACE, SLICE_BYTES, Words, batch, binary_slices, documents, group_by_value, materialize, shipped, slices, text_bytes

WINDOW = 13
#: Slots of the fixed-size count of minimisers.
SLOTS = 1 << 16
#: A slot is hot above this many super-k-mers and above HOT_SHARE times the mean slot.
HOT_MIN, HOT_SHARE = 20_000, 4
#: Rows of a bucket that a task holds at most before it hands the bucket over.
BUFFER_ROWS = 100_000
#: Windows of one packed string at most (a text of one repeated word has a single minimiser).
RUN_WINDOWS = 32
#: Words shorter than this many bytes are minimisers only where a window has no longer one.
SHORT_WORD = 6
#: Ways into which the windows of a hot key are dealt where they meet their least document.
SALTS = 16

#: What is shuffled most is packed most: the bucket and the place of the first word in one long; document, tkey and
#: string in one binary. Without a string, a range of words that is known to go: document, tkey and its length.
_RUNS = "key long, packed binary"
_HEAD, _RANGE = 12, 16
_RANGES = "over boolean, wkey binary, doc_id long, tkey int, pos int, len int"


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every window."""
    n = np.maximum(words.count - k + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.first[:-1], n)
    return at, text


def _minimisers(words: Words, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The least word key, 32 bits, of the window that starts at each word of ``at``; the keys of all words."""
    h = (words.hashes() >> np.uint64(33)).astype(np.uint32) | (words.size < SHORT_WORD).astype(np.uint32) << np.uint32(31)
    # Least of k neighbours by doubling: spans of 1, 2, 4, ... and one overlapping rest.
    least, span = h, 1
    while span * 2 <= k:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = k - span
    return (np.minimum(least[at], least[at + rest]) if rest else least[at]), h


def _runs(key: np.ndarray, text: np.ndarray, at: np.ndarray, limit: int, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and length, in windows, of runs with one key in one text, of ``limit`` windows at most; ``alone``: windows that are runs."""
    cut = np.ones(len(key), bool)
    cut[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(cut)
    since = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    cut |= since % limit == 0
    if alone is not None:
        cut |= alone
    begin = np.flatnonzero(cut)
    return begin, np.diff(np.append(begin, len(key)))


def _window_sums(h: np.ndarray, k: int) -> np.ndarray:
    """Multilinear hash of the k words from each word on."""
    with np.errstate(over="ignore"):
        sums = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            sums += h[j:j + len(sums)] * _mult(j)
    return sums


def _slot(key: np.ndarray) -> np.ndarray:
    return (key & np.uint32(SLOTS - 1)).astype(np.int64)


def count_slots(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of this task by slot."""
    total = np.zeros(SLOTS, np.int64)
    for b in slices(batches):
        words = Words(b.column("text"))
        at, text = _windows(words, k)
        if len(at):
            key, _ = _minimisers(words, at, k)
            begin, _ = _runs(key, text, at, RUN_WINDOWS)
            total += np.bincount(_slot(key[begin]), minlength=SLOTS)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(found, pa.int32()), "n": pa.array(total[found], pa.int64())})


def super_kmers(batches: Iterator[pa.RecordBatch], k: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per run of windows that share a minimiser (in hot slots, per window), and ranges that a slice decides by itself."""
    schema = _arrow_schema(_RUNS)
    for b in slices(batches):
        words = Words(b.column("text"))
        at, text = _windows(words, k)
        if not len(at):
            continue
        key, h = _minimisers(words, at, k)
        alone = hot[_slot(key)]
        begin, n = _runs(key, text, at, RUN_WINDOWS, alone)
        bucket = key[begin]
        if alone.any():
            by_words = (_window_sums(h.astype(np.uint64), k)[at[begin]] >> np.uint64(32)).astype(np.uint32)
            bucket = np.where(alone[begin], by_words, bucket)
        row, first, last = text[begin], at[begin], at[begin] + n + k - 2
        start = words.start[first]
        packed = binary_slices(words.norm, start, words.start[last] + words.size[last] - start)
        doc = b.column("doc_id").to_numpy(zero_copy_only=False)
        same = packed.dictionary_encode()
        code = same.indices.to_numpy(zero_copy_only=False)
        least = np.full(len(same.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(least, code, doc[row])
        late = doc[row] > least[code]
        tkey = b.column("tkey").to_numpy(zero_copy_only=False)
        go = np.flatnonzero(~late)
        yield batch(schema, key=_key(bucket[go], first[go] - words.first[row[go]]),
                    packed=_packed(doc[row[go]], tkey[row[go]], packed.take(pa.array(go))))
        if late.any():
            row, first, last = row[late], first[late], last[late]
            new = np.ones(len(row), bool)  # ranges of one text that touch are one range
            new[1:] = (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(row)) - 1
            row, first, last = row[head], first[head], last[tail]
            spread = (doc[row].astype(np.uint64) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            length = (last - first + 1).astype("<i4").view(np.uint8)
            yield batch(schema, key=_key(spread, first - words.first[row]),
                        packed=_packed(doc[row], tkey[row], binary_slices(length, np.arange(len(row)) * 4, np.full(len(row), 4))))


def _key(bucket: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (bucket.view(np.int32).astype(np.int64) << 32) | pos


def _packed(doc: np.ndarray, tkey: np.ndarray, strings: pa.Array) -> pa.Array:
    """doc and tkey, then the string, of each row."""
    head = np.concatenate([doc.astype("<i8").view(np.uint8).reshape(-1, 8), tkey.astype("<i4").view(np.uint8).reshape(-1, 4)], axis=1)
    head = pa.Array.from_buffers(pa.binary(_HEAD), len(doc), [None, pa.py_buffer(np.ascontiguousarray(head))]).cast(pa.binary())
    return pc.binary_join_element_wise(head, strings, pa.scalar(b"", pa.binary()))


def _documents(packed: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(packed)
    return np.ascontiguousarray(data[offsets[:-1, None] + np.arange(8)]).view("<i8").ravel()


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """doc, tkey and the rest of each row."""
    data, offsets = text_bytes(packed)
    at = offsets[:-1, None] + np.arange(_HEAD)
    head = data[at]
    rest = np.ones(len(data), bool)
    rest[at.ravel()] = False
    tail = pa.Array.from_buffers(pa.large_binary(), len(packed), [None, pa.py_buffer(offsets - _HEAD * np.arange(len(offsets))), pa.py_buffer(data[rest])])
    return np.ascontiguousarray(head[:, :8]).view("<i8").ravel(), np.ascontiguousarray(head[:, 8:]).view("<i4").ravel(), tail


def _window_keys(words: Words, at: np.ndarray, k: int) -> list[bytes]:
    start, last = words.start[at], at + k - 1
    end = words.start[last] + words.size[last]
    norm = memoryview(words.norm)
    return [xxhash.xxh3_128_digest(norm[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def _mult(j: int) -> np.uint64:
    """Odd multiplier of a window's j-th word."""
    return np.uint64(xxhash.xxh64_intdigest(b"%d" % j) | 1)


def _equal_strings(words: Words, a: np.ndarray, b: np.ndarray, k: int) -> bool:
    """Whether the windows at ``a`` and ``b`` hold the same words, pair by pair: their strings are compared byte by byte."""
    start, other = words.start[a], words.start[b]
    size = words.start[a + k - 1] + words.size[a + k - 1] - start
    if (words.start[b + k - 1] + words.size[b + k - 1] - other != size).any():
        return False
    step = max(1, SLICE_BYTES // max(1, int(size.max(initial=0))))
    for i in range(0, len(size), step):
        one, two = (binary_slices(words.norm, x[i: i + step], size[i: i + step]) for x in (start, other))
        if not one.equals(two):
            return False
    return True


def repeated_windows(words: Words, at: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """For each window, whether the same words also start in a smaller document. Exact: equal hashes are compared."""
    sums = _window_sums(words.hashes(), k)[at]  # multilinear over the hashes of the k words
    order = np.argsort(sums)
    first = group_by_value(sums[order])
    same = np.ones(len(order), bool)
    same[first] = False
    pair = np.flatnonzero(same)
    if not _equal_strings(words, at[order[pair]], at[order[pair - 1]], k):  # two different windows share a hash
        index, _ = words.encoded()
        columns = np.stack([index[at + j] for j in range(k)])
        order = np.lexsort(columns)
        first = np.flatnonzero(np.concatenate(([True], (columns[:, order[1:]] != columns[:, order[:-1]]).any(0))))
    least = np.minimum.reduceat(doc[order], first) if len(first) else doc[:0]
    out = np.empty(len(at), bool)
    out[order] = doc[order] > np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def count_buckets(batches: Iterator[pa.RecordBatch], k: int, buffer_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to ranges of repeated words; windows of outgrown buckets come out one by one."""
    schema = _arrow_schema(_RANGES)

    def known(t: pa.Table) -> pa.RecordBatch:
        doc, tkey, length = _unpacked(t.column("packed").combine_chunks())
        return batch(schema, over=np.zeros(len(doc), bool), wkey=pa.nulls(len(doc), pa.binary()), doc_id=doc, tkey=tkey,
                     pos=_place(t), len=text_bytes(length)[0].view("<i4"))

    def _place(t: pa.Table) -> np.ndarray:
        return (t.column("key").to_numpy() & 0xFFFFFFFF).astype(np.int32)

    def ranges(t: pa.Table) -> pa.RecordBatch:
        # A bucket of a single document has nothing to compare.
        doc = _documents(t.column("packed").combine_chunks())
        begin = group_by_value(t.column("key").to_numpy() >> 32)
        several = np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)
        t = t.filter(pa.array(np.repeat(several, np.diff(np.append(begin, len(doc))))))
        doc, tkey, strings = _unpacked(t.column("packed").combine_chunks())
        words = Words(strings, ONLY_SPACE)
        at, row = _windows(words, k)
        hit = repeated_windows(words, at, doc[row], k)
        row, place = row[hit], (at - words.first[row])[hit]
        begin, n = _runs(row, row, place, 1 << 30)
        row, place = row[begin], place[begin]
        return batch(schema, over=np.zeros(len(row), bool), wkey=pa.nulls(len(row), pa.binary()), doc_id=doc[row], tkey=tkey[row],
                     pos=_place(t)[row] + place.astype(np.int32), len=(n + k - 1).astype(np.int32))

    def handed_over(t: pa.Table) -> pa.RecordBatch:
        doc, tkey, strings = _unpacked(t.column("packed").combine_chunks())
        words = Words(strings, ONLY_SPACE)
        at, row = _windows(words, k)
        return batch(schema, over=np.ones(len(row), bool), wkey=pa.array(_window_keys(words, at, k), pa.binary()), doc_id=doc[row],
                     tkey=tkey[row], pos=_place(t)[row] + (at - words.first[row]).astype(np.int32), len=np.full(len(row), k, np.int32))

    held: pa.Table | None = None
    outgrown: int | None = None  # the bucket being handed over
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        plain = pc.equal(pc.binary_length(t.column("packed")), _RANGE)
        if pc.any(plain).as_py():
            yield known(t.filter(plain))
            t = t.filter(pc.invert(plain))
        held = t if held is None else pa.concat_tables([held, t])
        if outgrown is not None:
            n = int(np.searchsorted(held.column("key").to_numpy() >> 32, outgrown, "right"))
            if n:
                yield handed_over(held.slice(0, n))
                held = held.slice(n)
            if held.num_rows:
                outgrown = None
        if held.num_rows >= buffer_rows:
            bucket = held.column("key").to_numpy() >> 32
            n = int(np.searchsorted(bucket, bucket[-1], "left"))  # the last bucket may go on
            if n:
                yield ranges(held.slice(0, n))
            else:
                outgrown = int(bucket[-1])
                yield handed_over(held)
                n = held.num_rows
            held = held.slice(n)
    if held is not None and held.num_rows:
        yield handed_over(held) if outgrown is not None else ranges(held)


def removed_ranges(keys: DataFrame, k: int = WINDOW, hot_min: int = HOT_MIN, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """(doc_id, tkey, pos, len): words covered by a window that also starts in a smaller document."""
    spark = keys.sparkSession
    shipped(spark)
    docs = keys.where(F.col("doc_id").isNotNull()).select("doc_id", "tkey", "text")
    counted = docs.select("text").mapInArrow(lambda it: count_slots(it, k), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # At most SLOTS rows reach the driver, whatever the input.
    slots = counted.collect()
    total = sum(r.n for r in slots)
    hot = np.zeros(SLOTS, bool)
    hot[[r.slot for r in slots if r.n > max(hot_min, HOT_SHARE * total / SLOTS)]] = True

    runs = docs.mapInArrow(lambda it: super_kmers(it, k, hot), _RUNS)
    found = materialize(runs.repartition(F.shiftright("key", 32)).sortWithinPartitions("key")
                        .mapInArrow(lambda it: count_buckets(it, k, buffer_rows), _RANGES), "superkmer-ranges")
    single = found.where("over").select("wkey", "doc_id", "tkey", "pos")
    least = single.groupBy("wkey").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    late = single.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")) \
        .join(least.select("wkey", "least", salts.alias("salt")), ["wkey", "salt"]).where(F.col("doc_id") > F.col("least"))
    return (found.where(~F.col("over")).select("doc_id", "tkey", "pos", "len")
            .unionByName(late.select("doc_id", "tkey", "pos", F.lit(k).alias("len"))))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way to their ranges: a text crosses the network once, at about a third of its size."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in slices(batches):
        data, offsets = text_bytes(b.column("text"))
        view = memoryview(data)
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "tkey": b.column("tkey"), "text": pa.array(
            [pack(view[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())})


def _unsqueezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in slices(batches, limit=SLICE_BYTES // 4):
        texts = pa.array([unpack(x) for x in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([texts if n == "text" else b.column(n) for n in b.schema.names], names=b.schema.names)


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in _unsqueezed(batches):
        words = Words(b.column("text"))
        keep = np.ones(len(words), np.int32)
        spans = b.column("spans")
        if len(spans) != spans.null_count:
            flat = spans.flatten()
            owner = np.repeat(np.arange(len(spans)), np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
            begin = words.first[owner] + flat.field("pos").to_numpy(zero_copy_only=False)
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, begin + flat.field("len").to_numpy(zero_copy_only=False), -1)
            keep = (np.cumsum(step[:-1]) == 0).astype(np.int32)
        kept = np.concatenate(([0], np.cumsum(keep)))
        n_kept = kept[words.first[1:]] - kept[words.first[:-1]]
        there = np.repeat(keep.astype(bool), words.size + 1)
        data = words.norm[there]
        width = np.concatenate(([0], np.cumsum((words.size + 1) * keep)))
        texts = [bytes(data[s:max(s, e - 1)]) for s, e in zip(width[words.first[:-1]], width[words.first[1:]], strict=True)]
        cols = {"doc_id": b.column("doc_id"), "n_words": pa.array(words.count, pa.int64()),
                "n_removed": pa.array(words.count - n_kept, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts])}
        if with_text:
            cols["kept"] = pa.array([t.decode() for t in texts], pa.string())
        yield pa.RecordBatch.from_pydict(cols)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, tkey: zero but for ids that repeat, where a hash of the text tells the rows apart."""
    keys = documents(docs)
    # A written table, so that it is broadcast where it is small by its size on disk, and joined where it is not.
    again = materialize(keys.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")), "repeated-ids")
    return keys.join(again, F.col("doc_id") == F.col("_again"), "left").select(
        "doc_id", "text", F.when(F.col("_again").isNull(), 0).otherwise(F.hash("text")).alias("tkey"))


def dedup_substrings(docs: DataFrame, k: int = WINDOW, with_text: bool = False, **limits) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    keys = _keyed(docs)
    spans = removed_ranges(keys, k, **limits).groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("pos", "len")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    texts = keys.mapInArrow(_squeeze, "doc_id long, tkey int, text binary")
    return texts.join(spans, ["doc_id", "tkey"], "left").select("doc_id", "text", "spans").mapInArrow(lambda it: _cut(it, with_text), schema)
