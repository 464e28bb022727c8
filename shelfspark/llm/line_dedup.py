"""Line dedup with a sharded minimal perfect hash.

Lines that occur in at least two documents are counted once by a distributed
aggregate (distinct documents, largest document). Their 128-bit hashes are cut
into shards; each shard gets a minimal perfect hash over its hashes (hash and
displace: buckets of about four hashes, one displacement each; single ones go
straight to the free slots), which indexes four arrays without gaps: a 64-bit
fingerprint, the document count (saturating) and the largest doc_id. Documents
probe these arrays in place; no line of a document is joined with a table.

If all arrays fit ``block_bytes`` (their size is measured first) they are sent to
the tasks, and documents probe them in place. Beyond that the shards are cut into
blocks of that size, and each line hash travels once to its block's arrays; a
block with many lines is dealt out to several parts. The work follows the number
of lines, and no line is left out.

Defined cases: null and empty texts are one empty line; a row whose doc_id is
null keeps all lines and does not count as a document; rows that repeat a doc_id
are one document for the count, and each row is returned; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, keyed, materialize, shipped

MIN_CHARS = 40
MIN_DOCS = 5
#: Lines in fewer documents than this are not indexed; they can lose nothing.
INDEX_MIN_DOCS = 2
SHARD_KEYS = 4096
#: Bytes of arrays that a task holds: all of them, if they are no more, else one block of shards.
BLOCK_BYTES = 64 << 20
#: Lines that probe one copy of a block's arrays.
PART_LINES = 4_000_000
_ARRAYS = ["move", "prints", "counts", "lasts", "aside"]
_COUNT_MAX = np.iinfo(np.uint32).max
_BUCKET_KEYS = 4


def line_keys(text: str, min_chars: int = MIN_CHARS) -> tuple[list[str], list[int], list[bytes]]:
    """The lines, and number and 16-byte hash of those whose key is long enough."""
    lines = text.split("\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip("\t\n\x0b\x0c\r ")
            if len(key) >= min_chars:
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(key.encode().lower()))  # bytes.lower() changes A-Z only
    return lines, at, digests


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _occurrences(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            ids, found = [], []
            for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = set(line_keys(text, min_chars)[2])
                found += own
                ids += [d] * len(own)
            h = _halves(found).view(np.int64)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[:, 0]), "g": pa.array(h[:, 1]), "doc_id": pa.array(ids, pa.int64())})


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS, index_min_docs: int = INDEX_MIN_DOCS) -> DataFrame:
    """(h, g, n, last): halves of a line key's hash, its documents, the largest of them."""
    seen = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text") \
        .mapInArrow(lambda it: _occurrences(it, min_chars), "h long, g long, doc_id long").distinct()
    return seen.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= index_min_docs)


def _mix(h: np.ndarray, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def build_shard(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each hash) of a minimal perfect hash over different 64-bit hashes.

    A displacement d >= 0 sends a bucket's hashes to ``mix(h, d + 1) % n``; d < 0 names the slot ``-d - 1`` directly.
    """
    n = len(h)
    n_buckets = max(1, -(-n // _BUCKET_KEYS))
    bucket = (_mix(h, 0) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=n_buckets)
    begin = np.cumsum(size) - size
    taken, slot, move = np.zeros(n, bool), np.full(n, -1, np.int64), np.zeros(n_buckets, np.int64)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own = order[begin[b]:begin[b] + size[b]]
        d = 0
        while True:  # 64 displacements at a time
            to = (_mix(h[own][None, :], np.arange(d + 1, d + 65)[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[to].any(1)
            free[free] &= (np.diff(np.sort(to[free], axis=1), axis=1) != 0).all(1)
            if free.any():
                break
            d += 64
        k = int(np.argmax(free))
        move[b], slot[own] = d + k, to[k]
        taken[to[k]] = True
    single = np.flatnonzero(size == 1)
    rest = np.flatnonzero(~taken)[:len(single)]
    move[single] = -rest - 1
    slot[order[begin[single]]] = rest
    return move, slot


def _shard_arrays(key: tuple, t: pa.Table) -> pa.Table:
    h = t.column("h").to_numpy().view(np.uint64)
    # Equal first halves of different lines: one of them stands aside, in a list that is searched by both halves.
    _, first = np.unique(h, return_index=True)
    main = np.zeros(len(h), bool)
    main[first] = True
    columns = [t.column("g").to_numpy().view(np.uint64), np.minimum(t.column("n").to_numpy(), _COUNT_MAX).astype(np.uint32),
               t.column("last").to_numpy()]
    move, slot = build_shard(h[main])
    arrays = []
    for c in columns:
        a = np.empty(int(main.sum()), c.dtype)
        a[slot] = c[main]
        arrays.append(a)
    aside = np.stack([h[~main], *(c[~main].astype(np.int64).view(np.uint64) for c in columns)]) if (~main).any() else np.zeros((4, 0), np.uint64)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n_keys": pa.array([len(slot)], pa.int64()),
                     "move": pa.array([move.astype(np.int32).tobytes()], pa.binary()), "prints": pa.array([arrays[0].tobytes()], pa.binary()),
                     "counts": pa.array([arrays[1].tobytes()], pa.binary()), "lasts": pa.array([arrays[2].tobytes()], pa.binary()),
                     "aside": pa.array([aside.tobytes()], pa.binary())})


def _n_shards(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def shard_of(h: np.ndarray, n_shards: int) -> np.ndarray:
    return ((h >> np.uint64(1)) % np.uint64(n_shards)).astype(np.int64)


def build_index(counts: DataFrame) -> tuple[DataFrame, int]:
    """The written shards (one row each) and their number."""
    counts = materialize(counts, "line-counts")
    n_shards = _n_shards(counts.count())
    shard = F.shiftrightunsigned("h", 1) % n_shards
    rows = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(
        _shard_arrays, "shard long, n_keys long, move binary, prints binary, counts binary, lasts binary, aside binary")
    return materialize(rows, "line-shards"), n_shards


class LineIndex:
    """Some shards' arrays end to end; probes are vectorised over many hashes."""

    def __init__(self, rows: list, n_shards: int):
        rows = sorted(rows, key=lambda r: r["shard"])
        self.n_shards = n_shards
        self.place = np.full(n_shards, -1, np.int64)
        self.place[[r["shard"] for r in rows]] = np.arange(len(rows))
        parts = {k: [np.frombuffer(r[k], t) for r in rows] for k, t in
                 (("move", np.int32), ("prints", np.uint64), ("counts", np.uint32), ("lasts", np.int64))}
        self.n_keys = np.array([r["n_keys"] for r in rows], np.uint64)
        self.n_buckets = np.array([len(x) for x in parts["move"]], np.uint64)
        self.first_key = np.cumsum(self.n_keys) - self.n_keys
        self.first_bucket = np.cumsum(self.n_buckets) - self.n_buckets
        self.move, self.prints, self.counts, self.lasts = (np.concatenate(parts[k]) if rows else np.zeros(0, np.int64)
                                                           for k in ("move", "prints", "counts", "lasts"))
        self.aside = np.concatenate([np.frombuffer(r["aside"], np.uint64).reshape(4, -1) for r in rows], axis=1) if rows else np.zeros((4, 0), np.uint64)

    def probe(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, largest document) of each line hash; (0, 0) for those not in these shards."""
        n, last = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        place = self.place[shard_of(h, self.n_shards)]
        at = np.flatnonzero(place >= 0)
        if not len(at):
            return n, last
        place, hh = place[at], h[at]
        bucket = (_mix(hh, 0) % self.n_buckets[place]).astype(np.int64)
        move = self.move[self.first_bucket[place].astype(np.int64) + bucket].astype(np.int64)
        slot = np.where(move < 0, -move - 1, (_mix(hh, np.maximum(move, 0) + 1) % self.n_keys[place]).astype(np.int64))
        slot += self.first_key[place].astype(np.int64)
        hit = self.prints[slot] == g[at]
        n[at[hit]], last[at[hit]] = self.counts[slot[hit]], self.lasts[slot[hit]]
        for x in self.aside.T:
            same = (h == x[0]) & (g == x[1])
            n[same], last[same] = x[2], x[3].view(np.int64)
        return n, last


def _drops(index: LineIndex, ids: np.ndarray, h: np.ndarray, min_docs: int) -> np.ndarray:
    n, last = index.probe(h[:, 0], h[:, 1])
    return (n >= min_docs) & (last != ids)


def _result(ids, texts: list[str], dropped: list[set | None], min_chars: int, with_text: bool) -> pa.RecordBatch:
    n_lines, kept = [], []
    for text, out in zip(texts, dropped, strict=True):
        lines = text.split("\n")
        n_lines.append(len(lines))
        kept.append("\n".join([x for i, x in enumerate(lines) if i not in out]) if out else text)
    cols = {"doc_id": ids, "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array([len(x or ()) for x in dropped], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string())}
    if with_text:
        cols["kept"] = pa.array(kept, pa.string())
    return pa.RecordBatch.from_pydict(cols)


def _apply(batches: Iterator[pa.RecordBatch], sent, min_chars: int, min_docs: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Probe the arrays and drop lines, 500 rows at a time."""
    index = _local(sent)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            owner, number, digests = [], [], []
            for d, text in enumerate(texts):
                if ids[d] is not None:
                    _, lines, own = line_keys(text, min_chars)
                    owner += [d] * len(own)
                    number += lines
                    digests += own
            dropped: list[set | None] = [None] * len(texts)
            if digests:
                out = _drops(index, np.array([ids[d] for d in owner]), _halves(digests), min_docs)
                for i in np.flatnonzero(out).tolist():
                    if dropped[owner[i]] is None:
                        dropped[owner[i]] = set()
                    dropped[owner[i]].add(number[i])
            yield _result(b.column("doc_id"), texts, dropped, min_chars, with_text)


_INDEX: dict = {}


def _local(sent) -> LineIndex:
    """The shards that were sent; built once per Python worker."""
    if sent.value[0] not in _INDEX:
        _INDEX.clear()
        _INDEX[sent.value[0]] = LineIndex(sent.value[1], sent.value[2])
    return _INDEX[sent.value[0]]


def _line_table(batches: Iterator[pa.RecordBatch], min_chars: int, n_shards: int, per_block: int) -> Iterator[pa.RecordBatch]:
    """One row for each row and block of shards: its line numbers and hashes there."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            found = [line_keys(t, min_chars)[1:] for t in b.column("text").to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            if not len(owner):
                continue
            number = np.array([i for x in found for i in x[0]], np.int32)
            h = _halves([d for x in found for d in x[1]])
            block = shard_of(h[:, 0], n_shards) // per_block
            order = np.lexsort((block, owner))
            owner, block, number, h = owner[order], block[order], number[order], h[order]
            begin = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]))))
            edge = np.append(begin, len(owner))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id").take(pa.array(owner[begin])), "tkey": b.column("tkey").take(pa.array(owner[begin])),
                "block": pa.array(block[begin]), "lines": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(number)),
                "hashes": pa.array([h[x:y].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())})


def _block_drops(batches: Iterator[pa.RecordBatch], n_shards: int, min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and part, a block's arrays before the lines that probe them, to (doc_id, tkey, dropped)."""
    now, arrays, index = None, [], None
    for b in batches:
        place = np.stack([b.column("block").to_numpy(), b.column("part").to_numpy()])
        edge = np.concatenate(([0], np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1, [b.num_rows])) if b.num_rows else [0]
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            if now != tuple(place[:, x]):
                now, arrays, index = tuple(place[:, x]), [], None
            run = b.slice(int(x), int(y - x))
            own = pa.compute.is_valid(run.column("shard"))
            arrays += run.filter(own).select(["shard", "n_keys", *_ARRAYS]).to_pylist()
            lines = run.filter(pa.compute.invert(own))
            if not lines.num_rows:
                continue
            if index is None:
                index, arrays = LineIndex(arrays, n_shards), []
            count = lines.column("lines").value_lengths().to_numpy()
            out = _drops(index, np.repeat(lines.column("doc_id").to_numpy(), count), _halves(lines.column("hashes").to_pylist()), min_docs)
            row = np.repeat(np.arange(len(count)), count)[out]
            hit = np.unique(row)
            dropped = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(row, hit), len(row)), pa.int32()),
                                               lines.column("lines").flatten().filter(pa.array(out)))
            yield pa.RecordBatch.from_pydict({"doc_id": lines.column("doc_id").take(pa.array(hit)),
                                              "tkey": lines.column("tkey").take(pa.array(hit)), "dropped": dropped})


def _apply_dropped(batches: Iterator[pa.RecordBatch], min_chars: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            dropped = [{y for x in p for y in x} if p else None for p in b.column("dropped").to_pylist()]
            yield _result(b.column("doc_id"), b.column("text").to_pylist(), dropped, min_chars, with_text)


class _prepare:
    """The shards of a table's lines and, where they are more than ``block_bytes``, what the blocks of shards decide."""

    def __init__(self, docs: DataFrame, min_chars: int, min_docs: int, block_bytes: int):
        self.spark, self.min_chars, self.min_docs = docs.sparkSession, min_chars, min_docs
        shipped(self.spark)
        self.keys = keyed(docs)
        self.shards, self.n_shards = build_index(line_counts(self.keys, min_chars, min(INDEX_MIN_DOCS, min_docs)))
        size = self.shards.agg(F.sum(sum((F.length(c) for c in _ARRAYS), F.lit(0)))).first()[0] or 0
        self.blocks = max(1, -(-size // block_bytes))
        self.per_block = -(-self.n_shards // self.blocks)  # hashes fill the shards evenly, so the blocks too

    def send(self):
        """All shards, of ``block_bytes`` at most, to all tasks."""
        return self.spark.sparkContext.broadcast((uuid.uuid4().hex, [r.asDict() for r in self.shards.collect()], self.n_shards))

    def dropped(self) -> DataFrame:
        """(doc_id, tkey, dropped: lists of line numbers). The lines travel to the arrays of their block, once.

        A block is dealt out to as many parts as its lines need, each with a copy of its arrays, so a line that fills a
        third of all documents is spread too.
        """
        n_shards, per_block, min_docs, min_chars = self.n_shards, self.per_block, self.min_docs, self.min_chars
        lines = materialize(self.keys.where(F.col("doc_id").isNotNull()).select("doc_id", "tkey", "text").mapInArrow(
            lambda it: _line_table(it, min_chars, n_shards, per_block),
            "doc_id long, tkey int, block long, lines array<int>, hashes binary"), "line-hashes")
        parts = lines.groupBy("block").agg(F.ceil(F.sum(F.size("lines")) / PART_LINES).cast("int").alias("parts"))
        parts = materialize(parts, "line-blocks")
        dealt = lines.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("doc_id", "tkey"), F.col("parts")).cast("int")).drop("parts")
        copies = self.shards.withColumn("block", F.floor(F.col("shard") / per_block)).join(parts, "block") \
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        both = copies.unionByName(dealt, allowMissingColumns=True).repartition("block", "part") \
            .sortWithinPartitions("block", "part", F.col("shard").asc_nulls_last())
        found = both.mapInArrow(lambda it: _block_drops(it, n_shards, min_docs), "doc_id long, tkey int, dropped array<int>")
        return found.distinct().groupBy("doc_id", "tkey").agg(F.collect_list("dropped").alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = False,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, the kept text."""
    prepared = _prepare(docs, min_chars, min_docs, block_bytes)
    keys = prepared.keys
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if with_text else "")
    if prepared.blocks == 1:
        sent = prepared.send()
        return keys.select("doc_id", "text").mapInArrow(lambda it: _apply(it, sent, min_chars, min_docs, with_text), schema)
    return keys.join(prepared.dropped(), ["doc_id", "tkey"], "left").select("doc_id", "text", "dropped") \
        .mapInArrow(lambda it: _apply_dropped(it, min_chars, with_text), schema)


def _rewrite(batches: Iterator[pa.RecordBatch], sent, min_chars: int, min_docs: int) -> Iterator[pa.RecordBatch]:
    """The rows with all their columns, their text without the dropped lines."""
    for whole in batches:
        names = whole.schema.names
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            text, ids = b.column("text"), b.column("doc_id").cast(pa.int64())
            plain = pa.RecordBatch.from_pydict({"doc_id": ids, "text": text.fill_null("")})
            kept = next(_apply(iter([plain]), sent, min_chars, min_docs, True)).column("kept")
            kept = pa.compute.if_else(text.is_null(), pa.scalar(None, pa.string()), kept)
            yield pa.RecordBatch.from_arrays([kept if n == "text" else b.column(n) for n in names], names=names)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without the repeated lines of their texts."""
    prepared = _prepare(docs, min_chars, min_docs, block_bytes)
    if prepared.blocks == 1:
        sent = prepared.send()
        return docs.mapInArrow(lambda it: _rewrite(it, sent, min_chars, min_docs), docs.schema)
    i, k, gone = free_names(docs, "of_id", "of_text", "gone")
    dropped = prepared.dropped().withColumnsRenamed({"doc_id": i, "tkey": k, "dropped": gone})
    key = F.hash(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(dropped, (F.col("doc_id").cast("long") == F.col(i)) & (key == F.col(k)), "left")
    lines = F.split("text", "\n", -1)
    out = F.flatten(F.coalesce(gone, F.array().cast("array<array<int>>")))
    kept = F.filter(lines, lambda x, at: ~F.array_contains(out, at))
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))) \
        .select(*(F.col(f"`{c}`") for c in docs.columns))
