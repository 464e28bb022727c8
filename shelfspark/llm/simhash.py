"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at 3 or fewer differing bits meet at a word that is at most one
flip from one of them and two from the other. Every different fingerprint emits
the variants within half the radius; they are shuffled on the variant, and
fingerprints that meet there are verified. Two arguments spare variants that
cannot be needed:

* parity: at distance 3 (or 1) one fingerprint has an even and one an odd number
  of set bits, so only even ones need two flips;
* halves: of three differing bits, two lie in the same 32-bit half, so two flips
  in one half are enough, the odd partner flips the third.

That leaves 64 variants for odd and 1 + 64 + 992 for even fingerprints. All that
meet at a variant lie within two flips of it, so a group is bounded by the
geometry (2,081 words), not by the data. In a group each member is linked to
one hub at most one flip away (distance 3 or less to all), never pair by pair;
members without such a hub are two even ones, which meet at distance 2 at
another variant. Components of the links give the groups.

Defined cases: null and empty texts have the fingerprint zero, linked like any
other; rows that repeat a doc_id are returned each; a null doc_id gets a
component but never names one unless no other id is in it; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, documents, free_names, group_by_value, materialize, shipped, slices
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        words = Words(b.column("text"), mapped=LOWER)
        norm = memoryview(words.norm)
        digest = xxhash.xxh64_intdigest
        out = np.zeros(len(words.count), np.uint64)
        start, end = words.start, words.start + words.size
        for d, n in enumerate(words.count.tolist()):
            if not n:
                continue
            f = words.first[d]
            last = f + max(1, n - width + 1)
            span = min(width, n) - 1
            h = np.array([digest(norm[s:e], SEED) for s, e in zip(start[f:last].tolist(), end[f + span:last + span].tolist(), strict=True)], np.uint64)
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[d] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
        found = {"doc_id": b.column("doc_id"), "fp": pa.array(out.view(np.int64))}
        if "tkey" in b.schema.names:
            found |= {"tkey": b.column("tkey"), "size": pa.array(np.diff(words.offsets))}
        yield pa.RecordBatch.from_pydict(found)


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row, as a signed long."""
    shipped(docs.sparkSession)
    return documents(docs).mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long")


def flips(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks that even and odd fingerprints are flipped by, so that any two within ``radius`` bits meet."""
    none = np.zeros(1, np.uint64)
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(32, 1)
    half = (np.uint64(1) << i.astype(np.uint64)) | (np.uint64(1) << j.astype(np.uint64))
    two = np.concatenate([half, half << np.uint64(32)])
    by_radius = {0: (none, none), 1: (none, np.concatenate([none, one])),
                 2: (np.concatenate([none, one]), one), 3: (np.concatenate([none, one, two]), one)}
    if radius not in by_radius:
        raise ValueError("max_bits must be 0, 1, 2 or 3")
    return by_radius[radius]


def _variants(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    even, odd = flips(radius)
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        is_odd = np.bitwise_count(fp) % 2 == 1
        for part, masks in ((fp[~is_odd], even), (fp[is_odd], odd)):
            step = max(1, 250_000 // len(masks))
            for at in range(0, len(part), step):
                f = part[at:at + step]
                yield pa.RecordBatch.from_pydict({"x": pa.array((f[:, None] ^ masks[None, :]).ravel().view(np.int64)),
                                                  "fp": pa.array(np.repeat(f, len(masks)).view(np.int64))})


def _meet(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by variant to links (a, b) of each member with the hub of its variant."""
    rest = np.zeros((2, 0), np.uint64)

    def links(x: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        begin = group_by_value(x)
        size = np.diff(np.append(begin, len(x)))
        shared = np.repeat(size > 1, size)
        x, fp, size = x[shared], fp[shared], size[size > 1]
        begin = np.cumsum(size) - size
        near = np.bitwise_count(x ^ fp) <= (radius > 1)  # hub and member are never further apart than the radius
        hub = np.minimum.reduceat(np.where(near, fp, np.uint64(2**64 - 1)), begin) if len(begin) else fp[:0]
        some = np.logical_or.reduceat(near, begin) if len(begin) else near[:0]
        hub, some = np.repeat(hub, size), np.repeat(some, size)
        ok = some & (fp != hub) & (np.bitwise_count(fp ^ hub) <= radius)
        pairs = np.unique(np.stack([np.minimum(fp[ok], hub[ok]), np.maximum(fp[ok], hub[ok])]), axis=1)
        return pa.RecordBatch.from_pydict({"a": pa.array(pairs[0].view(np.int64)), "b": pa.array(pairs[1].view(np.int64))})

    for b in batches:
        if not b.num_rows:
            continue
        now = np.stack([b.column("x").to_numpy().view(np.uint64), b.column("fp").to_numpy().view(np.uint64)])
        rest = np.concatenate([rest, now], axis=1) if rest.size else now
        cut = int(np.flatnonzero(rest[0] == rest[0, -1])[0])  # the last variant may go on; it has 2,081 rows at most
        if cut:
            yield links(rest[0, :cut], rest[1, :cut])
            rest = rest[:, cut:]
    if rest.size:
        yield links(rest[0], rest[1])


def links(fps: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all within ``radius`` bits; ``fps`` holds each once."""
    shipped(fps.sparkSession)
    # A fingerprint is eight bytes and its variants a thousand rows: deal them out by number, not by their small size.
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = fps.select("fp").repartition(n).mapInArrow(lambda it: _variants(it, radius), "x long, fp long")
    return v.repartition("x").sortWithinPartitions("x").mapInArrow(lambda it: _meet(it, radius), "a long, b long").distinct()


def components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) of each different fingerprint of ``fps`` (doc_id, fp): its group, and the group's least doc_id."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(nodes, max_bits))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.select("fp", "root").join(least, "root")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    fps = materialize(fingerprints(docs, width), "simhash")
    of = components(fps, max_bits).select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: one of those with its smallest doc_id.

    Of several rows with that doc_id in one group the longest text stays, of equal lengths the one with the greatest hash,
    of rows alike in both one. Rows of one doc_id in different groups all stay, and so do rows without an id.
    """
    shipped(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tkey", F.xxhash64("text"))
    prints = materialize(rows.mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long, tkey long, size long"), "simhash")
    texts = prints.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "tkey", "fp").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    first = texts.join(components(prints, max_bits), "fp").where(F.col("doc_id") == F.col("component_id"))
    kept = first.groupBy("root", "doc_id").agg(F.max(F.struct("size", "tkey", "n")).alias("best"))
    i, k, n = free_names(docs, "kept_id", "kept_text", "kept_n")
    kept = materialize(kept.select(F.col("doc_id").alias(i), F.col("best.tkey").alias(k), F.col("best.n").alias(n)), "simhash-kept")
    same = (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64(text) == F.col(k))
    alone = docs.join(kept.where(F.col(n) == 1), same, "left_semi")
    # Rows alike in id and text become one by an aggregate, which combines them before the shuffle.
    alike = docs.join(kept.where(F.col(n) > 1), same).groupBy(i, k).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return alone.unionByName(alike.select("row.*")).unionByName(docs.where(F.col("doc_id").isNull()))
