"""Approximate nearest neighbours with a permutation index.

Every vector is represented by its ``NEAREST`` nearest pivots in order. A block
of vectors posts them in inverted files, one per pivot, as (vector, place). A
query visits the files of its own nearest pivots and adds up the footrule
distance, the sum of place differences (a pivot missing on one side counts as
standing just behind the last place). Permutations know directions only, while an
inner product also grows with a vector's length: what the shared pivots save of
the largest distance is multiplied by it. Among vectors of one length that is the
order by footrule. The ``CANDIDATES`` first of a block are reranked by the exact
measure, the inner product in double precision on the original vectors.

Scale: the pivots are a bounded sample (``PIVOTS`` vectors); every vector is
indexed. Vectors are dealt to blocks by a hash and travel once; the stated set of
queries runs against all of them, block by block: each query is sent to every
block and streams past its files, and a block returns k rows a query. So neither a
frequent pivot nor a cluster gathers in one task, and a task holds one block. Equal
vectors are indexed once, with the k + 1 smallest of their ids, which is all a
k-nearest result can show of them; that choice is a ranked filter combined before
the shuffle.

Defined cases: vectors that are null, empty, zero, of another length than the
most frequent one, or hold null or non-finite components take no part; rows that
repeat a vec_id are separate vectors, the query's own id never among its
results; ties go to the smaller vec_id; an empty table gives no rows; with k or
fewer candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shipped

K = 20
PIVOTS = 512
NEAREST = 48
CANDIDATES = 2000
BLOCK_VECTORS = 8192


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, embedding as array<double>) of the vectors that take part."""
    e = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0))
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def permutation(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the ``nearest`` pivots of each vector, nearest (largest cosine) first."""
    near = x @ pivots.T
    nearest = min(nearest, pivots.shape[0])
    top = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int16)


class InvertedFiles:
    """Posting lists of one block: for each pivot, the vectors that rank it and the place they give it."""

    def __init__(self, perms: np.ndarray, n_pivots: int):
        n, self.length = perms.shape
        flat = perms.ravel().astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.vector = (order // self.length).astype(np.int64)
        self.place = (order % self.length).astype(np.int64)
        self.begin = np.searchsorted(flat[order], np.arange(n_pivots + 1))
        self.n = n

    def saved(self, perm: np.ndarray) -> np.ndarray:
        """What shared pivots save of the largest footrule distance to one permutation, for all vectors of the block."""
        spans = [(self.begin[p], self.begin[p + 1]) for p in perm.tolist()]
        vector = np.concatenate([self.vector[s:e] for s, e in spans])
        theirs = np.concatenate([self.place[s:e] for s, e in spans])
        ours = np.repeat(np.arange(len(spans)), [e - s for s, e in spans])
        # Missed on both sides a pivot would cost (length - ours) + (length - theirs); shared it costs |ours - theirs|:
        # it saves twice length - the larger place.
        return np.bincount(vector, self.length - np.maximum(ours, theirs), self.n)


class Searched:
    """One block of vectors that queries run against."""

    def __init__(self, rows: list[pa.RecordBatch], n_pivots: int):
        self.x = np.concatenate([_matrix(b.column("embedding")) for b in rows])
        self.ids = [i for b in rows for i in b.column("ids").to_pylist()]
        self.files = InvertedFiles(np.concatenate([_matrix(b.column("perm")) for b in rows]), n_pivots)
        self.length = np.linalg.norm(self.x, axis=1)

    def nearest(self, query_id: int, q: np.ndarray, perm: np.ndarray, k: int, candidates: int) -> list[tuple[int, int, float]]:
        worth = self.files.saved(perm) * self.length
        near = np.argpartition(-worth, candidates - 1)[:candidates] if candidates < len(worth) else np.arange(len(worth))
        score = self.x[near] @ q
        if len(score) > k + 1:  # one may be the query alone; all ties at the border stay
            border = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            near, score = near[score >= border], score[score >= border]
        found = sorted((-s, i) for s, v in zip(score.tolist(), near.tolist(), strict=True) for i in self.ids[v] if i != query_id)[:k]
        return [(query_id, i, -s) for s, i in found]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(batches: Iterator[pa.RecordBatch], n_pivots: int, k: int, candidates: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, vectors before queries: the k best of the block for each query."""
    block, rows, searched = None, [], None
    for whole in batches:
        key = whole.column("block").to_numpy() * 2 + whole.column("is_query").to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(np.diff(key, prepend=-1)).tolist(), len(key)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            b = whole.slice(start, end - start)
            if key[start] // 2 != block:
                block, rows, searched = key[start] // 2, [], None
            if key[start] % 2 == 0:
                rows.append(b)
                continue
            if not rows:
                continue  # a block without vectors
            searched = searched or Searched(rows, n_pivots)
            ids, q, perms = b.column("query_id").to_pylist(), _matrix(b.column("embedding")), _matrix(b.column("perm"))
            for at in range(0, len(ids), 1000):
                found = [x for i in range(at, min(len(ids), at + 1000)) for x in searched.nearest(ids[i], q[i], perms[i], k, candidates)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _represent(batches: Iterator[pa.RecordBatch], sent, nearest: int) -> Iterator[pa.RecordBatch]:
    pivots = sent.value[1]
    for b in batches:
        perm = permutation(_matrix(b.column("embedding")), pivots, nearest)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(perm), pa.list_(pa.int16()))], names=[*b.schema.names, "perm"])


def nearest_neighbours(vectors: DataFrame, k: int = K, query_every: int = 20, pivots: int = PIVOTS, nearest: int = NEAREST,
                       candidates: int = CANDIDATES, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    shipped(spark)
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == sizes.d)
    # Equal vectors once, with the smallest k + 1 ids.
    same = Window.partitionBy("vkey", "embedding").orderBy("vec_id")
    kept = rows.withColumn("vkey", F.xxhash64("embedding")).withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    different = kept.groupBy("vkey", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    drawn = different.orderBy(F.xxhash64("vkey"), "vkey").limit(pivots).select("embedding").collect()
    p = np.array([r.embedding for r in drawn], np.float64)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    nearest = min(nearest, len(p))
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, p))
    indexed = materialize(different.mapInArrow(lambda it: _represent(it, sent, nearest),
                                               "vkey long, embedding array<double>, ids array<long>, perm array<short>"), "permutations")
    asked = rows.where(F.col("vec_id") % query_every == 0).withColumn("vkey", F.xxhash64("embedding"))
    asked = asked.select("vec_id", "embedding", "vkey").distinct()
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), "embedding").mapInArrow(
        lambda it: _represent(it, sent, nearest), "query_id long, embedding array<double>, perm array<short>"), "queries")
    n_blocks = max(1, -(-indexed.count() // block_vectors))
    files = indexed.withColumn("block", F.pmod(F.xxhash64("vkey", F.lit(1)), F.lit(n_blocks)).cast("int")).select(
        "block", F.lit(False).alias("is_query"), F.lit(None).cast("long").alias("query_id"), "ids", "embedding", "perm")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("is_query"), "query_id",
                         F.lit(None).cast("array<long>").alias("ids"), "embedding", "perm")
    n_p = len(p)
    found = files.unionByName(every).repartitionByRange(n_blocks, "block").sortWithinPartitions("block", "is_query") \
        .mapInArrow(lambda it: _search(it, n_p, k, candidates), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
