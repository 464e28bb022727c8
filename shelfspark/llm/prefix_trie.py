"""Prefix trie of conversations from sorted LCPs: every prefix finds its members by binary search over a sparse table.

Each conversation is a row of turn digests. Rows are sorted by their digests, so
the members of a prefix are neighbours, and ``lcp[i]`` is the number of first
turns that row i shares with the row before it. A sparse table holds the least
LCP of every run of 2 ** k rows. A prefix (row i, depth d) reaches left and right as
far as no LCP falls below d; both ends are found independently by steps of
falling powers of two, for all prefixes at once, without a stack. The first row
of that interval bears the node; every number of a node is a difference of
running sums (turn bytes, new nodes, leaves) or a range minimum (conv_id) over
its interval.

Scale: rows are dealt by range of (digests, conv_id) and cut into blocks of up to
``BLOCK_TURNS`` turns; a block is handled at once, in memory that follows its
turns, not their texts. Only prefixes shared by the rows on both sides of a cut
go beyond a block: their parts are added up by the prefix's digest, and blocks get
the smallest conv_id of those that touch them, for the parents' names. One
number a cut, the LCP across it, comes from the first and last rows of the blocks,
which the driver holds. The conv_ids that end at a node are hashed in order, as a
stream over the blocks' pieces where the node spans several.

A turn's digest is half a SHA-256 (128 bits) of its role and text. A conversation's
digests are together in one row: 24 bytes a turn. Texts never leave their task.

Rebuilding: conversation c gets the first h turns of conversation c - c % 5,
h = crc32(c) % 9, then its own turns after its first h. ``%`` keeps the sign of c.

Defined cases: null role or text counts as empty; turns come by number, null
first, equal numbers by digest; rows without conv_id take no part; a conversation
without turns left is a member of the root alone; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_by_value, materialize, shipped

DIGEST = 16
BLOCK_TURNS = 1 << 18
#: conv_ids of one piece of an end list.
PIECE = 100_000


# rebuilding --------------------------------------------------------------------------------------------------------

def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): of each conversation its turns in order, as structs of digest and text bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).where(F.col("conv_id").isNotNull())
    # Structs sort by their fields in order, null first.
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(conversations: DataFrame, group: int = 5) -> DataFrame:
    """(conv_id, digests, sizes): the rebuilt conversations, digests end to end."""
    own = materialize(_turns(conversations), "turns")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 8).alias("head"))
    h = shared_turns(F.col("conv_id"))
    rows = own.withColumn("head_of", F.col("conv_id") - F.col("conv_id") % group).join(heads, F.col("head_of") == F.col("head_id"), "left")
    none = F.array().cast(own.schema["turns"].dataType)
    first = F.slice(F.coalesce("head", none), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    rows = rows.select("conv_id", F.concat(first, rest).alias("turns"))
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return rows.select("conv_id", joined.alias("digests"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


# blocks ------------------------------------------------------------------------------------------------------------

_BLOCKS = "part int, nth int, convs binary, digests binary, counts binary, sizes binary, first binary, last binary"


def _pack(batches: Iterator[pa.RecordBatch], block_turns: int) -> Iterator[pa.RecordBatch]:
    """The task's sorted rows as blocks of about ``block_turns`` turns, or as many rows, each one row of arrays."""
    from pyspark import TaskContext

    part, nth = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        digests = [x for b in rows for x in b.column("digests").to_pylist()]
        sizes = np.concatenate([b.column("sizes").flatten().to_numpy() for b in rows])
        convs = np.concatenate([b.column("conv_id").to_numpy() for b in rows])
        counts = np.array([len(x) // DIGEST for x in digests], "<i8")
        cols = (convs.astype("<i8").tobytes(), b"".join(digests), counts.tobytes(), sizes.astype("<i8").tobytes(), digests[0], digests[-1])
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)],
                                          names=[x.split()[0] for x in _BLOCKS.split(", ")])

    weight = 0
    for b in batches:
        cost = np.cumsum(1 + pc.binary_length(b.column("digests")).to_numpy().astype(np.int64) // DIGEST)
        at = 0
        while at < b.num_rows:
            base = int(cost[at - 1]) if at else 0
            to = int(np.searchsorted(cost, base + block_turns - weight, "right"))
            if to <= at and not held:
                to = at + 1  # a long conversation is a block of its own
            if to > at:
                held.append(b.slice(at, to - at))
                weight += int(cost[to - 1]) - base
                at = to
            if at < b.num_rows:
                yield block(held)
                held, weight, nth = [], 0, nth + 1
    if held:
        yield block(held)


def _shared(a: bytes, b: bytes) -> int:
    """Number of first turns that two rows have in common."""
    n = min(len(a), len(b)) // DIGEST * DIGEST
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) // DIGEST if len(differ) else n // DIGEST


class Block:
    """Sorted rows with their LCPs, the sparse table over them and running sums.

    ``before`` and ``after`` are the LCPs with the neighbouring rows outside, -1 where there is none.
    """

    def __init__(self, row: dict, before: int, after: int):
        self.convs = np.frombuffer(row["convs"], "<i8")
        self.length = np.frombuffer(row["counts"], "<i8")
        size = np.frombuffer(row["sizes"], "<i8")
        self.digests, self.n = row["digests"], len(self.convs)
        self.before, self.after = before, after
        self.start = np.cumsum(self.length) - self.length
        self.bytes_to = np.concatenate(([0], np.cumsum(size)))
        self.lcp = self._lcp()
        self.low = self._table(self.lcp)
        self.least_conv = self._table(self.convs)
        n, follow = self.n, np.append(self.lcp[1:], after)
        total = self.bytes_to[self.start + self.length] - self.bytes_to[self.start]
        fresh = total - self.first_bytes(np.arange(n), np.maximum(self.lcp, 0))
        run = lambda x: np.concatenate(([0], np.cumsum(x)))
        self.total_to, self.fresh_to = run(total), run(fresh)  # bytes of all turns; of nodes first met in a row
        self.leaves_to = run(follow < self.length)  # last rows of equal ones that no next row goes on from
        self.total = total
        # rows that have a turn more than they share with the row before, by (shared turns, row): a child begins there
        more = np.flatnonzero(self.length > self.lcp)
        self.child = np.sort(self.lcp[more] * (n + 1) + more)
        same = (self.lcp == self.length) & (np.concatenate(([-1], self.length[:-1])) == self.length)
        same[0] = False
        ends = np.append(np.flatnonzero(~same)[1:], n)
        self.equal_to = np.repeat(ends, np.diff(np.append(np.flatnonzero(~same), n)))  # behind the rows equal to this one

    def _lcp(self) -> np.ndarray:
        turns = np.frombuffer(self.digests, "<u8").reshape(-1, 2)
        out = np.zeros(self.n, np.int64)
        out[0] = self.before
        both = np.minimum(self.length[:-1], self.length[1:])
        pair = np.repeat(np.arange(len(both)), both)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(both) - both, both)
        differ = (turns[self.start[pair] + k] != turns[self.start[pair + 1] + k]).any(axis=1)
        out[1:] = both
        where = np.flatnonzero(differ)
        first = group_by_value(pair[where])
        out[1 + pair[where[first]]] = k[where[first]]
        return out

    def _table(self, values: np.ndarray) -> list[np.ndarray]:
        """Level k holds the least of each 2 ** k values from a place on."""
        out = [values]
        while 2 << len(out) - 1 <= self.n:
            half = 1 << len(out) - 1
            out.append(np.minimum(out[-1][:-half], out[-1][half:]))
        return out

    def first_bytes(self, row: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Text bytes of the first ``turns`` turns of rows."""
        return self.bytes_to[self.start[row] + turns] - self.bytes_to[self.start[row]]

    def extents(self, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row that share their first ``depth`` turns with ``row``; both sides by their own binary search."""
        left, right = row.copy(), row.copy()
        for k in range(len(self.low) - 1, -1, -1):
            step, level = 1 << k, self.low[k]
            can = right + step < self.n
            at = np.minimum(right + 1, len(level) - 1)
            right = np.where(can & (level[at] >= depth), right + step, right)  # lcps of right + 1 to right + step
            can = left - step >= 0
            at = np.clip(left - step + 1, 0, len(level) - 1)
            left = np.where(can & (level[at] >= depth), left - step, left)  # lcps of left - step + 1 to left
        return left, right

    def smallest_conv(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = np.frexp((right - left + 1).astype(float))[1] - 1
        out = np.empty(len(left), np.int64)
        for level in np.unique(k):
            own = k == level
            t = self.least_conv[level]
            out[own] = np.minimum(t[left[own]], t[right[own] + 1 - (1 << int(level))])
        return out

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, depth) of every prefix at the first row of the block that has it, those of earlier blocks included."""
        since = self.lcp.copy()
        since[0] = -1
        n = self.length - since
        row = np.repeat(np.arange(self.n), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + since[row] + 1

    def beyond(self, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Which prefixes have members outside the block."""
        return (left == 0) & (depth <= self.before) | (right == self.n - 1) & (depth <= self.after)

    def measures(self, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> dict[str, np.ndarray]:
        """Of each prefix what adds up over blocks, and the smallest conv_id."""
        above = np.maximum(depth - 1, 0)
        new = self.total[left] - self.first_bytes(left, np.maximum(np.maximum(self.lcp[left], 0), above))
        child = np.searchsorted(self.child, depth * (self.n + 1) + right, "right") - np.searchsorted(self.child, depth * (self.n + 1) + left, "right")
        return {"conv_id": self.smallest_conv(left, right), "n_convs": right - left + 1,
                "n_children": child + ((self.lcp[left] <= depth) & (self.length[left] > depth)),
                "n_leaves": self.leaves_to[right + 1] - self.leaves_to[left],
                "bytes": self.total_to[right + 1] - self.total_to[left],
                "new_bytes": self.fresh_to[right + 1] - self.fresh_to[left + 1] + new, "above": self.first_bytes(left, above)}

    def ends(self, left: int, depth: int) -> np.ndarray:
        """conv_ids of the rows that end with this prefix, ascending."""
        return self.convs[left:self.equal_to[left]] if self.length[left] == depth else self.convs[:0]

    def names(self, row: int, depths: range) -> list[bytes]:
        """Digests of the first turns of a row, for each depth."""
        h, out, at = hashlib.sha256(), [], int(self.start[row]) * DIGEST
        for d in range(depths.stop):
            if d:
                h.update(self.digests[at + (d - 1) * DIGEST:at + d * DIGEST])
            if d >= depths.start:
                out.append(h.copy().digest())
        return out


def saved(n_convs, all_bytes, new_bytes, above):
    """Bytes of a subtree that are shared: those of all members below the top's parent, less each node's once."""
    return all_bytes - n_convs * above - new_bytes


# jobs --------------------------------------------------------------------------------------------------------------

_PARTS = ("part int, nth int, side int, name binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, bytes long, "
          "new_bytes long, above long")
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PIECES = "name binary, part int, nth int, piece int, ids string"


def _blocks(batches: Iterator[pa.RecordBatch], sent) -> Iterator[tuple[dict, Block]]:
    shared = sent.value[1]
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            yield row, Block(row, *shared[row["part"], row["nth"]])  # one at a time


def _crossing(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(side, left, right, depth) of the prefixes with members outside: those of the first row (side 0), and further ones of the last (1)."""
    side = np.repeat([0, 1], [block.before + 1, block.after + 1])
    depth = np.concatenate([np.arange(block.before + 1), np.arange(block.after + 1)])
    left, right = block.extents(side * (block.n - 1), depth)
    kept = (side == 0) | (left > 0) | (depth > block.before)
    return side[kept], left[kept], right[kept], depth[kept]


def _crossing_parts(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """The blocks' parts of prefixes with members in several."""
    for row, block in _blocks(batches, sent):
        side, left, right, depth = _crossing(block)
        k = len(left)
        if not k:
            continue
        name = {(at, d): x for at in np.unique(left).tolist() for d, x in enumerate(block.names(at, range(int(depth[left == at].max()) + 1)))}
        places = list(zip(left.tolist(), depth.tolist(), strict=True))
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([row["part"]] * k, pa.int32()), "nth": pa.array([row["nth"]] * k, pa.int32()), "side": pa.array(side, pa.int32()),
            "name": pa.array([name[x] for x in places], pa.binary()), "parent": pa.array([name[x, d - 1] if d else None for x, d in places], pa.binary()),
            "depth": pa.array(depth), **{c: pa.array(v.astype(np.int64)) for c, v in block.measures(left, right, depth).items()}})


def _end_pieces(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """The conv_ids that end at prefixes of several blocks, in pieces."""
    for row, block in _blocks(batches, sent):
        for left, depth in zip(*(x.tolist() for x in _crossing(block)[1::2]), strict=True):
            convs = block.ends(left, depth)
            if len(convs):
                name = block.names(left, range(depth, depth + 1))[0]
                for k, at in enumerate(range(0, len(convs), PIECE)):
                    yield pa.RecordBatch.from_pydict({"name": pa.array([name], pa.binary()), "part": pa.array([row["part"]], pa.int32()),
                                                      "nth": pa.array([row["nth"]], pa.int32()), "piece": pa.array([k], pa.int32()),
                                                      "ids": [",".join(map(str, convs[at:at + PIECE].tolist()))]})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to the hash of each name's whole list; only the hash under way is carried."""
    name = h = None
    for b in batches:
        out: list[tuple[bytes, str]] = []
        for x, ids in zip(b.column("name").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if x != name:
                if h is not None:
                    out.append((name, h.hexdigest()))
                name, h = x, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"end_name": pa.array([x for x, _ in out], pa.binary()), "ends_sha256": pa.array([y for _, y in out], pa.string())})
    if h is not None:
        yield pa.RecordBatch.from_pydict({"end_name": pa.array([name], pa.binary()), "ends_sha256": [h.hexdigest()]})


def _inner_nodes(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """The nodes whose members all lie in one block."""
    for row, block in _blocks(batches, sent):
        i, depth = block.prefixes()
        left, right = block.extents(i, depth)
        own = (left == i) & ~block.beyond(left, right, depth)
        left, right, depth = left[own], right[own], depth[own]
        m = block.measures(left, right, depth)
        up_left, up_right = block.extents(left, depth - 1)
        up = np.where(depth > 0, block.smallest_conv(up_left, up_right), 0)
        # a parent that goes beyond the block has its smallest conv_id from all of its blocks
        outside = np.flatnonzero((depth > 0) & block.beyond(up_left, up_right, depth - 1))
        known = {(s, d): c for s, d, c in ((x["side"], x["depth"], x["conv_id"]) for x in row["least"] or ())}
        for k in outside.tolist():
            d = int(depth[k]) - 1
            up[k] = known[0, d] if d <= block.before and up_left[k] == 0 else known[1, d]
        nothing = hashlib.sha256(b"").hexdigest()
        ends = [nothing] * len(left)
        for k in np.flatnonzero(block.length[left] == depth).tolist():
            ends[k] = hashlib.sha256(",".join(map(str, block.ends(int(left[k]), int(depth[k])).tolist())).encode()).hexdigest()
        yield pa.RecordBatch.from_pydict({
            "conv_id": pa.array(m["conv_id"]), "depth": pa.array(depth), "parent_conv_id": pa.array(up, pa.int64(), mask=depth == 0),
            "n_convs": pa.array(m["n_convs"]), "n_children": pa.array(m["n_children"].astype(np.int64)), "n_leaves": pa.array(m["n_leaves"].astype(np.int64)),
            "saved_tokens": pa.array(saved(m["n_convs"], m["bytes"], m["new_bytes"], m["above"])), "ends_sha256": pa.array(ends, pa.string())})


def trie(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the prefix trie of rows (conv_id, digests, sizes), each conv_id once."""
    spark = rows.sparkSession
    shipped(spark)
    ordered = rows.repartitionByRange("digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    blocks = materialize(ordered.mapInArrow(lambda it: _pack(it, block_turns), _BLOCKS), "trie-blocks")
    edges = sorted(blocks.select("part", "nth", "first", "last").collect(), key=lambda r: (r.part, r.nth))  # two rows a block
    across = [-1, *(_shared(bytes(a["last"]), bytes(b["first"])) for a, b in zip(edges[:-1], edges[1:], strict=True)), -1]
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, {(r.part, r.nth): (across[k], across[k + 1]) for k, r in enumerate(edges)}))
    data = blocks.drop("first", "last")
    parts = materialize(data.mapInArrow(lambda it: _crossing_parts(it, sent), _PARTS), "trie-crossing")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "bytes", "new_bytes")]
    whole = materialize(parts.groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                                  *sums, F.max("above").alias("above")), "trie-crossing-nodes")
    pieces = data.mapInArrow(lambda it: _end_pieces(it, sent), _PIECES)
    ends = pieces.repartition("name").sortWithinPartitions("name", "part", "nth", "piece").mapInArrow(_hashed, "end_name binary, ends_sha256 string")
    up = whole.select(F.col("name").alias("up_name"), F.col("conv_id").alias("parent_conv_id"))
    crossing = whole.join(up, F.col("parent") == F.col("up_name"), "left").join(ends, F.col("name") == F.col("end_name"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        saved(F.col("n_convs"), F.col("bytes"), F.col("new_bytes"), F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    # What a block needs to name parents outside: the depths up to its two LCPs.
    least = parts.select("part", "nth", "name", "side").join(whole.select("name", "depth", "conv_id"), "name") \
        .groupBy("part", "nth").agg(F.collect_list(F.struct("side", "depth", "conv_id")).alias("least"))
    inner = data.join(least, ["part", "nth"], "left").mapInArrow(lambda it: _inner_nodes(it, sent), _NODES)
    return inner.unionByName(crossing)


def prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(rebuilt(conversations), block_turns)
