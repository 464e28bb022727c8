"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens, served in slots of 64 tokens. A
queue's credit grows in proportion to its target share; the queue that is owed
most gets the next slot, and what it is still owed is carried on, across slots,
windows (32 slots, 2,048 tokens) and partitions. Slot j of a queue with weight q
falls due at (2j + 1) / (2q), so its place in the common order is a count of the
earlier due dates of the other queues: integer arithmetic on the queues' totals,
without a pass over the data. A queue that runs out leaves its share to the rest.

The target is given by weights (any positive numbers, one for each source), else by
``power``: shares in proportion to a queue's slots to that power. 1 is the corpus
mixture, in which all queues last to the end; the default of 0.7 gives small
sources more than their share for as long as they last.

Tokens are made once and written; a row keeps its place within its (task, queue),
and the tasks' sums, a small table, give its place in the queue. Nothing else is
shuffled. Only the last slot of a queue can be short, so the padding of all
sequences together is under 64 tokens a queue and one window at the end.

Without weights the ``max_queues`` - 1 largest sources (bytes of text, equal ones by
name) are queues and all further ones together the queue "rest"; the column
``source`` is the true one, ``queue`` the name of its queue ("=" and the source).

Defined cases: null and empty texts give the end id alone; a null source is a
source of its own (queue "null"); a weight that is not a positive finite number, or
a source without a weight, is an error; rows that repeat a doc_id or have none are packed each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, shipped, slices

WINDOW_TOKENS = 2048
SLOT_TOKENS = 64
END_ID = 1
MAX_QUEUES = 1000
MIXTURE_POWER = 0.7
#: Largest of the integers that stand for fractional weights.
_WEIGHT_STEPS = 1 << 24
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


_ENCODERS: dict = {}


def encoder(path: str):
    """text -> numpy ids of the tokenizer file, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A plain byte-level BPE whose ids follow its merges is run by tiktoken on the same vocabulary, which is
    about four times as fast; any other file by tokenizers itself.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = _ranked(path) or _plain(path)
    return _ENCODERS[path]


def _plain(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)


def _ranked(path: str):
    import tiktoken

    spec = json.loads(Path(path).read_text())
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    plain = (model.get("type") == "BPE" and not any(model.get(k) for k in options) and spec.get("normalizer") is None
             and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
             and all(not (a["single_word"] or a["lstrip"] or a["rstrip"]) for a in added))
    if not plain:
        return None
    to_byte = _byte_characters()
    special = {a["content"]: a["id"] for a in added}
    ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # Fixed value: the word pattern of byte-level pre-tokenizers.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    e = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: np.array(e.encode(text, allowed_special="all") if any(s in text for s in special) else e.encode_ordinary(text), np.uint32)


def _byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_TOKENS = "doc_id long, source string, queue string, part long, begin long, doc_tokens long, ids binary"


def _tokenize(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of each row, with the tokens of its queue before it in this task."""
    from pyspark import TaskContext

    part, encode, before = TaskContext.get().partitionId(), encoder(path), {}
    for b in slices(batches, limit=1 << 20):
        queues, begin, n, ids = b.column("queue").to_pylist(), [], [], []
        for text, q in zip(b.column("text").to_pylist(), queues, strict=True):
            found = np.append(encode(text), np.uint32(END_ID))
            begin.append(before.get(q, 0))
            before[q] = begin[-1] + len(found)
            n.append(len(found))
            ids.append((found.astype(np.uint16) if found.max() < 1 << 16 else found).tobytes())
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "source": b.column("source"), "queue": b.column("queue"), "part": pa.array([part] * len(n), pa.int64()),
                                          "begin": pa.array(begin, pa.int64()), "doc_tokens": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())})


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Positive integers in the proportions of ``weights``: the weights themselves if they are whole, else fractions of the largest."""
    for q, w in weights.items():
        if not (isinstance(w, int | float) and math.isfinite(w) and w > 0):
            raise ValueError(f"the weight of {q!r} is {w!r}, not a positive number")
    if all(w == int(w) for w in weights.values()):
        return {q: int(w) for q, w in weights.items()}
    largest = max(weights.values())
    return {q: max(1, round(w / largest * _WEIGHT_STEPS)) for q, w in weights.items()}


class Schedule:
    """Places of all queues' slots in the common order."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None = None, power: float = 1.0,
                 slot: int = SLOT_TOKENS, per_window: int = WINDOW_TOKENS // SLOT_TOKENS):
        self.slot, self.per_window = slot, per_window
        self.queues = sorted(totals)
        self.number = {q: i for i, q in enumerate(self.queues)}
        tokens = [totals[q] for q in self.queues]
        slots = [-(-n // slot) for n in tokens]
        given = {q: weights[q] for q in self.queues} if weights else {q: max(1, n) if power == 1 else max(1, n) ** power
                                                                      for q, n in zip(self.queues, slots, strict=True)}
        weight = list(whole_weights(given).values())
        # int64 where the products fit, else Python's own integers
        kind = np.int64 if 2 * (max(slots, default=0) + 1) * (max(weight, default=0) + 1) < 2**62 else object
        self.slots, self.weight = np.array(slots, kind), np.array(weight, kind)
        short = [(n - 1, i, n * slot - t) for i, (n, t) in enumerate(zip(slots, tokens, strict=True)) if n * slot > t]
        places = self.rank(np.array([i for _, i, _ in short], np.int64), np.array([j for j, _, _ in short], np.int64))
        short = sorted(zip(places.tolist(), (m for _, _, m in short), strict=True))
        self.short_rank = np.array([r for r, _ in short], np.int64)
        self.short_sum = np.concatenate(([0], np.cumsum([m for _, m in short]))).astype(np.int64)

    def rank(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of slots (queue, j): the numbers of slots of all queues that fall due before, of equal dates those of earlier queues."""
        out = np.empty(len(j), np.int64)
        every, step = np.arange(len(self.queues)), max(1, 1_000_000 // max(1, len(self.queues)))
        for at in range(0, len(j), step):
            q = queue[at:at + step, None]
            due = 2 * j[at:at + step, None].astype(self.weight.dtype) + 1
            before = (due * self.weight - (every >= q)) // self.weight[q]
            out[at:at + step] = np.minimum((before + 1) // 2, self.slots).sum(axis=1)
        return out

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Where a slot starts in its window: short slots before it leave no gap."""
        first = rank - rank % self.per_window
        return (rank - first) * self.slot - (self.short_sum[np.searchsorted(self.short_rank, rank)]
                                             - self.short_sum[np.searchsorted(self.short_rank, first)])


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, queue string"


def _pieces(batches: Iterator[pa.RecordBatch], sent, with_ids: bool) -> Iterator[pa.RecordBatch]:
    plan: Schedule = sent.value[1]
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            begin, n = b.column("at").to_numpy(), b.column("doc_tokens").to_numpy()
            number = np.array([plan.number[q] for q in b.column("queue").to_pylist()])
            first, last = begin // plan.slot, (begin + n - 1) // plan.slot
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            rank = plan.rank(number[row], j)
            lo = np.maximum(j * plan.slot, begin[row])
            hi = np.minimum((j + 1) * plan.slot, (begin + n)[row])
            offset = plan.offset(rank) + lo - j * plan.slot
            new = np.ones(len(row), bool)  # neighbours in the same window are one piece
            new[1:] = (row[1:] != row[:-1]) | (rank[1:] != rank[:-1] + 1) | (rank[1:] % plan.per_window == 0)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(row)) - 1
            row, start, end = row[head], (lo - begin[row])[head], (hi - begin[row])[tail]
            ids = [np.frombuffer(x, np.uint16 if len(x) == 2 * k else np.uint32).astype("<u4").tobytes()
                   for x, k in zip(b.column("ids").to_pylist(), n.tolist(), strict=True)]
            cut = [ids[r][4 * s:4 * e] for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
            cols = {"doc_id": b.column("doc_id").take(pa.array(row)), "start": pa.array(start), "length": pa.array(end - start),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()), "doc_tokens": pa.array(n[row]),
                    "sequence_id": pa.array(rank[head] // plan.per_window), "offset": pa.array(offset[head]),
                    "source": b.column("source").take(pa.array(row)), "queue": b.column("queue").take(pa.array(row))}
            if with_ids:
                cols["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)


def _queues(docs: DataFrame, weights: dict | None, max_queues: int):
    """The column that names the queue of a row's source."""
    source = F.col("source").cast("string")
    named = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    if weights is not None:
        own = docs.sparkSession.createDataFrame([(s,) for s in weights], "known string")
        absent = docs.select(source.alias("source")).distinct().join(own, F.col("source").eqNullSafe(F.col("known")), "left_anti").limit(10).collect()
        if absent:
            raise ValueError(f"no weight for the sources {[r.source for r in absent]}")
        return named
    size = F.sum(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("size")
    largest = docs.groupBy(source.alias("source")).agg(size).orderBy(F.desc("size"), F.asc_nulls_first("source")).limit(max_queues + 1).collect()
    if len(largest) <= max_queues:
        return named
    own = ["null" if r.source is None else f"={r.source}" for r in largest[:max_queues - 1]]
    return F.when(F.array_contains(F.array(*(F.lit(q) for q in own)) if own else F.array().cast("array<string>"), named), named).otherwise("rest")


def pack(docs: DataFrame, path: str | None = None, weights: dict | None = None, power: float = MIXTURE_POWER, window: int = WINDOW_TOKENS,
         slot: int = SLOT_TOKENS, max_queues: int = MAX_QUEUES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, queue; the ids if asked for."""
    spark = docs.sparkSession
    shipped(spark)
    path = path or tokenizer_path()
    if weights is not None:
        whole_weights(weights)  # an error before any work
    rows = documents(docs, F.col("source").cast("string").alias("source"), _queues(docs, weights, max_queues).alias("queue"))
    tokens = materialize(rows.mapInArrow(lambda it: _tokenize(it, path), _TOKENS), "tokens")
    sums = materialize(tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n")), "token-sums")
    totals = {r.queue: r.n for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # one row a queue: max_queues or the given weights at most
    if not totals:
        return spark.createDataFrame([], _PIECES + (", ids array<int>" if with_ids else ""))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("queue").alias("base_queue"), F.col("part").alias("base_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(base, (F.col("queue") == F.col("base_queue")) & (F.col("part") == F.col("base_part"))) \
        .select("doc_id", "source", "queue", "doc_tokens", "ids", (F.col("base") + F.col("begin")).alias("at"))
    owed = {"null" if s is None else f"={s}": w for s, w in weights.items()} if weights is not None else None
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, Schedule(totals, owed, power, slot, window // slot)))
    return placed.mapInArrow(lambda it: _pieces(it, sent, with_ids), _PIECES + (", ids array<int>" if with_ids else ""))
