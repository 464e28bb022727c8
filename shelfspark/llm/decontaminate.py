"""Benchmark decontamination with a generalised suffix automaton.

The items' words, normalised, go into one suffix automaton over all items (a
block of items of bounded size). Training
words are streamed through it with the longest matching length at each word:
where it reaches the window length, the last words are a window of an item;
items shorter than a window are final states of their own length. Words that
no item holds end every match, so only runs of item words long enough to hold a
window are streamed at all; that skips no match.

Items of several blocks have one automaton a block. One scan of the documents for
many blocks looks up hashes of all their windows among those of the items, and an
automaton gets the texts that may hold a window of its block: all that do, and few others.

``clean`` removes the hit spans and drops documents of which too much is hit.

Defined cases: null and empty texts have no words; items without words are no
items, and null item ids still mark words but are not counted; items that repeat
an id count once; an empty benchmark hits nothing; an empty documents table gives
no rows; each row of a repeated doc_id is returned; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ONLY_SPACE, Words, documents, free_names, materialize, shipped, slices, text_bytes

WINDOW = 10
#: Words of items in one automaton; more items are matched block by block.
BLOCK_WORDS = 500_000
#: Blocks looked up in one scan of the documents (12 bytes a window in each Python worker).
SCAN_BLOCKS = 8
#: ``clean`` removes hit spans, each at least a window of an item long, and drops documents with more than this share of hit words.
MAX_COVERAGE = 0.5

#: a-z, 0-9 and all bytes of non-ASCII characters are word bytes; A-Z become a-z; the rest separates.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; states know the items that hold their window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        rows = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, words in rows:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.lengths = sorted({len(w) for _, w in rows if len(w) < window}, reverse=True)
        self.shortest = min([window, *(len(w) for _, w in rows)])
        # A window's state: the one reached by its words, cut back to the window's length by suffix links.
        # Windows of one item only, as most are, share its set.
        self.items: dict[tuple[int, int], frozenset | set] = {}
        for item, words in rows:
            need, only = min(window, len(words)), frozenset((item,))
            for i, state, length in self.stream(words):
                if length >= need:
                    held = self.items.setdefault((self.cut(state, need), need), only)
                    if item not in held:
                        if isinstance(held, frozenset):
                            held = self.items[self.cut(state, need), need] = set(held)
                        held.add(item)

    def _extend(self, last: int, w: int) -> int:
        """Append a word after state ``last``; the state of the longer prefix."""
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the shorter words of q, those that continue p by w."""
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest matching length) after each word."""
        state, matched = 0, 0
        follow, link, length = self.next, self.link, self.length
        for i, w in enumerate(words):
            to = follow[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = follow[state].get(w)
            if to is None:
                state, matched = 0, 0
            else:
                state, matched = to, matched + 1
            yield i, state, matched

    def cut(self, state: int, length: int) -> int:
        """The state that holds the suffix of ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set]]:
        """(first word, number of words, items) of every window in ``words``."""
        for i, state, matched in self.stream(words):
            if matched >= self.window:
                found = self.items.get((self.cut(state, self.window), self.window))
                if found is not None:
                    yield i - self.window + 1, self.window, found
            for n in self.lengths:
                if matched >= n:
                    found = self.items.get((self.cut(state, n), n))
                    if found is not None:
                        yield i - n + 1, n, found


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # A-Z are words' letters as a-z are
_BUILT: dict = {}


def _automaton(sent, window: int) -> SuffixAutomaton:
    """Built once per Python worker from the block of items that was sent."""
    key, items = sent.value
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton([(i, item_words(t)) for i, t in items], window)
    return _BUILT[key]


def document_hits(automaton: SuffixAutomaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """(hit spans (first, end) in order and apart, items)."""
    ids = list(map(automaton.vocabulary.get, words))
    known = np.array([x is not None for x in ids], bool)
    step = np.diff(np.concatenate(([0], known.astype(np.int8), [0])))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long_enough = end - begin >= automaton.shortest
    spans: list[list[int]] = []
    items: set = set()
    for s, e in zip(begin[long_enough].tolist(), end[long_enough].tolist(), strict=True):
        found = sorted((s + at, s + at + n) for at, n, of in automaton.matches(ids[s:e]) if not items.update(of))
        for a, b in found:
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
    return [(a, b) for a, b in spans], items


_HITS = "doc_id long, n_words long, spans array<struct<a: int, b: int>>, items array<string>"


def _hits(batches: Iterator[pa.RecordBatch], sent, window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for b in slices(batches):
        automaton = _automaton(sent, window)
        data, offsets = text_bytes(b.column("text"))
        raw = data.tobytes().translate(_WORD_BYTES)
        n_words, spans, items = [], [], []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = raw[s:e].split()
            found, of = document_hits(automaton, words)
            n_words.append(len(words))
            spans.append([{"a": x, "b": y} for x, y in found])
            items.append(sorted(str(x) for x in of if x is not None))
        cols = {"doc_id": b.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, spans_type),
                "items": pa.array(items, pa.list_(pa.string()))}
        if with_text:
            cols["text"] = b.column("text")
        yield pa.RecordBatch.from_pydict(cols)


def _blocks(benchmark: DataFrame, block_words: int, window: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items (ids and words) in blocks of about ``block_words`` words; an iterator, so the driver holds few blocks.

    A longer item comes in pieces that overlap by a word less than a window, so each of its windows is in one.
    """
    piece = max(block_words, 2 * window)
    block, size = [], 0
    for r in benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct().toLocalIterator():
        words = item_words(r.text)
        for at in range(0, max(len(words) - window + 1, 1), piece - window + 1) if words else ():
            part = words[at:at + piece]
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            block.append((r.item_id, b" ".join(part)))
            size += len(part)
    yield block


_STEP, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _window_hashes(words: Words, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the lengths: (length, first words of all runs of so many words within a text, hashes of the runs)."""
    left = np.repeat(words.first[1:], words.count) - np.arange(len(words))
    one = words.hashes()
    run = one
    for n in range(1, lengths[-1] + 1):
        if n > len(words):
            return
        if n > 1:
            run = run[:-1] * _STEP + one[n - 1:]
        if n in lengths:
            at = np.flatnonzero(left[:len(run)] >= n)
            x = (run[at] ^ np.uint64(n)) * _END
            yield n, at, x ^ x >> np.uint64(32)


class WindowFilter:
    """The blocks of items of which a text may hold a window, by hashes of the windows: all such blocks, seldom others."""

    def __init__(self, blocks: list[list[tuple[object, bytes]]], window: int):
        keys, of, self.lengths = [], [], set()
        for k, block in enumerate(blocks):
            words = Words(pa.array([x for _, x in block], pa.binary()), ONLY_SPACE)
            need = np.minimum(words.count, window)
            lengths = np.unique(need[need > 0]).tolist()
            self.lengths.update(lengths)
            text = words.text_of()
            mine = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[need[text[at]] == n] for n, at, x in _window_hashes(words, lengths))]))
            keys.append(mine)
            of.append(np.full(len(mine), k, np.int32))
        self.lengths = sorted(self.lengths)
        keys, of = np.concatenate(keys), np.concatenate(of)
        order = np.argsort(keys, kind="stable")
        self.keys, self.of = keys[order], of[order]
        # A bit for the first bits of each hash rules most other runs out.
        n_bits = max(16, (16 * len(keys)).bit_length())
        self.shift = np.uint64(64 - n_bits)
        seen = np.zeros(1 << n_bits, bool)
        seen[self.keys >> self.shift] = True
        self.seen = np.packbits(seen, bitorder="little")

    def blocks(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a text and a block, by text and block, each once."""
        pairs = [np.zeros((0, 2), np.int64)]
        for _, at, x in _window_hashes(words, self.lengths):
            place = x >> self.shift
            bit = self.seen[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
            may = np.flatnonzero(bit)
            at, x = at[may], x[may]
            begin = np.searchsorted(self.keys, x, "left")
            held = np.flatnonzero(self.keys.take(begin, mode="clip") == x)
            at, x, begin = at[held], x[held], begin[held]
            n = np.searchsorted(self.keys, x, "right") - begin
            every = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            text = np.searchsorted(words.first, np.repeat(at, n), "right") - 1
            pairs.append(np.unique(np.column_stack((text, self.of[every])), axis=0))
        return tuple(np.unique(np.concatenate(pairs), axis=0).T)


_NORMAL = np.frombuffer(_WORD_BYTES, np.uint8)


def _candidates(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """The rows whose texts may hold a window of an item, with the blocks of those items."""
    for b in slices(batches):
        text, block = sent.value.blocks(Words(b.column("text"), ONLY_SPACE, _NORMAL))
        rows, n = np.unique(text, return_counts=True)
        offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        of = pa.ListArray.from_arrays(offsets, pa.array(block, pa.int32()))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(at), "text": b.column("text").take(at), "blocks": of})


def _counts(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        data, offsets = text_bytes(b.column("text"))
        raw = data.tobytes().translate(_WORD_BYTES)
        n_words = [len(raw[s:e].split()) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        cols = {"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "n_words": pa.array(n_words, pa.int64())}
        if with_text:
            cols["text"] = b.column("text")
        yield pa.RecordBatch.from_pydict(cols)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks put in order and joined."""
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for b in batches:
        out = []
        for row in b.column("spans").to_pylist():
            merged: list[dict] = []
            for x in sorted(row, key=lambda x: (x["a"], x["b"])):
                if merged and x["a"] <= merged[-1]["b"]:
                    merged[-1]["b"] = max(merged[-1]["b"], x["b"])
                else:
                    merged.append(dict(x))
            out.append(merged)
        yield pa.RecordBatch.from_arrays([b.column(n) if n != "spans" else pa.array(out, spans_type) for n in b.schema.names], names=b.schema.names)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (hit words, end exclusive), items (ids as text, sorted); the text if asked for."""
    spark = docs.sparkSession
    shipped(spark)
    schema = _HITS + (", text string" if with_text else "")
    keys = documents(docs)
    blocks = _blocks(benchmark, block_words, window)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        return keys.mapInArrow(lambda it: _hits(it, sent, window, with_text), schema)
    blocks = chain([block, after], blocks)
    parts = [spark.createDataFrame([], _HITS + ", text_key long")]
    while group := list(islice(blocks, SCAN_BLOCKS)):
        sent = spark.sparkContext.broadcast(WindowFilter(group, window))
        found = materialize(keys.mapInArrow(lambda it, sent=sent: _candidates(it, sent), "doc_id long, text string, blocks array<int>"),
                            "decontaminate-texts")
        sent.destroy()
        for k in sorted(r.k for r in found.select(F.explode("blocks").alias("k")).distinct().collect()):
            sent = spark.sparkContext.broadcast((uuid.uuid4().hex, group[k]))
            part = found.where(F.array_contains("blocks", k)) \
                .mapInArrow(lambda it, sent=sent: _hits(it, sent, window, True), _HITS + ", text string")
            parts.append(materialize(part.withColumn("text_key", F.xxhash64("text")).drop("text").distinct(), "decontaminate"))
            sent.destroy()
    several = parts[0]
    for p in parts[1:]:
        several = several.unionByName(p)
    joined = several.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = joined.mapInArrow(_merged, _HITS.replace("n_words", "text_key long, n_words"))
    row = keys.withColumn("text_key", F.xxhash64("text"))
    row = row.mapInArrow(lambda it: _counts(it, with_text), "doc_id long, text_key long, n_words long" + (", text string" if with_text else ""))
    none = {c: F.coalesce(joined[c], F.array().cast(joined.schema[c].dataType)).alias(c) for c in ("spans", "items")}
    return row.join(joined, (row.doc_id.eqNullSafe(joined.doc_id)) & (row.text_key == joined.text_key), "left") \
        .select(row.doc_id, row.n_words, none["spans"], none["items"], *([row.text] if with_text else []))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, coverage."""
    h = hits(docs, benchmark, window, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return h.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
                    F.coalesce(F.try_divide(n_hit, "n_words"), F.lit(0.0)).alias("coverage"))


def _without(text: str, n: int, spans: list, max_coverage: float) -> str | None:
    """The text without its hit spans; null where too much is hit."""
    hit = sum(b - a for a, b in spans)
    if n and hit > max_coverage * n:
        return None
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join([*kept, text[at:]])


def _rewrite(batches: Iterator[pa.RecordBatch], sent, window: int, max_coverage: float) -> Iterator[pa.RecordBatch]:
    """The rows that stay, with all their columns, and what is left of their texts."""
    for whole in batches:
        automaton = _automaton(sent, window)
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            old = b.column("text").to_pylist()
            new = []
            for text in old:
                words = item_words(text)
                left = _without(text, len(words), document_hits(automaton, words)[0], max_coverage) if words else text
                while left and left != text:  # what a cut brings together may be an item again
                    text, words = left, item_words(left)
                    left = _without(text, len(words), document_hits(automaton, words)[0], 1.0)
                new.append(left)
            stay = pa.array([x is not None or y is None for x, y in zip(new, old, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else b.column(c) for c in b.schema.names],
                                             names=b.schema.names).filter(stay)


def _apply_spans(batches: Iterator[pa.RecordBatch], n_words: str, spans_of: str, max_coverage: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        old = b.column("text").to_pylist()
        new = [_without(t, n, [(s["a"], s["b"]) for s in spans], max_coverage) if spans else t
               for t, n, spans in zip(old, b.column(n_words).to_pylist(), b.column(spans_of).to_pylist(), strict=True)]
        stay = pa.array([x is not None or y is None for x, y in zip(new, old, strict=True)], pa.bool_())
        keep = [c for c in b.schema.names if c not in (n_words, spans_of)]
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else b.column(c) for c in keep], names=keep).filter(stay)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay; the hit spans are cut out of their texts."""
    spark = docs.sparkSession
    shipped(spark)
    blocks = _blocks(benchmark, block_words, window)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        return docs.mapInArrow(lambda it: _rewrite(it, sent, window, max_coverage), docs.schema)
    found = hits(docs, benchmark, window, block_words, with_text=True).where(F.size("spans") > 0)
    i, k, n, s = free_names(docs, "of_id", "of_text", "n_words", "spans")
    found = found.select(F.col("doc_id").alias(i), F.xxhash64("text").alias(k), F.col("n_words").alias(n), F.col("spans").alias(s)).distinct()
    found = materialize(found, "decontaminate-spans")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(k))
    rows = docs.join(found, same).drop(i, k)
    cut = materialize(rows.mapInArrow(lambda it: _apply_spans(it, n, s, max_coverage), docs.schema), "decontaminate-cut")
    rest = docs.join(found, same, "left_anti")
    # What a cut brings together may be an item again: the rows that were cut, fewer each time, go through once more.
    return rest.unionByName(clean(cut, benchmark, window, 1.0, block_words)) if cut.take(1) else rest
