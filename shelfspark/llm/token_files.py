"""Token ids in binary files: frequency-ranked, byte-aligned variable-length code with separate control bytes.

An id is written as its rank by frequency in the corpus, so the 256 most frequent
ids take one byte, the next 65,280 two, and so on up to four. A block of ids
has two parts: control bytes, each with the lengths of four ranks (two bits
each), and the data bytes behind one another. A reader looks the four lengths of
a control byte up in a table, sums them to places and gathers all ranks of the
block at once with numpy, then looks the ids up by rank.

A folder of token files holds ``ranks.u32`` (the id of each rank), ``manifest``
(Parquet: one row a file) and the files. Little endian, a file is::

    magic, ids a block (u32), crc32 of ranks.u32 (u32)
    blocks:     control bytes (a fourth of its ids, rounded up), data bytes
    documents:  doc_id i64[], known u8[] (0: the id is null), tokens u64[]
    blocks:     ids u32[], data bytes u32[]
    documents u64, blocks u64, ids u64, place of the documents' table u64, magic

The ids of a file's documents stand behind one another in ascending doc_id
order (null first), and those of file after file in the manifest's order, so a
document's start is a sum of counts. Blocks have a fixed number of ids: any
range of ids is read from its own blocks alone.

Scale: the texts are sorted by range of doc_id, ids are made once and staged in
plain files, whose counts give the ranks; then each staged file becomes a token
file. All files are streams: a task holds a slice of texts and a block of ids. A
file gets a name of its own for every attempt of a task and is listed by the
attempt that succeeds, so lost executors leave stray files but no wrong ones.
Driver and tasks hold the rank table, whose size is the vocabulary, and the driver
one row a file.

The tokenizers library makes the ids. Byte-level pre-tokenizers always cut before
a space that a character other than white space follows, so texts are cut there
first and each different piece of a slice is encoded once; other tokenizer files
encode whole texts.

Defined cases: null and empty texts are the end id alone; rows with one doc_id
stand in the order of their texts' hashes; a null doc_id comes first; an empty
table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import SLICE_BYTES, documents, materialize, shipped, slices, text_bytes

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 1 << 18
#: A file is closed at the first slice of texts that ends beyond this number of ids.
FILE_IDS = 1 << 27
#: Pieces of text whose ids a worker remembers, and new pieces that are encoded as one text.
REMEMBERED, JOINED = 1_000_000, 100

_MAGIC = b"rankvb01"
_HEAD = struct.Struct("<8sII")
_FOOT = struct.Struct("<QQQQ8s")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


# ids of texts ------------------------------------------------------------------------------------------------------

#: First bytes of characters that are surely not white space: printable ASCII, and those of UTF-8 sequences that hold none.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False


class Encoder:
    """Texts to ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.cuts = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                     and not pre.get("add_prefix_space") and not (spec.get("truncation") or spec.get("padding"))
                     and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or " " in a["content"] for a in added))
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level vocabulary has a character for each byte
            self.width[i] = len(token)
        for a in added:
            self.width[a["id"]] = len(a["content"].encode())
        self._forget()

    def _forget(self) -> None:
        self.seen = pa.array([], pa.large_string())
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the pieces of all texts, number of pieces of each)."""
        data, offsets = text_bytes(texts)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        if self.cuts and len(data):
            begins[:-2] |= (data[:-1] == 32) & _SOLID[data[1:]] & ~begins[1:-1]
        begins[-1] = False
        at = np.flatnonzero(begins)
        bounds = np.append(at, len(data)).astype(np.int64)
        made = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        return made, np.diff(np.searchsorted(at, offsets))

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces; those before which a text is cut anyway are put together for it."""
        data, offsets = text_bytes(pieces)
        long = np.diff(offsets) > 1
        joins = np.zeros(len(pieces), bool)
        joins[long] = self.cuts & (data[offsets[:-1][long]] == 32) & _SOLID[data[offsets[:-1][long] + 1]]
        joins[joins] = np.arange(joins.sum()) < joins.sum() // JOINED * JOINED
        size = np.zeros(len(pieces), np.int64)
        together, alone = pieces.filter(pa.array(joins)), pieces.filter(pa.array(~joins))
        ids, n = self._each(alone.to_pylist())
        size[~joins] = n
        if not len(together):
            return ids, size
        raw, ends = text_bytes(together)
        raw, cuts = raw.tobytes(), ends[::JOINED]
        more, _ = self._each([raw[a:b].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        to = np.cumsum(self.width[more])
        last = np.searchsorted(to, ends[1:])
        if last[-1] != len(to) - 1 or (to[last] != ends[1:]).any():  # not a vocabulary of bytes
            return self._each(pieces.to_pylist())
        size[joins] = np.diff(last, prepend=-1)
        # Both runs of ids back in the pieces' order.
        out, own = np.empty(len(ids) + len(more), np.uint32), np.repeat(joins, size)
        out[own], out[~own] = more, ids
        return out, size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts behind one another, number of ids of each)."""
        pieces, count = self.pieces(texts)
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.seen) > REMEMBERED or len(self.flat) > 16 * REMEMBERED:
            self._forget()
        # The pieces met before stand first, so theirs are the first numbers.
        coded = pa.concat_arrays([self.seen, pieces]).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)[len(self.seen):]
        new = coded.dictionary[len(self.seen):]
        if len(new):
            ids, size = self._encode(new)
            self.seen, self.flat, self.size = coded.dictionary, np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
        begin, own = np.cumsum(self.size) - self.size, self.size[which]
        to = np.cumsum(own)
        ids = self.flat[np.arange(int(to[-1])) + np.repeat(begin[which] - (to - own), own)]
        ends = np.concatenate(([0], to))[np.concatenate(([0], np.cumsum(count)))]
        return ids, np.diff(ends)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# the code ----------------------------------------------------------------------------------------------------------

#: The four lengths that a control byte holds, first number in the lowest bits.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_KEPT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of uint32 numbers."""
    more = (values > 0xFF).astype(np.uint8)
    more += values > 0xFFFF
    more += values > 0xFFFFFF
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[:len(values)] = more
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    each = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    return control, each[np.arange(4) <= more[:, None]]


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers of a block: lengths by table, places by sums, all numbers gathered at once."""
    if not n:
        return np.zeros(0, np.uint32)
    size = LENGTHS[control].ravel()[:n]
    begin = np.cumsum(size, dtype=np.int64) - size
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    return np.ndarray(len(data), "<u4", padded, strides=(1,))[begin] & _KEPT[size]


# files -------------------------------------------------------------------------------------------------------------

def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark would take it to be on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _place(uri: str):
    """(file system, path on it)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class FileWriter:
    """One token file, written as a stream."""

    def __init__(self, stream, ranks_crc: int, block_ids: int = BLOCK_IDS):
        self.stream, self.block_ids = stream, block_ids
        self.doc_ids, self.known, self.tokens, self.blocks = [], [], [], []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.size = self._write(_HEAD.pack(_MAGIC, block_ids, ranks_crc))

    def _write(self, data) -> int:
        self.stream.write(data)
        return len(data)

    def add(self, doc_ids: np.ndarray, known: np.ndarray, tokens: np.ndarray, ranks: np.ndarray) -> None:
        """Documents and the ranks of all their ids behind one another."""
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.known.append(known.astype(np.uint8))
        self.tokens.append(tokens.astype("<u8"))
        self.waiting.append(ranks)
        self.n_waiting += len(ranks)
        if self.n_waiting >= self.block_ids:
            self._blocks(self.n_waiting - self.n_waiting % self.block_ids)

    def _blocks(self, n: int) -> None:
        ranks = np.concatenate(self.waiting)
        for at in range(0, n, self.block_ids):
            part = ranks[at:min(n, at + self.block_ids)]
            control, data = encode(part)
            self.size += self._write(control.tobytes()) + self._write(data.tobytes())
            self.blocks.append((len(part), len(data)))
            self.n_ids += len(part)
        self.waiting, self.n_waiting = [ranks[n:]], len(ranks) - n

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) of the file."""
        if self.n_waiting:
            self._blocks(self.n_waiting)
        tables = self.size
        doc_ids = np.concatenate(self.doc_ids)
        for t in (doc_ids, np.concatenate(self.known), np.concatenate(self.tokens), np.array([b[0] for b in self.blocks], "<u4"),
                  np.array([b[1] for b in self.blocks], "<u4")):
            self.size += self._write(t.tobytes())
        self.size += self._write(_FOOT.pack(len(doc_ids), len(self.blocks), self.n_ids, tables, _MAGIC))
        self.stream.close()
        return len(doc_ids), self.n_ids, self.size


class TokenFile:
    """Read access to one token file: its documents, its blocks, any range of its ids."""

    def __init__(self, source, by_rank: np.ndarray):
        self.source, self.by_rank = source, by_rank
        magic, self.block_ids, ranks_crc = _HEAD.unpack(self._read(0, _HEAD.size))
        size = source.size()
        n_docs, n_blocks, self.n_ids, tables, end = _FOOT.unpack(self._read(size - _FOOT.size, _FOOT.size))
        if magic != _MAGIC or end != _MAGIC:
            raise ValueError("not a whole token file")
        if ranks_crc != zlib.crc32(by_rank.astype("<u4").tobytes()):
            raise ValueError("the token file was written with another rank table")
        raw = self._read(tables, size - _FOOT.size - tables)
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs)
        self.known = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs).astype(bool)
        self.tokens = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.block_n = np.frombuffer(raw, "<u4", n_blocks, 17 * n_docs).astype(np.int64)
        self.block_data = np.frombuffer(raw, "<u4", n_blocks, 17 * n_docs + 4 * n_blocks).astype(np.int64)
        size = (self.block_n + 3) // 4 + self.block_data
        self.block_at = _HEAD.size + np.cumsum(size) - size
        self.start = np.cumsum(self.tokens) - self.tokens

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(n))

    def block(self, i: int) -> np.ndarray:
        """The ids of block ``i``."""
        n, control = int(self.block_n[i]), int(self.block_n[i] + 3) // 4
        raw = np.frombuffer(self._read(self.block_at[i], control + self.block_data[i]), np.uint8)
        return self.by_rank[decode(raw[:control], raw[control:], n)]

    def ids(self, begin: int, n: int) -> np.ndarray:
        """``n`` ids from place ``begin`` on, read from their blocks alone."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block_ids, (begin + n - 1) // self.block_ids
        found = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return found[begin - first * self.block_ids:][:n]

    def checksums(self) -> np.ndarray:
        """crc32 of each document's ids as little-endian uint32, block by block."""
        out = np.zeros(len(self.tokens), np.int64)
        ends, at, doc = self.start + self.tokens, 0, 0
        for i in range(len(self.block_n)):
            ids = memoryview(self.block(i).astype("<u4").tobytes())
            stop = at + int(self.block_n[i])
            while doc < len(ends) and self.start[doc] < stop:
                a, b = max(int(self.start[doc]), at), min(int(ends[doc]), stop)
                out[doc] = zlib.crc32(ids[4 * (a - at):4 * (b - at)], int(out[doc]))
                if ends[doc] > stop:
                    break
                doc += 1
            at = stop
        return out


_RANKS: dict[str, np.ndarray] = {}


def _by_rank(folder: str) -> np.ndarray:
    if folder not in _RANKS:
        _RANKS.clear()
        system, path = _place(f"{folder}/ranks.u32")
        with system.open_input_file(path) as f:
            _RANKS[folder] = np.frombuffer(f.read(), "<u4").astype(np.uint32)
    return _RANKS[folder]


# jobs --------------------------------------------------------------------------------------------------------------

_STAGED = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_list(pa.uint32()))])
_STAGED_FILES = "part int, nth int, file string, n_ids long, id array<int>, n array<long>"


def _new_name(kind: str, part: int, nth: int) -> str:
    """A name of this attempt's own."""
    return f"{kind}-{part:06d}-{nth:04d}-{uuid.uuid4().hex[:12]}"


def _stage(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    """The task's texts, sorted already, to files of plain ids; a row for each file with the ids it counted."""
    from pyspark import TaskContext

    encode_texts, part = encoder(path), TaskContext.get().partitionId()
    system, root = _place(folder)
    system.create_dir(root, recursive=True)
    out = name = total = None
    done = n_ids = 0

    def closed() -> pa.RecordBatch:
        out.close()
        stream.close()
        found = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([done], pa.int32()), pa.array([name]), pa.array([n_ids], pa.int64()),
             pa.array([found], pa.list_(pa.int32())), pa.array([total[found]], pa.list_(pa.int64()))], names=[x.split()[0] for x in _STAGED_FILES.split(", ")])

    for b in slices(batches, limit=min(SLICE_BYTES, 4 * file_ids)):
        if out is None:
            name, n_ids, total = _new_name("staged", part, done), 0, np.zeros(end_id + 1, np.int64)
            stream = system.open_output_stream(f"{root}/{name}")
            out = pa.ipc.new_stream(stream, _STAGED, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        ids, count = encode_texts(b.column("text"))
        ids, count = np.insert(ids, np.cumsum(count), np.uint32(end_id)), count + 1
        n = np.bincount(ids, minlength=len(total))
        n[:len(total)] += total
        total, n_ids = n, n_ids + len(ids)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int64()), pa.array(ids, pa.uint32()))
        out.write_batch(pa.RecordBatch.from_arrays([b.column("doc_id"), lists], schema=_STAGED))
        if n_ids >= file_ids:
            yield closed()
            out, done = None, done + 1
    if out is not None:
        yield closed()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of the task's staged files, added up."""
    total = np.zeros(0, np.int64)
    for b in batches:
        n = np.bincount(b.column("id").flatten().to_numpy(), b.column("n").flatten().to_numpy(), len(total)).astype(np.int64)
        n[:len(total)] += total
        total = n
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(found, pa.int32()), "n": pa.array(total[found], pa.int64())})


_FILES = "part int, nth int, file string, n_docs long, n_ids long, n_bytes long"


def _rank(batches: Iterator[pa.RecordBatch], sent, staged: str, folder: str) -> Iterator[pa.RecordBatch]:
    """Staged files to token files."""
    rank_of, ranks_crc = sent.value[1:]
    for b in batches:
        for r in b.to_pylist():
            system, root = _place(folder)
            name = _new_name("tokens", r["part"], r["nth"]) + ".rvb"
            with system.open_output_stream(f"{root}/{name}") as stream, _place(staged)[0].open_input_stream(f"{_place(staged)[1]}/{r['file']}") as source:
                writer = FileWriter(stream, ranks_crc)
                for rows in pa.ipc.open_stream(source):
                    doc_id, lists = rows.column(0), rows.column(1)
                    writer.add(doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False),
                               np.diff(lists.offsets.to_numpy()), rank_of[lists.flatten().to_numpy()])
                made = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]], pa.int32()), "nth": pa.array([r["nth"]], pa.int32()),
                                              "file": [name], "n_docs": [made[0]], "n_ids": [made[1]], "n_bytes": [made[2]]})


def _spread(files: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` files, one or few to a task."""
    return files.repartition(max(1, min(n, 10_000)))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> str:
    """Token files of ``docs`` in ``folder``, which driver and tasks share; returns its full name."""
    spark = docs.sparkSession
    shipped(spark)
    path = path or tokenizer_path()
    folder, staged = qualified(spark, folder), qualified(spark, scratch_path(spark, "token-stage"))
    # A number of its own lets a much repeated row be dealt to several ranges.
    rows = documents(docs).withColumn("hash", F.xxhash64("text")).withColumn("own", F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), "hash", "own"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    plain = materialize(ordered.mapInArrow(lambda it: _stage(it, staged, path, end_id, file_ids), _STAGED_FILES), "token-stage-files")
    counted = plain.select("id", "n").mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    by_rank = np.array([r.id for r in sorted(counted, key=lambda r: (-r.n, r.id))], np.uint32)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    raw = by_rank.astype("<u4").tobytes()
    system, root = _place(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/ranks.u32") as f:
        f.write(raw)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, rank_of, zlib.crc32(raw)))
    files = _spread(plain.select("part", "nth", "file"), plain.count()).mapInArrow(lambda it: _rank(it, sent, staged, folder), _FILES)
    files.write.mode("overwrite").parquet(f"{folder}/manifest")
    if len(by_rank):
        system.delete_dir(_place(staged)[1])
    return folder


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
            system, path = _place(f"{folder}/{name}")
            with system.open_input_file(path) as source:
                f = TokenFile(source, _by_rank(folder))
                sums = f.checksums()
                for at in range(0, len(sums), 500 if with_ids else 100_000):
                    to = slice(at, at + (500 if with_ids else 100_000))
                    cols = {"doc_id": pa.array(f.doc_ids[to], pa.int64(), mask=~f.known[to]), "start": pa.array(f.start[to] + base),
                            "n_tokens": pa.array(f.tokens[to]), "ids_crc32": pa.array(sums[to])}
                    if with_ids:
                        cols["ids"] = pa.array([f.ids(int(s), int(n)).astype(np.int32) for s, n in zip(f.start[to], f.tokens[to], strict=True)],
                                               pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(cols)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of the token files in ``folder``: doc_id, start, n_tokens, ids_crc32; its ids if asked for."""
    shipped(spark)
    folder = qualified(spark, folder)
    files, base = [], 0
    for r in sorted(spark.read.parquet(f"{folder}/manifest").collect(), key=lambda r: (r.part, r.nth)):  # one row a file
        files.append((r.file, base))
        base += r.n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if not files:
        return spark.createDataFrame([], schema)
    return _spread(spark.createDataFrame(files, "file string, base long"), len(files)) \
        .mapInArrow(lambda it: _read(it, folder, with_ids), schema)


def token_digests(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the token files of ``docs`` (to the shared checkpoint folder unless named) and reads the documents back from them."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, folder or scratch_path(spark, "token-files"), **options))
