"""Token files: the code, the file format, and documents read back against the tokenizer itself."""

import random
import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest
from shelfspark.llm import token_files as tf
from shelfspark.llm.common import read
from shelfspark.llm.queries import QUERIES
from shelfspark.session import scratch_path


def _expected(rows: list[tuple[int | None, str | None]], end_id=tf.END_ID):
    """(doc_id, ids with the end id) in file order but for rows that share an id."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tf.tokenizer_path())
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end_id]) for i, x in rows]


def _crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_code_round_trip():
    rng = np.random.default_rng(0)
    edges = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    for n in (0, 1, 2, 3, 4, 5, 8, 1000, 4097):
        values = np.where(rng.random(n) < 0.5, rng.choice(edges, n), (2.0 ** (32 * rng.random(n))).astype(np.uint64).astype(np.uint32)).astype(np.uint32)
        control, data = tf.encode(values)
        assert len(control) == -(-n // 4)
        assert len(data) == sum(1 + (v > 255) + (v > 65535) + (v > 2**24 - 1) for v in values.tolist())
        assert tf.decode(control, data, n).tolist() == values.tolist()
    assert tf.encode(np.array([1, 256, 65536, 2**24], np.uint32))[0].tolist() == [0b11100100]


def test_file_round_trip():
    rng = np.random.default_rng(1)
    by_rank = rng.permutation(70_000).astype(np.uint32)
    rank_of = np.argsort(by_rank).astype(np.uint32)
    crc = zlib.crc32(by_rank.astype("<u4").tobytes())
    docs = [rng.integers(0, 70_000, n).astype(np.uint32) for n in (1, 5, 64, 63, 65, 1000, 1, 128)]
    buffer = pa.BufferOutputStream()
    w = tf.FileWriter(buffer, crc, block_ids=64)
    for at in (0, 3, 6):
        part = docs[at:at + 3]
        w.add(np.arange(at, at + len(part)) - 2, np.arange(len(part)) != 1, np.array([len(d) for d in part]), rank_of[np.concatenate(part)])
    assert w.close()[:2] == (8, sum(map(len, docs)))
    raw = buffer.getvalue()
    f = tf.TokenFile(pa.BufferReader(raw), by_rank)
    assert f.doc_ids.tolist() == [i - 2 for i in range(8)] and f.known.tolist() == [i not in (1, 4, 7) for i in range(8)]
    assert f.checksums().tolist() == [_crc(d) for d in docs]
    for d, s in zip(docs, f.start.tolist(), strict=True):
        assert f.ids(s, len(d)).tolist() == d.tolist()
    with pytest.raises(ValueError, match="rank table"):
        tf.TokenFile(pa.BufferReader(raw), by_rank[::-1].copy())
    with pytest.raises(ValueError, match="whole"):
        tf.TokenFile(pa.BufferReader(raw.to_pybytes()[:-8] + bytes(8)), by_rank)


def test_encoder_equals_the_tokenizer():
    rng = random.Random(3)
    parts = ["a", "word", " ", "  ", "\n", " \n", "é", " ", "　", " ", "'s", "1", "23", ".", "!?", "<|endoftext|>", "\t", "\U0001f600", "́",
             "'ll", "\x1c", "ü", "x" * 50, "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)]
    e = tf.Encoder(tf.tokenizer_path())
    assert e.cuts
    for part in (texts[:1500], texts[1500:], texts):  # pieces met before, and new ones
        ids, count = e(pa.array(part, pa.large_string()))
        expected = _expected([(None, t) for t in part])
        assert count.tolist() == [len(x) - 1 for _, x in expected]
        assert ids.tolist() == [i for _, x in expected for i in x[:-1]]


def test_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, cases.SF, "documents").collect()]
    found = sorted(QUERIES["op11_token_files"](spark, cases.SF).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, (i, ids) in zip(found, sorted(_expected(docs)), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), _crc(ids))
        at += len(ids)


def test_awkward_documents_and_small_files(spark):
    texts, ids = cases.awkward(random.Random(5))
    texts += ["x" * 300_000, "<|endoftext|>", "word " * 60_000]
    ids += [10_000, -5, 10_001]
    df = cases.frame(spark, texts, ids).repartition(3)
    folder = tf.write_tokens(df, scratch_path(spark, "small-token-files"), file_ids=1000)
    found = tf.read_tokens(spark, folder, with_ids=True).collect()
    found.sort(key=lambda r: r.start)
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:k]) for k in range(len(found))]
    order = [(r.doc_id is not None, r.doc_id or 0) for r in found]
    assert order == sorted(order)
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == _crc(r.ids) for r in found)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.ids) for r in found) == sorted(((i is None, i or 0), x) for i, x in _expected(list(zip(ids, texts, strict=True))))
    listed = spark.read.parquet(f"{folder}/manifest")
    assert listed.count() > 3 and listed.agg({"n_docs": "sum"}).first()[0] == len(texts)
    # the most frequent id has the first rank
    counts: dict[int, int] = {}
    for r in found:
        for i in r.ids:
            counts[i] = counts.get(i, 0) + 1
    assert tf._by_rank(folder).tolist() == sorted(counts, key=lambda i: (-counts[i], i))


def test_other_tokenizers_and_empty_table(spark, tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers
    t = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 70_000, "b": 5}, unk_token="[UNK]"))
    t.normalizer, t.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    path = str(tmp_path / "words.json")
    t.save(path)
    e = tf.Encoder(path)
    assert not e.cuts
    ids, count = e(pa.array(["A b c", "", "a", "b b"], pa.large_string()))
    assert ids.tolist() == [70_000, 5, 0, 70_000, 5, 5] and count.tolist() == [3, 0, 1, 2]
    assert tf.token_digests(cases.frame(spark, [])).count() == 0
