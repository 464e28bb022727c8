"""Importance resampling: checksums of joined words, features without loss at line ends, draws against a plain version."""

import hashlib
import math
import random
import zlib
from collections import Counter

import cases
import numpy as np
from shelfspark.llm import importance
from shelfspark.llm.common import read
from shelfspark.llm.queries import QUERIES


def _features(text: str | None) -> Counter:
    w = cases.ITEM_WORD.findall(cases.lowered(text))
    return Counter(zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(rows: list[tuple[int | None, str | None]], target: list[str | None], percent=5):
    """(doc_id, n_features, weight, score, rank, n_words) by the definition."""
    corpus, wanted = Counter(), Counter()
    for _, t in rows:
        corpus.update(_features(t))
    for t in target:
        wanted.update(_features(t))
    s_all, t_all = float(corpus.total()), float(wanted.total())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + 10_000) / ((corpus[b] + 1.0) * (t_all + 10_000)))) for b in corpus}
    out = []
    for i, t in rows:
        f = _features(t)
        weight = sum(gain[b] * n for b, n in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, f.total(), weight, score, None, len(cases.ITEM_WORD.findall(cases.lowered(t)))])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[:percent * len(able) // 100]):
        x[4] = k + 1
    return out


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_checksums_of_joined_words():
    rng = random.Random(0)
    sizes = [1, 2, 62, 63, 64, 65, 127, 128, 129, 5000, 100_000]
    parts = [bytes(rng.choices(range(256), k=n)) for n in sizes] + [b""]
    pairs = [(a, b) for a in parts for b in parts]
    got = importance.crc_joined(np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([zlib.crc32(b) for _, b in pairs], np.uint32),
                                np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, cases.SF, "documents").collect()]
    items = [r.text for r in read(spark, cases.SF, "benchmark").collect()]
    assert _sorted(QUERIES["op12_importance"](spark, cases.SF).collect()) == _sorted(plain(docs, items))


def test_awkward_documents(spark):
    texts, ids = cases.awkward(random.Random(12))
    texts += ["a\n\nB c\n \nd", "x\ny\nz\nx\ny\nz\n" * 50, "é\nÉ à\n" * 30, "w" * 200_000 + " b " + "v" * 70, "same line here\n" * 400, "a\r\nb\x0bc"]
    ids += [900 + k for k in range(6)]
    target = [None, "", "x y z x y", texts[10], "same line"]
    df = cases.frame(spark, texts, ids).repartition(4)
    items = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(target)], "item_id long, text string, doc_id string")
    found = importance.resample(df, items, percent=40)
    rows = _sorted(found.collect())
    expected = _sorted(plain(list(zip(ids, texts, strict=True)), target, 40))
    # rows that repeat both doc_id and text are alike; which of them has which of their ranks is open
    assert rows == expected and found.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]


def test_lines_are_hashed_once(spark):
    df = cases.frame(spark, ["one two three\nfour", "ONE  two, three\nfour", "one two three", None, "\n\n"])
    features = importance.Features(df)
    assert sorted(r.times for r in features.lines.collect()) == [2, 3]
    total = sum((_features(t) for t in ("one two three\nfour", "one two three\nfour", "one two three")), Counter())
    counts = features.counts()
    assert {b: n for b, n in enumerate(counts.tolist()) if n} == dict(total)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(cases.frame(spark, []), items).count() == 0
    texts = ["a b c " * 10, "d e f " * 10, None]
    assert _sorted(importance.resample(cases.frame(spark, texts), items, percent=50).collect()) == _sorted(plain(list(enumerate(texts)), [], 50))
