"""Language identification by rank-order profiles.

A profile is a language's ``PROFILE`` most frequent letter n-grams (1 to 3
characters, words marked by a space on each side), in order of frequency. A
document's own most frequent n-grams, from its whole text, are compared with
each profile by out-of-place distance: the sum of rank differences, with
``PROFILE`` for an n-gram the profile lacks. The nearest language wins; its
score is one minus the distance over the largest one possible.

An n-gram is coded exactly in one integer (21 bits a character), so counting is
a sort of integers. Profiles are fitted on a bounded sample: about
``SAMPLE_DOCS`` labelled, not held-out documents a language, chosen by a hash of
their id; all documents are classified in whole.

``keep_identified`` keeps what scores at least ``score_bound``: a share of the score
that nearly all rightly identified labelled documents reach (held-out ones are not
read), so texts in a script or language that no profile knows go. Without any
learned language nothing can be told apart and all rows stay.

Defined cases: null text or a text without letters is ``und`` with score 0;
without any learned language all are ``und``; equal n-gram counts go by code,
equal distances to the first language by name; repeated rows are returned each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, group_by_value, held_out, materialize, shipped

PROFILE = 400
BOUND_QUANTILE, BOUND_SHARE = 0.01, 0.6
SAMPLE_DOCS = 2000
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of all n-grams, by code; both empty if there is no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(_letters()[c], c, 32)
    c = np.concatenate(([32], c, [32]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    two = (c[:-1] << 21) | c[1:]
    codes = np.concatenate([c[c != 32], two, (two[:-1] << 21) | c[2:]]) if len(c) > 2 else c[:0]
    codes.sort()
    at = group_by_value(codes)
    return codes[at], np.diff(np.append(at, len(codes)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language, added up for a few hundred rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 300):
            b = whole.slice(at, 300)
            by: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                codes, counts = (np.concatenate(x) for x in zip(*found, strict=True))
                codes, where = np.unique(codes, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes, pa.int64()),
                                                  "n": pa.array(np.bincount(where, counts, len(codes)).astype(np.int64))})


def learn(docs: DataFrame, profile: int = PROFILE, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[int]]:
    """Each language's most frequent n-grams in order, from documents with a language that are not held out."""
    shipped(docs.sparkSession)
    rows = documents(docs, F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # A written table: Spark sees that it is small and sends it to the rows, not the rows to it.
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages")
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("profile")), F.lit(1 << 30)) * F.col("size") < F.lit(sample_docs * (1 << 30))
    sample = rows.join(sizes, "lang").where(drawn).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Profiles:
    def __init__(self, ranked: dict[str, list[int]], profile: int = PROFILE):
        self.langs = sorted(ranked)
        self.size = profile
        self.codes = np.array(sorted({g for v in ranked.values() for g in v}), np.int64)
        # one more row, for n-grams that no profile has; -1 is "not in this profile"
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, np.array(ranked[lang], np.int64)), k] = np.arange(len(ranked[lang]))

    def classify(self, text: str) -> tuple[str, float]:
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = codes[np.argsort(-counts, kind="stable")[:self.size]]
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        rank = self.rank[at]
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (len(own) * self.size))


_BUILT: dict = {}


def _model(sent) -> Profiles:
    key, ranked, profile = sent.value
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Profiles(ranked, profile)
    return _BUILT[key]


def _classify(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = _model(sent)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            found = [model.classify(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"),
                                              "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64()),
                                              **({"text_key": b.column("text_key")} if "text_key" in b.schema.names else {})})


def predict(docs: DataFrame, ranked: dict[str, list[int]], profile: int = PROFILE, with_key: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score; a hash of the text if asked for."""
    spark = docs.sparkSession
    shipped(spark)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, ranked, profile))
    rows = documents(docs).withColumn("held_out", held_out(F.col("doc_id")))
    if with_key:
        rows = rows.withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(lambda it: _classify(it, sent), "doc_id long, held_out boolean, lang_pred string, score double"
                           + (", text_key long" if with_key else ""))


def _right(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """The scores above 0 of the rows whose label is found."""
    model = _model(sent)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            found = [model.classify(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"score": pa.array(
                [s for (x, s), lang in zip(found, b.column("lang").to_pylist(), strict=True) if x == lang and s > 0], pa.float64())})


def score_bound(docs: DataFrame, ranked: dict[str, list[int]], profile: int = PROFILE, quantile: float = BOUND_QUANTILE,
                share: float = BOUND_SHARE) -> float:
    """``share`` of the score that all but a ``quantile`` of the rightly identified labelled documents reach; held-out ones are not read.

    0 where there is none.
    """
    spark = docs.sparkSession
    shipped(spark)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, ranked, profile))
    rows = documents(docs, F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    scores = rows.select("lang", "text").mapInArrow(lambda it: _right(it, sent), "score double")
    return share * (scores.agg(F.percentile_approx("score", quantile, 10_000).alias("q")).first().q or 0.0)


def _keep(batches: Iterator[pa.RecordBatch], sent, column: str, min_score: float) -> Iterator[pa.RecordBatch]:
    """Rows whose text is in a learned language, all columns as they are."""
    model = _model(sent)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            found = [model.classify(t or "") for t in b.column(column).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and score > 0 and score >= min_score for lang, score in found], pa.bool_()))


def keep_identified(docs: DataFrame, ranked: dict[str, list[int]], min_score: float = 0.0, profile: int = PROFILE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is identified with at least ``min_score``; never those that share no n-gram with a profile.

    All rows stay if no language was learned.
    """
    spark = docs.sparkSession
    if not ranked:
        return docs
    shipped(spark)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, ranked, profile))
    return docs.mapInArrow(lambda it: _keep(it, sent, "text", min_score), docs.schema)
