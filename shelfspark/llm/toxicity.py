"""Toxicity by multiple-instance learning with noisy-or.

A document is a bag of sentences. A sentence is toxic with probability
sigmoid(b + the weights of its words' features); a document is toxic if any
sentence is: 1 - prod(1 - p). The weights are fitted on document labels only, by
gradient descent on the documents' log-likelihood, and then locate the offending
sentences. A word's features are the lower-cased word without outer punctuation
and its first four and first five characters, so inflected forms share weights.

Learning: features are chosen by how far their document frequencies in toxic and
other labelled documents lie apart (a distributed count, the ``FEATURES`` most
telling ones). The fit runs on a bounded sample: about ``SAMPLE_DOCS`` labelled
documents that are not held out, chosen by a hash of their id; only their chosen
features leave the executors. All documents are scored, in whole.

Defined cases: null and empty texts are one empty sentence and get its score; a
doc_id with contradictory or repeated labels counts as toxic if any label says
so; without labelled documents of both kinds every score is the share of toxic
ones (0 if there are none); repeated rows are returned each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, documents, held_out, materialize, shipped, slices, text_bytes

FEATURES = 8192
#: Least difference of a feature's log-odds, in standard deviations; rarer words would only name single documents.
MIN_APART = 2.3
SAMPLE_DOCS = 20_000
STEPS = 300
#: Text without sentence ends is judged in runs of this many words.
SENTENCE_WORDS = 40
_PUNCTUATION = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "¡¿«»“”„‘’…–—"


def word_features(word: str) -> list[str]:
    w = word.lower().strip(_PUNCTUATION)
    return [w, w[:4] + "*", w[:5] + "*"] if len(w) >= 5 else [w] if w else []


class Sentences:
    """Words of a slice of texts and the sentence of each: sentences end after . ! ? or at a line's end, or after SENTENCE_WORDS words."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(texts)
        self.words = w = Words(texts)
        n = len(w)
        line = np.concatenate(([0], np.cumsum(data == 10)))
        last_byte = w.packed[np.cumsum(w.size) - 1] if n else w.packed
        begins = np.zeros(n, bool)
        begins[1:] = np.isin(last_byte[:-1], [33, 46, 63]) | (line[w.origin[1:]] != line[w.origin[:-1] + w.size[:-1]])
        first = w.first[:-1][w.count > 0]
        begins[first] = True
        at = np.flatnonzero(begins)
        since = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        self.begin = np.flatnonzero(since % SENTENCE_WORDS == 0)  # first word of each sentence
        self.text = w.text_of()[self.begin]  # text of each sentence
        self.per_text = np.bincount(self.text, minlength=len(w.count))
        self.data, self.offsets = data, offsets

    def of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin)), np.diff(np.append(self.begin, len(self.words))))

    def span(self, s: int) -> tuple[int, int]:
        """Code points [start, end) of a sentence in its text."""
        w, at = self.words, self.offsets[self.text[s]]
        last = (self.begin[s + 1] if s + 1 < len(self.begin) else len(w)) - 1
        a, b = w.origin[self.begin[s]], w.origin[last] + w.size[last]
        chars = lambda x, y: int(((self.data[x:y] & 0xC0) != 0x80).sum())
        before = chars(at, a)
        return before, before + chars(a, b)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, other documents) with each feature once a document."""
    for b in slices(batches):
        words = Words(b.column("text"))
        index, different = words.encoded()
        number: dict[str, int] = {}
        features = [[number.setdefault(f, len(number)) for f in word_features(w.decode())] for w in different]
        pairs = np.unique(words.text_of() * max(1, len(different)) + index)
        doc, word = pairs // max(1, len(different)), pairs % max(1, len(different))
        count = np.array([len(f) for f in features], np.int64)
        flat = np.array([x for f in features for x in f], np.int64)
        begin = np.cumsum(count) - count
        rep = count[word]
        at = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(begin[word], rep)
        seen = np.unique(np.repeat(doc, rep) * max(1, len(number)) + flat[at])
        doc, feature = seen // max(1, len(number)), seen % max(1, len(number))
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)[doc] > 0
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(number), pa.string()),
                                          "yes": pa.array(np.bincount(feature, toxic, len(number)).astype(np.int64)),
                                          "no": pa.array(np.bincount(feature, ~toxic, len(number)).astype(np.int64))})


def _bags(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Per document: label, number of sentences, and (sentence, feature) of the chosen features in them."""
    for b in slices(batches):
        s = Sentences(b.column("text"))
        index, different = s.words.encoded()
        features = [[number[f] for f in word_features(w.decode()) if f in number] for w in different]
        known = np.array([bool(f) for f in features], bool)
        at = np.flatnonzero(known[index]) if len(index) else index
        sentence, text = s.of_word()[at], s.words.text_of()[at]
        own: list[tuple[list, list]] = [([], []) for _ in range(b.num_rows)]
        first = np.cumsum(s.per_text) - s.per_text
        for w, i, d in zip(index[at].tolist(), sentence.tolist(), text.tolist(), strict=True):
            for f in features[w]:
                own[d][0].append(i - int(first[d]))
                own[d][1].append(f)
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_pydict({"toxic": b.column("toxic"), "n": pa.array(np.maximum(s.per_text, 1), pa.int64()),
                                          "sentence": pa.array([x[0] for x in own], kind), "feature": pa.array([x[1] for x in own], kind)})


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(toxic: np.ndarray, n: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int,
        steps: int = STEPS, l2: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that make the noisy-or of the sentences fit the documents' labels (Adam, all documents in each step)."""
    key, where = np.unique(doc * (int(sentence.max(initial=0)) + 1) + sentence, return_inverse=True)
    of = np.zeros(len(key), np.int64)  # document of each sentence that has features
    of[where] = doc
    plain = n - np.bincount(of, minlength=len(n))  # sentences without features
    share = toxic.mean()
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(max(share, 1e-3) / max(1.0, n.mean()) / 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        b = theta[-1]
        z = b + np.bincount(where, theta[feature], len(key))
        total = np.bincount(of, np.logaddexp(0, z), len(n)) + plain * np.logaddexp(0, b)
        pull = np.where(toxic, -1 / np.maximum(np.expm1(np.minimum(total, 500)), 1e-9), 1.0) / len(n)
        by_sentence = pull[of] * _sigmoid(z)
        g = np.append(np.bincount(feature, by_sentence[where], n_features), by_sentence.sum() + (pull * plain).sum() * _sigmoid(np.array(b)))
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def learn(docs: DataFrame, labels: DataFrame, features: int = FEATURES, sample_docs: int = SAMPLE_DOCS) -> tuple[dict[str, float], float]:
    """(weight of each chosen feature, bias), from labelled documents that are not held out."""
    spark = docs.sparkSession
    shipped(spark)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size, share = marks.agg(F.count(F.lit(1)), F.avg((F.col("toxic") > 0).cast("double"))).first()
    if not size or share in (0, 1):
        return {}, float(np.log(share / (1 - share))) if share and share < 1 else (-40.0 if not share else 40.0)
    drawn = marks.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 30)) * F.lit(size) < F.lit(sample_docs * (1 << 30)))
    sample = materialize(documents(docs).join(drawn, "doc_id").select("text", "toxic"), "toxicity-sample")
    counts = sample.mapInArrow(_frequencies, "feature string, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    sizes = sample.agg(F.sum((F.col("toxic") > 0).cast("long")), F.sum((F.col("toxic") <= 0).cast("long"))).first()
    yes, no = max(sizes[0] or 0, 1), max(sizes[1] or 0, 1)
    odds = F.log((F.col("yes") + 0.5) / (yes + 1)) - F.log((F.col("no") + 0.5) / (no + 1))
    apart = F.abs(odds) / F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    telling = counts.withColumn("apart", apart).where(F.col("apart") >= MIN_APART)
    chosen = [r.feature for r in telling.orderBy(F.desc("apart"), "feature").limit(features).collect()]
    number = {f: i for i, f in enumerate(chosen)}
    bags = sample.mapInArrow(lambda it: _bags(it, number), "toxic int, n long, sentence array<int>, feature array<int>").toArrow().combine_chunks()
    lengths = bags.column("feature").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if bags.num_rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(bags.num_rows), lengths)
    flat = lambda c: bags.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    weights, bias = fit(bags.column("toxic").to_numpy() > 0, bags.column("n").to_numpy(), doc, flat("sentence"), flat("feature"), len(chosen))
    return dict(zip(chosen, weights.tolist(), strict=True)), bias


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    _, weights, bias = sent.value
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
    for b in slices(batches):
        s = Sentences(b.column("text"))
        index, different = s.words.encoded()
        weight = np.array([sum(weights.get(f, 0.0) for f in word_features(w.decode())) for w in different] or [0.0])
        z = bias + (np.add.reduceat(weight[index], s.begin) if len(s.begin) else np.zeros(0))
        total = np.bincount(s.text, np.logaddexp(0, z), b.num_rows) + np.where(s.per_text == 0, np.logaddexp(0, bias), 0)
        score = -np.expm1(-total)
        p = _sigmoid(z)
        offending: list[list] = [[] for _ in range(b.num_rows)]
        for i in np.flatnonzero(p >= 0.5).tolist():
            start, end = s.span(i)
            offending[int(s.text[i])].append({"start": start, "end": end, "p": float(p[i])})
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(score),
                                          "predicted": pa.array(score >= 0.5).cast(pa.int32()), "offending": pa.array(offending, pa.list_(span))})


def score(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, offending (code point span and probability of toxic sentences)."""
    spark = docs.sparkSession
    shipped(spark)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, {k: v for k, v in model[0].items() if v}, model[1]))
    rows = documents(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(lambda it: _score(it, sent), "doc_id long, held_out boolean, score double, predicted int, "
                           "offending array<struct<start: long, end: long, p: double>>")
