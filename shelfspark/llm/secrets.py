"""Secret scan with character Markov models, in DataFrame functions only.

Three fixed patterns give the base spans. The method adds spans of kind
``markov``: a long token is scored by the log-likelihood ratio of two character
bigram models, random strings against ordinary identifiers, and is reported where
the ratio passes a total and a mean per bigram. The models are trained on labelled samples from
the corpus itself: the values of base spans are random strings, all other tokens
are ordinary. The training sample is bounded (about ``SAMPLE_DOCS`` documents by a
hash of id and text); the scan covers every whole text.

Positions come from the pieces between matches: the regular expression that
splits a text also extracts its matches, and running sums over both give the
spans in code points. Everything is an expression on one row, so nothing is
shuffled but the models' few thousand counts.

Defined cases: null is the empty text; added spans never overlap base spans;
without labelled random strings nothing is added; repeated rows are returned
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

# Patterns of the contract. The plus of access and hex is folded into their least length; a run is
# always taken whole, so the matches are the same.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "markov")
#: Tokens the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Tokens that train the model of ordinary identifiers.
ORDINARY = r"[A-Za-z0-9+/_=-]{5,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SAMPLE_DOCS = 20_000
MIN_TOTAL, MIN_MEAN = 12.0, 0.75
#: Weight, in observations, of a character's own frequency in each row of a model.
PRIOR = 8.0
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of all earlier values; in blocks, so a text with many matches stays linear but for a small factor."""
    def sums(values: Column, start: Column) -> Column:
        none = F.array().cast("array<long>")
        state = F.struct(start.cast("long").alias("at"), none.alias("all"))
        return F.aggregate(values, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["all"], s["at"]).alias("all")), lambda s: s["all"])

    block = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda i: F.slice(lengths, i * _BLOCK + 1, _BLOCK))
    total = F.transform(block, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.flatten(F.zip_with(block, sums(total, F.lit(0)), sums))


def _spans(matches: Column, pieces: Column, kind: int, keep: Column | None = None) -> Column:
    """array<struct<a, k, b, v>> of the matches; ``keep``: values parallel to the matches, long enough or not."""
    n = F.size(matches)
    sizes = F.transform(F.sequence(F.lit(1), n), lambda i: F.length(F.get(pieces, i - 1)) + F.length(F.get(matches, i - 1)))
    at = _running(sizes)
    value = keep if keep is not None else matches
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        (F.get(at, i) + F.length(F.get(pieces, i))).alias("a"), F.lit(kind).alias("k"),
        (F.get(at, i) + F.length(F.get(pieces, i)) + F.length(F.get(matches, i))).alias("b"), F.get(value, i).alias("v")))
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<a: bigint, k: int, b: bigint, v: string>>"))


def _found(docs: DataFrame, column: str, pattern: str, kind: int, group: int = 0) -> DataFrame:
    """``docs`` with the spans of a pattern."""
    whole, cut, value = f"_{column}_m", f"_{column}_p", f"_{column}_v"
    out = docs.withColumn(whole, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    some = F.size(whole) > 0
    out = out.withColumn(cut, F.when(some, F.split("text", pattern, -1)))
    if group:
        out = out.withColumn(value, F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))))
    return out.withColumn(column, _spans(F.col(whole), F.col(cut), kind, F.col(value) if group else None)) \
        .drop(whole, cut, *([value] if group else []))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, assign, access, hex: the base spans by kind."""
    rows = _found(_found(_found(documents(docs), "assign", ASSIGN, 0, 2), "access", ACCESS, 1), "hex", HEX, 2)
    return rows.withColumn("assign", F.filter("assign", lambda s: F.length(s["v"]) >= ASSIGN_MIN))


def _tail(values: Column) -> Column:
    return F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))


def _bigrams(tokens: DataFrame) -> DataFrame:
    """(c, n): counts of neighbouring characters in the column ``v``, both in the alphabet."""
    chars = F.split("v", "")
    two = tokens.where(F.length("v") >= 2).select(F.explode(F.zip_with(chars, _tail(chars), lambda a, b: F.concat(a, b))).alias("c"))
    return two.where(F.col("c").rlike(r"^[A-Za-z0-9+/_=.-]{2}$")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float] | None:
    """Log-likelihood ratio of each bigram of the alphabet, row by row; None without labelled random strings."""
    n = docs.count()
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("secrets")), F.lit(1 << 30)) * F.lit(n) < F.lit(sample_docs * (1 << 30))
    spans = base_spans(docs.where(drawn)).withColumn("base", F.concat("assign", "access", "hex"))
    random = spans.select(F.explode("base.v").alias("v")).where(F.col("v").rlike(r"[0-9]"))
    # Ordinary tokens: what is left of the text without the base spans' values.
    rest = spans.select(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ").alias("text"))
    ordinary = rest.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("v"))
    # Each table has at most len(ALPHABET) ** 2 rows.
    a, b = ({r.c: r.n for r in _bigrams(t).collect()} for t in (random, ordinary))
    if not a:
        return None
    return [p - q for p, q in zip(_transitions(a), _transitions(b), strict=True)]


def _transitions(counts: dict[str, int]) -> list[float]:
    """log P(second | first) for all pairs of the alphabet; rare first characters lean on the second's own frequency."""
    second = {y: 1 + sum(counts.get(x + y, 0) for x in ALPHABET) for y in ALPHABET}
    everything = sum(second.values())
    out = []
    for x in ALPHABET:
        first = sum(counts.get(x + y, 0) for y in ALPHABET)
        out += [math.log((counts.get(x + y, 0) + PRIOR * second[y] / everything) / (first + PRIOR)) for y in ALPHABET]
    return out


def _ratio(token: Column, model: list[float]) -> Column:
    table = F.from_json(F.lit(json.dumps([round(x, 5) for x in model])), "array<double>")
    # The token is split once; a long one costs its length. The last place stands beside a null.
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    gains = F.zip_with(places, _tail(places), lambda a, b: F.coalesce(F.get(table, a * len(ALPHABET) + b), F.lit(0.0)))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)


def _joined(spans: Column) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kind, s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float] | None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    rows = base_spans(docs).withColumn("base", F.concat("assign", "access", "hex"))
    if model is None:
        rows = rows.withColumn("added", F.filter("base", lambda s: F.lit(False)))
    else:
        rows = _found(rows, "added", TOKEN, 3)
        rows = rows.withColumn("added", F.filter("added", lambda s: ~F.exists("base", lambda x: (x["a"] < s["b"]) & (s["a"] < x["b"]))))
        rows = rows.withColumn("added", F.transform("added", lambda s: s.withField("r", _ratio(s["v"], model))))
        rows = rows.withColumn("added", F.filter("added", lambda s: (s["r"] >= MIN_TOTAL) & (s["r"] >= MIN_MEAN * (F.length(s["v"]) - 1))))
        rows = rows.withColumn("added", F.transform("added", lambda s: s.dropFields("r")))
    return rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
                       F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"),
                       F.size("added").cast("long").alias("n_markov"))
