"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

1. language ID: documents without an identified language go (without a letter, or much farther from all
   profiles than labelled documents are); without any labelled document all stay;
2. line dedup: repeated lines go, except in the last document that holds them;
3. SimHash near-dedup: one document of each group stays, one with its smallest doc_id;
4. benchmark decontamination: hit spans go, and documents that are mostly benchmark;
5. packing: the pieces of the sequences.

Stages 1 to 4 return the columns of their input; a stage that changes texts
brings ``n_chars``, where there is one, up to date. Each stage works on all rows
its predecessor kept; rows with a null doc_id are kept by stages that decide by
id. An empty table passes through all stages.

``ORACLE_SQL`` is None: rank-order profiles and tokenizer ids have no SQL form.
The stages are tested against brute-force versions instead.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfspark.llm import decontaminate, langid, line_dedup, packing, simhash  # noqa: E402
from shelfspark.llm.common import read  # noqa: E402
from shelfspark.session import scratch_path  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranked = langid.learn(docs)
    return langid.keep_identified(docs, ranked, langid.score_bound(docs, ranked))


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.drop_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.clean(docs, read(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
          ("decontamination", decontamination), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
