"""Corpus pipeline: quality, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Stages hand over Parquet: ``run`` writes
each result to the shared checkpoint folder and reads it back, so a lost
executor never repeats an earlier stage.

1. quality: documents that the classifier rejects (junk or toxic) go.
2. line dedup: later copies of repeated line runs of 50 words or more are cut;
   documents that lose all their lines go, n_chars follows the text.
3. near duplicates: one document of each class stays.
4. mixing: documents are replicated to tempered source weights and shuffled.
5. packing: token sequences of at most 1024 ids along the Hilbert curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierflow.llm.common import table, written
from courierflow.llm.line_dedup import line_dedup
from courierflow.llm.mixing import mix_sources
from courierflow.llm.near_dup import one_of_each
from courierflow.llm.packing import pack
from courierflow.llm.quality import classify

MIX_SEED, MIX_POWER = 7, 0.5

#: Model scores and LSH cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classify(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup(docs).where("n_removed = 0 OR n_removed < n_lines")
    return cut.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, power=MIX_POWER, seed=MIX_SEED).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", cut_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
