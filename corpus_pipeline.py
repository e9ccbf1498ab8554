"""A training corpus from raw documents, in five stages.

Each stage takes the documents its predecessor kept, written as Parquet and read again, and returns the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vqaspark.llm import common, decontamination, near_duplicates, packing, personal_data, quality
from vqaspark.llm.queries import WORD_VOCABULARY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality rules keep, each judged by itself; a null or empty text goes, an empty table stays empty."""
    return quality.kept_rows(docs, quality.fit_on(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, whether its rows have ids or not."""
    return near_duplicates.distinct_rows(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; each row is judged by its own text, a null one is clean, an empty table stays empty."""
    return decontamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind in brackets; n_chars follows, a null text stays null, repeated rows are treated each."""
    return personal_data.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, which cover every id of every row once; repeated rows and rows without an id have pieces of their own."""
    return packing.pack(docs, WORD_VOCABULARY)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers have no SQL counterpart; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name, f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
