"""Documents to token ids: quality selection, near duplicates, personal data, source mixing, tokens.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taintgrid.llm import bpe, jaccard, mixing, pii, quality
from taintgrid.llm.queries import prepare, token_digests
from taintgrid.llm.shared import table
from taintgrid.session import checkpoint


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is one half or more."""
    prepare(spark)
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the smallest doc_id."""
    prepare(spark)
    return jaccard.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind."""
    prepare(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their target weights, shuffled."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of ids and of what they decode to."""
    prepare(spark)
    ids = bpe.round_trip(docs)
    return token_digests(ids, "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", select_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("source_mixing", mix_sources),
    ("tokens", encode_tokens),
]
ORACLE_SQL = None  # the first stage is a trained model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return docs
