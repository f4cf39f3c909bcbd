"""A training corpus from raw documents, in five stages.

Each stage reads what its predecessor wrote: languages are identified, one document of each
group of near copies stays, contaminated documents go, sources are mixed to their weights,
and the rest becomes token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillwise.llm import decontaminate, langid, mixing, repair, simhash
from tillwise.llm.queries import tokenizer_path
from tillwise.session import materialize, shared_scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or without a clear one go."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark passages, unchanged."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, benchmark)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its place, number and checksum of ids, read back from the shards."""
    return repair.encode_documents(docs, shared_scratch(spark, "token-ids"), tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark_documents),
    ("mix", mix),
    ("token ids", token_ids),
]

# The network and the tokenizer are beyond SQL; the tests hold the stages against plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k + 1}")
    return docs
