"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, mixing and encoding, a stage after another.

Each stage works on all that its predecessor kept; a stage's result is written as Parquet to the shared folder and read
again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import boilerplate, mixing, quality, sentencepiece_codec, simhash
from sparkfolio.llm.queries import piece_model
from sparkfolio.llm.shared import col, fresh, staged


#: Words whose ids a Python worker keeps through all stages: half the operators' own default, as other stages need memory too.
CACHE_WORDS = 500_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep."""
    verdict = fresh(docs, "quality")
    return quality.score_quality(docs, piece_model(), only_kept=True, out=verdict, cache_words=CACHE_WORDS).drop(verdict)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many pages of their source repeat; ``n_chars`` follows the text."""
    kept = boilerplate.drop_boilerplate(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[length.alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of the mix, repeated as often as it takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and digests of them and of the decoded text."""
    return sentencepiece_codec.digests(sentencepiece_codec.encode_documents(docs, piece_model(), cache_words=CACHE_WORDS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("line dedup", drop_boilerplate),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can't express the fertility rules, the shingles' XXH64 or the encoding: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
