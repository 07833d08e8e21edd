"""From documents to token files: quality, near duplicates, benchmark passages, source mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written as
Parquet and read again for the next. All but the last return the columns of ``documents``. Nulls, empty texts, repeated
rows and empty tables are defined by the operators that the stages call.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, minhash, mixing, quality, token_files
from gridloom.session import scratch_path, settle


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text stays within their language's threshold."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class linked by 5-word shingles at similarity 0.8 or more."""
    return minhash.deduplicate(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit less than one word in twenty."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them: a row for each copy."""
    return mixing.repeated(mixing.mix(docs), docs.columns).select(*docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending order of ids; what is returned is read back from them: place, length and crc32 of each row."""
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2, drops_space=True)
    return token_files.with_crc(token_files.read_tokens(spark, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", accept_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixture", mix_sources),
    ("token files", write_token_files),
]

#: SQL can't express the language model, the dual iterations or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
