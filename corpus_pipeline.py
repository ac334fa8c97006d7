"""A training corpus from the table ``documents``, in five stages.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` that works on all rows its predecessor kept. Stages
pass on the columns of ``documents``; the last one writes token files and returns what they hold. Between stages the
rows are written as Parquet to the shared folder and read back, so a lost executor costs no earlier stage.

Empty input passes through every stage as empty; rows that the mix takes several times appear several times after it.
Null texts count as empty ones, which are near copies of each other, so one of them stays; a null source is a source of
its own; of rows with the same id and text one stays, and of ties the row with the smaller hash of its text; texts of any
length are taken whole; extra columns are passed on, whatever their names, up to the last stage, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexwarden.llm import decontamination, mixing, simhash, tokenfiles, toxicity
from hexwarden.llm.common import table
from hexwarden.workspace import written


#: The last stage runs in executors that earlier stages have filled, so its workers cache fewer pieces than by themselves.
CACHE_PIECES = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokenfiles.encode_and_read(docs, cache_pieces=CACHE_PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: The trees of the first stage have no SQL form; tests hold each stage against its operator's decisions on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return docs
