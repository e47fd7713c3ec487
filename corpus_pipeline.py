"""A training corpus from documents: rules, near-duplicates, benchmark, mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of ``documents``. Between stages the rows are written as Parquet to the
shared folder and read again, so a stage neither runs twice nor depends on executors
that held its input.

Cases: a null or empty text fails the quality rules; an empty table passes through
all stages; further columns are carried to the last stage. Repeated rows and copies are
one document after the second stage, which keeps the smallest doc_id, of equal ids the
smallest set and text hash; rows that share a doc_id but not their text go by their own
texts in every stage, and rows without doc_id are kept apart. Ties in the mix go by
source, hash, doc_id and row. Very long texts pass through whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import decontam, near_dedup, quality_rules, source_mix, token_output
from evigraph.llm.queries import documents, tokenizer_path
from evigraph.llm.shared import cut

#: Words in a shingle and per cent of similarity from which documents are near-duplicates.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return near_dedup.keep(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontam.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mix.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in order of doc_id and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.round_trip(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("source_mix", mix),
    ("token_output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


#: Token ids are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None
