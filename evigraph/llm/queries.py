"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontam, hard_negatives, language_id, license_scan, line_dedup, near_dedup, phrases, quality_knn, quality_rules, source_mix, token_output, toxicity, url_filter


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir))
    joined = {c: F.array_join(c, " ") for c in ("missing_words", "added_words")}
    return found.withColumns(joined)


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(documents(spark, sf_dir))


def op3_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(documents(spark, sf_dir), k=2, percent=80)


def op4_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    """The place of the public vocabulary; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(documents(spark, sf_dir), tokenizer_path())


def op6_prefix_filtered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.scan(documents(spark, sf_dir), items).drop("items")


def op7_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_partial_matching_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op9_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = language_id.fold("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select("doc_id", "quality")
    model = quality_knn.fit(docs, labels)
    scored = quality_knn.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_perfect_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir))


def op11_prefix_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = language_id.fold("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_compression, op2_repetition_coverage, op3_odd_sketch_dedup, op4_fair_queue_mix, op5_addressable_codes, op6_prefix_filtered_windows, op7_url_vocabulary, op8_partial_matching_language, op9_neighbour_quality, op10_perfect_hash_lines, op11_prefix_tries, op12_pivot_table, op13_convolutional_toxicity)
}
SQL: dict[str, str] = {
    "op2_repetition_coverage": quality_rules.SQL, "op3_odd_sketch_dedup": near_dedup.SQL, "op4_fair_queue_mix": source_mix.SQL, "op6_prefix_filtered_windows": decontam.SQL, "op7_url_vocabulary": url_filter.SQL, "op10_perfect_hash_lines": line_dedup.SQL, "op11_prefix_tries": phrases.SQL, "op12_pivot_table": hard_negatives.SQL,
}
