"""The queries of this folder, as the driver runs them, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, ngram_join, packing, passages, quality_cnn, quality_rules, sampling, toxicity, url_filter
from .sql import ORACLES

#: The vocabulary file of the packing query.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The vocabulary file of the language query.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: The rule list of the url query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _held_out() -> Column:
    return sampling.id_remainder(F.col("doc_id"), 5) == 0


def _learnable(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Labels outside the held-out fifth."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(~_held_out()).select("doc_id", F.col(label).alias("label"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return language_id.identify(docs, vocabulary=PIECES, per_language=300)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", _held_out().alias("held_out"))
    model = toxicity.fit_toxicity(_learnable(spark, sf_dir, "toxic"), docs, per_label=1000)
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), min_words=50)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer=TOKENIZER, length=4096, separator=1)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = quality_rules.fit_rules(_learnable(spark, sf_dir, "quality"), docs, per_label=3000)
    found = quality_rules.judge_quality(docs, rules)
    return found.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", _held_out().alias("held_out"))
    model = quality_cnn.fit_quality(_learnable(spark, sf_dir, "quality"), docs, per_label=2000)
    return quality_cnn.score_quality(docs, model, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module for its settings

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_url_filter": op4_url_filter,
    "op5_line_dedup": op5_line_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "pipeline": pipeline,
}
