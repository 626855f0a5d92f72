"""A corpus pipeline: toxic documents out, common lines out, one of each group of near-duplicates,
documents with benchmark passages out, and the rest packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All stages but the last
return the columns of `docs`, whatever their names. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, ngram_join, packing, sampling, toxicity
from tidemark.llm.queries import TOKENIZER
from tidemark.llm.store import Table, release

#: No SQL expresses a trained network or a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def _held(docs: DataFrame) -> DataFrame:
    """The text beside all other columns in one, so that no column of the input meets an operator's of the same name."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"), "text")


def _restored(found: DataFrame, columns: list[str], **replaced) -> DataFrame:
    """The columns of the input again, in their order."""
    return found.select(*[replaced.get(c, F.col("text") if c == "text" else F.col("__row")[c]).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels outside its held-out fifth, does not predict toxic.

    Without labels nothing is toxic; null and empty texts are judged as texts without words; repeated rows alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(sampling.id_remainder(F.col("doc_id"), 5) != 0)
    model = toxicity.fit_toxicity(labels.select("doc_id", F.col("toxic").alias("label")), docs)
    return _restored(toxicity.score_toxicity(_held(docs), model).where("predicted = 0"), docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines found in ten of them or more; n_chars follows the text.

    Every document stays, a null text as null and one that loses all its lines as empty; repeated rows count as documents of their own.
    """
    kept = line_dedup.drop_common_lines(_held(docs), min_docs=10)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _restored(kept, docs.columns, text=text, n_chars=F.coalesce(F.char_length(text).cast("long"), F.lit(0).cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id.

    Texts without words are in no group and stay, but rows that agree in doc_id and text are one document.
    """
    return ngram_join.keep_one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null and empty texts, and all texts if the benchmark is empty, stay."""
    found = decontaminate.benchmark_hits(_held(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _restored(found.where("NOT contaminated"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens; a null text is one piece of one token."""
    return packing.pack_documents(docs, tokenizer=TOKENIZER, length=4096, separator=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is written and read again by the next."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept = Table(stage(spark, docs, sf_dir), name)
        if held:
            held.drop()
        release(spark)
        held, docs = kept, kept.df
    packed = STAGES[-1][1](spark, docs, sf_dir)
    held.drop()  # the pieces are in tables of their own by now
    return packed
