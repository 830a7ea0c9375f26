"""Documents to packed training sequences: language ID, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm import decontaminate, language, line_dedup, near_dedup, packing
from arcloom.llm.common import give_back, held_out, table
from arcloom.scratch import cut

#: SQL can't express the learned language model or the shift-resistant chunks; the tests hold run() against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; texts without letters and those under its threshold go."""
    give_back(spark)
    model = language.train(docs, ~held_out(3, 1))
    return language.identify(docs, model, keep=tuple(docs.columns)).where("accepted").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated multi-line chunks go, and documents of which nothing but white space is left."""
    give_back(spark)
    done = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of texts of five-word similarity 0.8 or more stays."""
    give_back(spark)
    return near_dedup.first_of_similar(docs).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    give_back(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every remaining document's pieces in the token sequences. Workers that have done the other stages keep fewer words."""
    give_back(spark)
    return packing.pack(docs, words_kept=1 << 17)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
