"""A training corpus from ``documents``: language, near and substring dedup, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm import decontaminate, fm_index, language, mixing, near_dedup
from attesta.llm.scratch import materialise

SHINGLE, SIMILARITY_PCT, REPEATED_WORDS = 5, 80, 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without letters) go; a missing ``lang`` is filled in."""
    found = language.identify(docs).filter(F.col("lang_pred") != language.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.without_near_duplicates(docs, shingle=SHINGLE, threshold_pct=SIMILARITY_PCT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that repeat are cut out; a document that was nothing else goes. Texts without such
    passages stay as they are."""
    n_words, n_removed, kept = "n_words", "n_removed", "kept_text"
    cut = fm_index.remove_repeated_words(docs, window=REPEATED_WORDS)
    text = F.when(F.col(n_removed) > 0, F.col(kept)).otherwise(F.col("text"))
    return (cut.filter((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_words)))
            .withColumn("text", text).withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that it takes, with the number of its copies; documents of no copies go."""
    return mixing.mix(docs).filter(F.col("copies") > 0)


STAGES = [("language", identify_language), ("near duplicates", drop_near_duplicates), ("repeats", cut_repeats),
          ("decontamination", drop_leaks), ("mixing", mix_sources)]
#: The stages learn, embed and iterate: SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
