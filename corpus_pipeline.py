"""From raw documents to a training mix: five stages, each a call of one operator of pagewright.llm.

Every stage takes all that the one before it kept and returns the columns of its input; the last returns the mixture.
A row without doc_id can't be named by a decision and goes with the first stage that decides by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import crc_mod, discard, stash, stashes
from pagewright.llm.decontaminate import contamination
from pagewright.llm.exact_dedup import exact_dedup
from pagewright.llm.language_id import UNKNOWN, fit, language_id
from pagewright.llm.mixing import mix
from pagewright.llm.simhash import simhash_groups


#: Cosine with the best profile under which a text is in none of the learned languages, and characters from which that can
#: be told: shorter clean texts have few trigrams and reach low cosines by chance.
LEAST_SCORE, ENOUGH = 0.1, 200


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the learned languages: null texts, texts without letters, and texts of ENOUGH characters or
    more whose score is under LEAST_SCORE. Profiles are learned from the same documents as for the query of language ID."""
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    away = {c: f"__input_{c}" for c in docs.columns if c in ("lang_pred", "score")}  # names that the operator gives
    renamed = docs.withColumnsRenamed(away)
    told = language_id(renamed, fit(docs.where(~held)), tuple(renamed.columns))
    told = told.where((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= LEAST_SCORE) | (F.length("text") < ENOUGH)))
    return told.select(renamed.columns).withColumnsRenamed({v: k for k, v in away.items()})


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    keep = exact_dedup(docs).where("kept").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints the one with the smallest doc_id stays."""
    keep = simhash_groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").select(docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is used, and where in an epoch; every document is used at least once."""
    return mix(docs)


STAGES = [("language_id", known_language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean_of_benchmark), ("mixing", mixture)]

#: The stages hold learned profiles and searches that SQL cannot express; a test compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what a stage returns is written as Parquet and read again for the next, and what was
    written on the way to it is removed."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), stashes()
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        discard(spark, start, keep=1)
    return docs
