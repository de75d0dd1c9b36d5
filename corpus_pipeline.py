"""A corpus pipeline of five stages: quality, near-duplicates, repeated passages, benchmark leaks, and the mix of sources.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame with the columns of
documents; the last returns what the mix takes of each document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.llm import decontam, mixing, passages, quality, simhash


def _aside(docs: DataFrame, names: tuple[str, ...]):
    """docs with its own columns of those names out of an operator's way, and what puts them back and drops all others."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    back = [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(own), lambda df: df.select(*back)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents outside the held-out fold, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~quality.held_out())
    docs, back = _aside(docs, ("score", "predicted"))
    return back(quality.classify(docs, model).where("predicted = 1"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    return simhash.distinct(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which no word is left go. n_chars follows the text."""
    docs, back = _aside(docs, ("n_words", "n_removed", "n_spans", "partners"))
    found = passages.dedup(docs)
    found = found.where("n_removed = 0 OR n_removed < n_words")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(found)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, nor one with other parameters."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(docs)[0]


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("passages", cut_passages),
    ("decontamination", drop_leaks),
    ("mix", mix_sources),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py checks each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    at = f"{folder.rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return done
        done.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
