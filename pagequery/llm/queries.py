"""The thin queries over the operators: whole tables, production parameters, results as digests where texts are long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, langid, mixing, passages, pseudolm, quality, simhash, sketches, suffixes
from .common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.learn(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "html")
    return htmltext.extract(pages).select("page_id", "text", F.length("text").alias("n_chars"))


def op3_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudolm.score(docs, pseudolm.fit(docs)).drop("text")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))[0].drop("source")


def op6_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "n_spans", "partners", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.classify(docs.withColumn("held_out", quality.held_out()), model).drop("text")


def op10_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_html_text, op3_masked_likelihood, op4_suffix_dedup, op5_source_mix, op6_fuzzy_passages, op7_template_leaks, op8_simhash_near_duplicates, op9_quality_score, op10_iblt_fingerprints, pipeline)
}

#: SQL can express none of these: they learn, sketch, chain, draw or hash with functions that it lacks. tests/llm has their brute-force versions.
ORACLE_SQL: dict[str, str] = {}
