"""JSON Lines sources and sinks, and the cache of computed rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the stored entities.
DOCS = "doc_key string, source string, doc_id string, page_no int, image_path string, width int, height int, text string, n_text_chars long"
QUERIES = "query_id string, source string, question string, answers array<string>, gold_doc_key string, split string, metadata map<string,string>"
TRACE = "query_id string, question string, answers array<string>, gold_doc_key string, retrieved_doc_keys array<string>, split string, k int"


def read(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Typed rows of JSON Lines; blank lines are skipped, and with `strict` a line that is no such row is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, characters as they are."""
    df.write.mode(mode).json(path)


def append(df: DataFrame, path: str) -> None:
    """Add records to a result set; a file appears whole or not at all."""
    df.write.mode("append").json(path)


def canonical(*names: str) -> Column:
    """A row as canonical JSON text: keys sorted, null fields kept."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def results(spark: SparkSession, paths: str | list[str], label: Column | None = None) -> DataFrame:
    """Records of all files, ragged columns and all, with `_file`, and `_label`: their own label, else the derived one."""
    df = spark.read.option("mergeSchema", "true").json(paths).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    own = F.col("label") if "label" in df.columns else F.lit(None).cast("string")
    return df.withColumn("_label", F.coalesce(own, label if label is not None else F.lit(None).cast("string")))


def fields(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Names and types of a Parquet table, from footers alone."""
    return [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema.fields]


def cached(spark: SparkSession, path: str, wanted: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of `wanted` through a Parquet cache: only keys that it lacks are computed, and appended."""
    reader = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = reader.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(reader)
    todo = wanted.join(spark.read.parquet(path).select(key), key, "left_anti") if there else wanted
    compute(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(key), key, "left_semi")


def gate(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, or an error when it is run if the aggregate condition does not hold over all of it (an empty table fails, too)."""
    checked = df.agg(F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message)).alias("ok"))
    return df.join(F.broadcast(checked)).where("ok IS NULL").drop("ok")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table for a report")
    show = lambda x: "–" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(map(show, r)) + " |" for r in rows)])
