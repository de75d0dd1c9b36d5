"""Scans of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: (event_id, cell, server, session, t microseconds, service seconds, prompt tokens).

    Of an event with value v seconds of service, the prompt is 64 tokens for each unit of its property k.
    """
    e = table(spark, sf_dir, "events")
    prompt = F.get_json_object("props", "$.k").cast("long") * 64
    return e.select("event_id", F.col("event_type").alias("cell"), F.col("user_id").alias("server"), (F.col("user_id") % 5).alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("service"), prompt.alias("prompt"))


#: The same in DuckDB.
REQUESTS_SQL = "SELECT event_id, event_type AS cell, user_id AS server, user_id % 5 AS session, epoch_us(ts) AS t, value AS service, (props ->> '$.k')::BIGINT * 64 AS prompt FROM events"
