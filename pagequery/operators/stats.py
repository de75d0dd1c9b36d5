"""Analytics over result records: percentiles, medians by position, last writes, coverage, comparability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From so many samples on a p99 is reliable.
RELIABLE = 100


def percentiles(value: Column) -> list[Column]:
    """p50, p95, p99 (interpolated), mean, sample deviation (0 for one sample), min, max, n and whether p99 is reliable."""
    at = lambda q: F.percentile(value, F.lit(q))
    return [
        *(at(q).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("n"),
        (F.count(value) >= RELIABLE).alias("p99_is_reliable"),
    ]


def at_index(df: DataFrame, by: list[str], value: str, tie: str, index: Column, name: str) -> DataFrame:
    """sorted(values)[index] of each group; `index` may use the group's size, n."""
    w = Window.partitionBy(*by)
    placed = df.withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy(value, tie)) - 1)
    return placed.where(F.col("at") == index).select(*by, F.col(value).alias(name))


def upper_median(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """sorted(values)[n // 2], which for an even n is the upper of the middle two."""
    return at_index(df, by, value, tie, F.floor(F.col("n") / 2), "median_upper")


def last_write(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row by `order` of each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("rn = 1").drop("rn")


def first_write(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row by `order` of each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("rn = 1").drop("rn")


def comparable(records: DataFrame, fields: list[str], order: str) -> DataFrame:
    """(field, n_distinct, n_differing, comparable): fields must equal the first record's in all records, null being a value."""
    first = records.orderBy(order).limit(1).select(*[F.col(f).cast("string").alias(f"first_{f}") for f in fields])
    long = records.join(F.broadcast(first)).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v"), F.col(f"first_{f}").alias("w")) for f in fields])).alias("x")).select("x.*")
    differing = F.sum(F.when(F.col("v").eqNullSafe(F.col("w")), 0).otherwise(1))
    n = F.count_distinct("v") + F.max(F.when(F.col("v").isNull(), 1).otherwise(0))
    return long.groupBy("field").agg(n.cast("long").alias("n_distinct"), differing.alias("n_differing"), (differing == 0).alias("comparable"))


def missing(every: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """What is wanted and was not measured."""
    return every.join(have, on, "left_anti")


def ratio_to_anchor(df: DataFrame, by: str, label: str, value: str, anchor: str) -> DataFrame:
    """Each row's value by that of the row labelled `anchor` in the same group; null without one, or if it is 0."""
    base = F.max(F.when(F.col(label) == anchor, F.col(value))).over(Window.partitionBy(by))
    return df.withColumn("ratio", F.try_divide(F.col(value), base))
