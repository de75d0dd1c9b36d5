"""Freezing a workload: deduplicated documents, a document-level hold-out, seeded traces, and content fingerprints.

Random choices rank rows by a hash of the seed and the row's key, so they depend on nothing else: the order of the input and
other rows leave them as they are.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of the keys that a seeded draw finds its limit by.
BUCKETS = 256


def limited_union(parts: list[tuple[DataFrame, int]], order: str) -> DataFrame:
    """The first rows by `order` of every part, up to its limit; a limit of 0 or less leaves a part out. The limit counts rows, before any dedup."""
    taken = [df.orderBy(order).limit(n) for df, n in parts if n > 0]
    out = taken[0] if taken else parts[0][0].limit(0)
    for df in taken[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, in the given total order."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")


def hash_rank(seed: int | str, *parts: Column) -> Column:
    """The text that seeded choices are ordered by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def heldout_keys(keys: DataFrame, key: str, fraction: float = 0.25, seed: int = 1234) -> DataFrame:
    """floor(n * fraction) of the distinct keys, by hash.

    The rank over all keys needs no sort in one task: keys are counted by the first digits of their hash, whole groups below the
    cut are taken, and only the group at the cut is ranked.
    """
    hashed = keys.select(key).distinct().withColumn("h", hash_rank(seed, F.col(key))).withColumn("g", F.substring("h", 1, 3))
    sizes = sorted((r["g"], r["n"]) for r in hashed.groupBy("g").agg(F.count("*").alias("n")).collect())  # 4,096 at most
    room = int(sum(n for _, n in sizes) * fraction)
    whole, cut = [], None
    for g, n in sizes:
        if n <= room:
            whole.append(g)
            room -= n
        else:
            cut = g
            break
    ranked = hashed.where(F.col("g") == cut if cut else F.lit(False)).withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("h", key))).where(F.col("rn") <= room)
    return hashed.where(F.col("g").isin(whole) if whole else F.lit(False)).select(key).unionAll(ranked.select(key))


def sampled_trace(queries: DataFrame, keys: DataFrame, k: int = 5, seed: int = 1234) -> DataFrame:
    """(query_id, gold_doc_key, retrieved): the gold document first, then k - 1 others by hash of seed, query and document.

    Queries (query_id, gold_doc_key) whose gold document is absent from keys (doc_key) drop out; k stops at what there is. The queries are
    a stated set that meets all keys, and no pair is sorted or shuffled: the keys are dealt over buckets, and of each bucket only the least number from
    the hash is kept; the k - 1 first pairs cannot lie above the number of the bucket that comes k - 1st, and few others lie below it.
    """
    known = queries.join(keys.select(F.col("doc_key").alias("gold_doc_key")).distinct(), "gold_doc_key", "left_semi").select("query_id", "gold_doc_key")
    known = keys.sparkSession.createDataFrame(known.toArrow(), known.schema)  # it is met three times, and found once
    number = F.conv(F.substring(hash_rank(seed, F.col("query_id"), F.col("doc_key")), 1, 15), 16, 10).cast("long")
    pairs = keys.select("doc_key").join(F.broadcast(known), F.col("gold_doc_key") != F.col("doc_key")).withColumn("h", number)
    least = pairs.groupBy("query_id", F.pmod(F.xxhash64("doc_key"), F.lit(BUCKETS)).alias("bucket")).agg(F.min("h").alias("h"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("h"))
    limits = least.withColumn("n", nth).where(F.col("n") <= k - 1).groupBy("query_id").agg(F.max("h").alias("most"), F.count("*").alias("n"))
    limited = known.join(limits, "query_id").withColumn("most", F.when(F.col("n") == k - 1, F.col("most")).otherwise(F.lit((1 << 63) - 1)))
    near = keys.select("doc_key").join(F.broadcast(limited), (F.col("gold_doc_key") != F.col("doc_key")) & (number <= F.col("most")))
    order = Window.partitionBy("query_id").orderBy(hash_rank(seed, F.col("query_id"), F.col("doc_key")), "doc_key")
    drawn = near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k - 1)
    lists = drawn.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "doc_key"))), lambda x: x["doc_key"]).alias("others"))
    gold = F.array(F.col("gold_doc_key"))
    return known.join(lists, "query_id", "left").select("query_id", "gold_doc_key", F.when(F.col("others").isNull(), gold).otherwise(F.concat(gold, "others")).alias("retrieved"))


def sampled_trace_exact(queries: DataFrame, keys: DataFrame, k: int = 5, seed: int = 1234) -> DataFrame:
    """As sampled_trace, with the draws of CPython's random.Random(f"{seed}:{query_id}").sample over the sorted keys.

    The sorted keys are one broadcast list, so this form is for corpora whose keys fit a worker.
    """
    names = sorted(r[0] for r in keys.select("doc_key").distinct().limit(1_000_001).collect())
    if len(names) > 1_000_000:
        raise ValueError("too many keys for the exact form")
    sent = keys.sparkSession.sparkContext.broadcast(names)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q, gold in zip(pdf["query_id"], pdf["gold_doc_key"], strict=True):
                others = [x for x in sent.value if x != gold]
                if len(others) < len(sent.value):
                    rows.append((q, gold, [gold, *random.Random(f"{seed}:{q}").sample(others, min(k - 1, len(others)))]))
            yield pd.DataFrame(rows, columns=["query_id", "gold_doc_key", "retrieved"])

    types = dict(queries.dtypes)
    return queries.select("query_id", "gold_doc_key").mapInPandas(draw, f"query_id {types['query_id']}, gold_doc_key {types['gold_doc_key']}, retrieved array<{types['gold_doc_key']}>")


def resolved(trace: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, keys, texts): a trace's documents in their order; keys without a document drop out."""
    long = trace.select("query_id", F.posexplode("retrieved").alias("at", "doc_key"))
    found = docs.select("doc_key", "text").join(F.broadcast(long), "doc_key")  # the trace is short, the texts are not
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "doc_key", "text"))).alias("d"))
    return lists.select("query_id", F.transform("d", lambda x: x["doc_key"]).alias("keys"), F.transform("d", lambda x: x["text"]).alias("texts"))


def row_fingerprint(*columns: Column) -> Column:
    """SHA-256 of a row's canonical string: values as text joined by '|', null as an empty value."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def table_fingerprint(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """Sixteen hexadecimal digits over all rows in order: hashes of ordered groups of rows, hashed again in order.

    Groups are ranges of 1,000 of the (integer) order column, so no task holds more than a group, and the last step sees 64 characters for each.
    """
    rows = df.select(F.floor(F.col(order) / 1000).alias("g"), F.col(order).alias("o"), row_fingerprint(*[F.col(c) for c in columns]).alias("h"))
    join = lambda d, o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, "h"))), lambda x: x["h"]), "")
    groups = rows.groupBy("g").agg(F.sha2(join(rows, "o"), 256).alias("h"))
    return groups.agg(F.substring(F.sha2(join(groups, "g"), 256), 1, 16).alias("fingerprint"))
